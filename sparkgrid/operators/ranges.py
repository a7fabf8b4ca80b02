"""Byte ranges that were read: union length, hits, and the ratio to what was asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkgrid.functions.windows import div
from sparkgrid.scratch import stored

#: Ranges are cut at multiples of so many bytes, so one file's go to many tasks.
BLOCK_BYTES = 1 << 20


def distinct_bytes(ranges: DataFrame, key: str = "raster_id", block: int = BLOCK_BYTES) -> DataFrame:
    """Bytes that the ranges (key, offset, length) cover, each counted once.

    Ranges are cut by blocks of the file; what covers a block is united within
    it, so no task holds a whole file's ranges.  Equal pieces count once before
    that, which keeps a range that many reads repeat from filling a task.
    """
    offset, length = F.col("offset"), F.col("length")
    last = F.when(length > 0, div(offset + length - 1, F.lit(block))).otherwise(div(offset, F.lit(block)))
    spread = ranges.select(key, offset.alias("_from"), (offset + length).alias("_to"), F.explode(F.sequence(div(offset, F.lit(block)), last)).alias("_block"))
    begin, end = F.greatest("_from", F.col("_block") * block), F.least("_to", (F.col("_block") + 1) * block)
    pieces = spread.select(key, "_block", begin.alias("_from"), end.alias("_to"))
    # Of the pieces that begin alike the longest covers the others.
    longest = pieces.groupBy(key, "_block", "_from").agg(F.max("_to").alias("_to"))
    earlier = Window.partitionBy(key, "_block").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("_to") - F.greatest(F.col("_from"), F.coalesce(F.max("_to").over(earlier), F.col("_from"))))
    return longest.select(key, fresh.cast("long").alias("fresh")).groupBy(key).agg(F.sum("fresh").alias("distinct_bytes"))


def touches(offset: Column, length: Column, begin: Column, end: Column) -> Column:
    """Half-open overlap; a range without length touches nothing."""
    return (length > 0) & (begin < end) & (offset < end) & (begin < offset + length)


def touched(probes: DataFrame, ranges: DataFrame, key: str = "raster_id") -> DataFrame:
    """Probes (key, begin, end) with whether any range of the key touches them.

    A probe is touched if, of the ranges that start before its end, the furthest
    end lies beyond its begin: a running maximum in the order of starts and probes'
    ends.  Both are dealt by range of that order, so neither a key's probes and
    ranges meet pair by pair nor does a key stay in one task.
    """
    read = ranges.filter(F.col(key).isNotNull() & (F.col("length") > 0))
    starts = read.select(F.col(key).alias("_key"), F.col("offset").alias("_at"), F.lit(1).alias("_is_range"), (F.col("offset") + F.col("length")).alias("_end"))
    asked = probes.withColumns({"_key": F.col(key), "_at": F.col("end"), "_is_range": F.lit(0), "_end": F.lit(None).cast("long")})
    order = ("_key", "_at", "_is_range")  # a range that starts where a probe ends comes after it
    both = asked.unionByName(starts, allowMissingColumns=True).withColumn("_uid", F.monotonically_increasing_id())
    dealt = stored(both.repartitionByRange(*order, "_uid").withColumn("_part", F.spark_partition_id()), "touched")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part", "_key").agg(F.max("_end").alias("_end")).select(F.col("_part").alias("_p"), F.col("_key").alias("_k"), F.max("_end").over(earlier).alias("_before"))
    here = Window.partitionBy("_part", "_key").orderBy("_at", "_is_range", "_uid").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("_here", F.max("_end").over(here)).filter("_is_range = 0")
    met = run.join(before, (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")))
    hit = (F.col("begin") < F.col("end")) & (F.col("begin") < F.greatest("_here", "_before"))
    return met.select(*[F.col(f"`{c}`") for c in probes.columns], F.coalesce(hit, F.lit(False)).alias("touched"))


def read_statistics(requests: DataFrame, key: str = "raster_id") -> DataFrame:
    """Sums of (requested_bytes, fetched_bytes, request_count) with the amplification, 0 where nothing was requested."""
    sums = requests.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("requested_bytes", "fetched_bytes", "request_count")])
    ratio = F.coalesce(F.try_divide(F.col("fetched_bytes").cast("double"), F.col("requested_bytes").cast("double")), F.lit(0.0))
    return sums.withColumn("amplification", ratio)


def batch_starts(offsets: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Places in file order at which a new batch begins.

    A batch holds segments that continue each other up to ``most`` bytes.  The
    end of a batch is found by bisection in the running sum of sizes, so the work
    follows the batches and not the square of a run's segments.
    """
    n = len(offsets)
    breaks = np.append(np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1, n)
    total = np.concatenate([[0], np.cumsum(sizes)])
    starts, at, run = [], 0, 0
    while at < n:
        starts.append(at)
        while breaks[run] <= at:
            run += 1
        at = max(at + 1, min(int(np.searchsorted(total, total[at] + most, "right")) - 1, int(breaks[run])))
    return np.array(starts, np.int64)


def coalesced(segments: DataFrame, most: int = 64 << 10, key: str = "raster_id") -> DataFrame:
    """Batches of byte-adjacent segments in their order.

    Segments (key, ordinal, byte_offset, byte_count) that continue each other are
    read at once while the batch holds no more than ``most`` bytes.  A batch
    depends on all that come before it in its run, so a raster's segments, 16 bytes
    each, are sorted into one task, which streams them.
    """
    schema = segments.select(key).schema
    name = schema.fields[0].name
    out_names = [name, "byte_offset", "byte_count", "segments"]

    def made(keys: pa.Array, offsets: np.ndarray, sizes: np.ndarray, upto: int, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], upto)
        total = np.concatenate([[0], np.cumsum(sizes)])
        rows = [keys.take(pa.array(starts)), pa.array(offsets[starts]), pa.array(total[ends] - total[starts]), pa.array(ends - starts)]
        return pa.RecordBatch.from_arrays(rows, out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last batch begun, which the next rows may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            keys = table.column(0).combine_chunks()
            offsets, sizes = (table.column(c).to_numpy() for c in ("byte_offset", "byte_count"))
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            starts = np.concatenate([a + batch_starts(offsets[a:b], sizes[a:b], most) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            last = int(starts[-1])
            if len(starts) > 1:
                yield made(keys, offsets, sizes, last, starts[:-1])
            held = table.slice(last)
        if held is not None:
            keys = held.column(0).combine_chunks()
            offsets, sizes = (held.column(c).to_numpy() for c in ("byte_offset", "byte_count"))
            yield made(keys, offsets, sizes, len(offsets), np.zeros(1, np.int64))

    narrow = segments.select(key, "ordinal", F.col("byte_offset").cast("long").alias("byte_offset"), F.col("byte_count").cast("long").alias("byte_count"))
    dealt = narrow.repartition(key).sortWithinPartitions(key, "ordinal").select(key, "byte_offset", "byte_count")
    return dealt.mapInArrow(run, f"`{name}` {schema.fields[0].dataType.simpleString()}, byte_offset long, byte_count long, segments long")
