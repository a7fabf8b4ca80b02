"""Suffix-array dedup: bytes covered by strings of 200 bytes that start twice or more.

The suffixes that matter are those that share 200 bytes with another, so only
their first 200 bytes order them, and most never need to be ordered at all:

1. Every string of 200 bytes chooses the gram of 40 with the least hash as its
   anchor.  The choice depends on the bytes alone, so equal strings choose alike.
   The strings of a document that share an anchor form a stretch; a stretch whose
   anchor's gram occurs once in the corpus holds no repeated string, and if the
   whole stretch occurs again all of its strings do.  Both are settled by counts.
2. What is left, the edges of repeated passages, goes to the suffix index.  It is
   cut into pieces of up to 32 string starts that have the bytes common to all of
   them as their key, so equal strings meet, and no anchor, however frequent,
   fills a task.
3. In a task, pieces come in the order of their keys, in batches.  A batch gets a
   suffix array; neighbours in it that agree in 200 bytes are repeated; it is
   scanned in order against every level of the index family, which finds matches
   with what came before; then it becomes a level, and levels of equal size merge.
   A family ends where a key ends, once it is large, so its memory follows a
   key's pieces at most.

Defined results: a null text is empty; texts of fewer than 200 bytes lose
nothing; matches never cross documents; rows that repeat an id and text count as
occurrences of each other and lose all that is long enough; a null id is an id;
other columns pass through ``dedupe`` (``ADDED`` ones are replaced); an empty
table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrid.llm.arrowtext import U64, bounds, mix64, slices
from sparkgrid.scratch import discard, stored, unused

LENGTH = 200
GRAM = 40
SPAN = LENGTH - GRAM + 1  # grams of a string
PIECE = 32  # string starts of a piece
#: Positions take the low bits of a sort key, so longer texts are worked off in parts.
PLACE_BITS = 24
PART = 1 << 22
#: Suffixes of a batch, and of a family from which on it ends with its key.
BATCH_PIECES = 2048
FAMILY = 1 << 17
ADDED = ("n_bytes", "n_removed", "spans", "kept")
RESULT = "n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"

_ROOT = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=U64)
    return _powers[0], _powers[1]


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text's bytes, the stretches of string starts by anchor.

    Arrays: first start, last start, anchor, hash of the anchor's gram, hash of
    all bytes of the stretch with the anchor's place in it.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if n - LENGTH + 1 > PART:
        done = []
        for at in range(0, n - LENGTH + 1, PART):
            one = stretches(data[at : min(n, at + PART + LENGTH - 1)])
            done.append(tuple(x + at if i < 3 else x for i, x in enumerate(one)))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    keys = (grams & ~U64((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=U64)
    # Least of each run of SPAN keys: from the ends of blocks of that size.
    room = -(-len(keys) // SPAN) * SPAN
    grid = np.full(room, U64(2**64 - 1))
    grid[: len(keys)] = keys
    grid = grid.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    anchor = (np.minimum(behind[:starts], ahead[SPAN - 1 : SPAN - 1 + starts]) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    change = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [starts - 1]])
    at = anchor[first]
    whole = (sums[last + LENGTH] - sums[first]) * down[first]
    whole = mix64(mix64(whole) + ((last - first) << 16 | (at - first)).astype(U64))
    return first, last, at, grams[at], whole


#: A stretch's place is first start << 16 | further starts << 8 | anchor less first start.
STRETCHES = "doc_id long, text_hash long, place long, gram long, whole long"


def sample(rows: DataFrame) -> DataFrame:
    """The stretches of every text: their place and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, begin = bounds(piece.column("text"))
            found = [stretches(data[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            counts = [len(f[0]) for f in found]
            if not sum(counts):
                continue
            first, last, anchor, gram, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(owner),
                    piece.column("text_hash").take(owner),
                    pa.array(first << 16 | (last - first) << 8 | (anchor - first)),
                    pa.array(gram.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                ],
                [f.split()[0] for f in STRETCHES.split(", ")],
            )

    return rows.mapInArrow(run, STRETCHES)


class Family:
    """Suffix arrays of geometric sizes over the pieces added so far."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys in order, and the suffix that each is of
        self.repeated: list[np.ndarray] = []  # by batch, for every suffix
        self.size = 0

    def add(self, texts: list[bytes], counts: list[int]) -> None:
        """A batch: suffixes start at the first ``count`` bytes of each text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts[:-1])])
        n = np.array(counts)
        starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts]
        keys = np.ascontiguousarray(keys).view(f"S{LENGTH}").ravel()
        order = np.argsort(keys, kind="stable")
        level, ids = keys[order], order + self.size
        self.repeated.append(np.zeros(len(ids), bool))
        self.size += len(ids)
        same = level[1:] == level[:-1]  # neighbours with a common prefix of LENGTH
        self.mark(ids[1:][same])
        self.mark(ids[:-1][same])
        for other, other_ids in self.levels:
            a, b = np.searchsorted(other, level, "left"), np.searchsorted(other, level, "right")
            met = a < b
            self.mark(ids[met])
            self.mark(other_ids[np.unique(np.concatenate([a[met], b[met] - 1]))])
        self.levels.append((level, ids))
        while len(self.levels) > 1 and len(self.levels[-1][1]) * 2 > len(self.levels[-2][1]):
            (x, i), (y, j) = self.levels.pop(), self.levels.pop()
            # Of equal suffixes, all marked by now, one stands for all that may come.
            both, ids = np.concatenate([y, x]), np.concatenate([j, i])
            order = np.argsort(both, kind="stable")
            both, ids = both[order], ids[order]
            fresh = np.append(True, both[1:] != both[:-1])
            self.levels.append((both[fresh], ids[fresh]))

    def mark(self, ids: np.ndarray) -> None:
        edges = np.cumsum([0, *map(len, self.repeated)])
        for k, flags in enumerate(self.repeated):
            flags[ids[(ids >= edges[k]) & (ids < edges[k + 1])] - edges[k]] = True

    def flags(self) -> np.ndarray:
        return np.concatenate(self.repeated) if self.repeated else np.zeros(0, bool)


PIECES = "core long, doc_id long, text_hash long, at int, count int, settled boolean, bytes binary"
RANGES = "doc_id long, text_hash long, `from` int, upto int"


def cut_pieces(joined: DataFrame) -> DataFrame:
    """Pieces of the stretches listed with each text.

    A piece's starts lie at most PIECE apart and at places, counted from the
    anchor, that are the same for equal strings; the bytes that all starts of
    such a run would share are its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, begin = bounds(piece.column("text"))
            out: list[list] = [[] for _ in range(7)]
            rows = zip(begin[:-1].tolist(), begin[1:].tolist(), *(piece.column(c).to_pylist() for c in ("doc_id", "text_hash", "open")), strict=True)
            for a, b, doc_id, text_hash, opened in rows:
                text = data[a:b].tobytes()
                for s in opened:
                    first = s["place"] >> 16
                    last, anchor = first + (s["place"] >> 8 & 255), first + (s["place"] & 255)
                    for block in range((anchor - last) // PIECE, (anchor - first) // PIECE + 1):
                        low, high = max(first, anchor - PIECE * block - PIECE + 1), min(last, anchor - PIECE * block)
                        core = text[anchor - PIECE * block : anchor - PIECE * block - PIECE + 1 + LENGTH]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=str(block).encode()).digest(), "little", signed=True)
                        for column, value in zip(out, (key, doc_id, text_hash, low, high - low + 1, s["settled"], text[low : high + LENGTH]), strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield _piece_batch(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield _piece_batch(out)

    return joined.mapInArrow(run, PIECES)


def _piece_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def scan_pieces(pieces: DataFrame) -> DataFrame:
    """Ranges of starts, of the pieces not settled, whose strings are repeated."""

    def found(family: Family, kept: list[tuple]) -> pa.RecordBatch | None:
        flags, at, rows = family.flags(), 0, []
        for doc_id, text_hash, low, count, settled in kept:
            own = flags[at : at + count]
            at += count
            if settled or not own.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            rows += [(doc_id, text_hash, low + int(x), low + int(y) - 1) for x, y in edges.reshape(-1, 2)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "from", "upto"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kept, before = Family(), [], None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PIECES):
                rows = batch.slice(at, BATCH_PIECES).to_pydict()
                cores = rows["core"]
                # A large family ends with its key; the batch is cut there.
                cuts = [0]
                if family.size >= FAMILY:
                    cut = next((i for i, c in enumerate(cores) if c != before), len(cores))
                    cuts = [0, cut] if 0 < cut < len(cores) else [0]
                    if cut == 0:
                        if (out := found(family, kept)) is not None:
                            yield out
                        family, kept = Family(), []
                for a, b in zip(cuts, [*cuts[1:], len(cores)], strict=True):
                    if a:
                        if (out := found(family, kept)) is not None:
                            yield out
                        family, kept = Family(), []
                    family.add(rows["bytes"][a:b], rows["count"][a:b])
                    kept += zip(*(rows[c][a:b] for c in ("doc_id", "text_hash", "at", "count", "settled")), strict=True)
                before = cores[-1]
        if (out := found(family, kept)) is not None:
            yield out

    return pieces.repartition("core").sortWithinPartitions("core").mapInArrow(run, RANGES)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, from, upto): starts whose 200 bytes start elsewhere too; rows has doc_id, text_hash and text."""
    found = stored(sample(rows), "stretches")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("n > 1")
    # Stored, so that the join reads two plain sides, of which Spark splits a hot gram's.
    grams = stored(grams.select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    met = stored(found.join(grams, "gram"), "met")
    discard(found, grams)
    mixed = met.filter("mixed")
    classes = mixed.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "place")])
    classes = stored(classes, "stretch-classes")
    again = mixed.join(classes.filter("n > 1").select("gram", "whole"), ["gram", "whole"])
    alike = met.filter("NOT mixed").unionByName(again.select(met.columns))
    first = F.shiftright("place", 16)
    whole = alike.select("doc_id", "text_hash", first.cast("int").alias("from"), (first + F.shiftright("place", 8).bitwiseAND(255)).cast("int").alias("upto"))
    opened = classes.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("place", (F.col("n") > 1).alias("settled"))).alias("open"))
    # A repeated row's stretches all occur twice, so its pieces, which come twice too, are all settled.
    joined = rows.join(opened, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    edges = scan_pieces(cut_pieces(joined.select("doc_id", "text_hash", "open", "text")))
    out = stored(whole.unionByName(edges), "ranges")
    discard(met, classes)
    return out


def union_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, b) for a, b in out]


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``ADDED``: length in bytes, bytes removed, their spans, and the bytes kept."""
    rest = [c for c in docs.columns if c not in ADDED]
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("text"))
    ranges = repeated_ranges(rows.filter(F.octet_length("text") >= LENGTH))
    doc, mark, found = (unused(n, rest) for n in ("_doc", "_hash", "_ranges"))
    by_doc = ranges.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(mark)).agg(F.collect_set(F.struct(F.col("from").alias("a"), F.col("upto").alias("b"))).alias(found))
    own = docs.select(*[F.col(f"`{c}`") for c in rest])
    joined = own.join(by_doc, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(raw) == F.col(mark)), "left").select(*[F.col(f"`{c}`") for c in rest], found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            sizes, removed, spans, kept = [], [], [], []
            data, begin = bounds(piece.column(text).cast(pa.large_string()))
            for a, b, ranges in zip(begin[:-1].tolist(), begin[1:].tolist(), piece.column(found).to_pylist(), strict=True):
                runs = union_spans([(r["a"], r["b"]) for r in ranges or ()])
                sizes.append(b - a)
                removed.append(sum(y - x for x, y in runs))
                spans.append([{"begin": x, "end": y} for x, y in runs])
                edges = [0, *(e for r in runs for e in r), b - a]
                kept.append(b"".join(data[a + x : a + y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.select(rest).columns,
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                [*rest, *ADDED],
            )

    schema = StructType(own.schema.fields + StructType.fromDDL(RESULT).fields)
    return joined.mapInArrow(run, schema)
