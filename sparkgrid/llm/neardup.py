"""MinHash near-dedup with SetSketch registers.

A document is the set of its word shingles.  Equal sets form a class, so copies
cost one row each and no more.  A class has a SetSketch: register i is
``floor(1 - log_b(x_i))``, clipped, where x_i is the least of exponentially
distributed hashes of the shingles; sketches merge by maximum and equal registers
are the likelier the more similar the sets.  Bands of registers bucket the
classes; a pair that meets is judged by the joint likelihood of its registers'
order (above, equal, below) given both set sizes, and dropped only if 0.8 is
implausible by ``LIKELIHOOD_GAP``; what remains is compared on the full sets.

No bucket is expanded into all of its pairs.  Each round every bucket pairs its
members with one leader, the links found so far are made components, and buckets
that lie within one component are done.  When leaders find little more, the
classes of open buckets are compared across components in numpy, by block where a
bucket is large, and only plausible pairs become rows.  So every pair that shares
a bucket is linked, rejected, or already connected.

The chance that a pair at exactly the threshold shares no band of the default 40
of 6 registers is about 2e-6.

Defined results: a null, empty or blank text has no shingle and stands alone; a
text of fewer words than a shingle has one, its whole sequence; a row with a null
id may be linked but never names a component unless it stands alone; rows that
repeat an id are members of the same component if their texts are linked; other
columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrid.llm.arrowtext import U64, bounds, multipliers, shingle_hashes, slices, word_hashes
from sparkgrid.scratch import discard, small_side, stored, unused

#: Base, rate and largest value of the registers: bytes that serve sets of 1 to 10^9 shingles.
BASE, RATE, LARGEST = 1.1, 20.0, 255
BANDS, ROWS = 40, 6
#: Registers in all: the bands use the first, the likelihood all.
REGISTERS = 720
#: Fall of the log likelihood from its best to that of the threshold beyond which a pair is dropped.
LIKELIHOOD_GAP = 9.0
#: Share of a round's plausible pairs that are links below which all that is left is compared,
#: rounds before that anyway, and classes of a block of a large bucket.
LEAST_YIELD, MOST_ROUNDS, BLOCK = 0.5, 6, 512


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (sets x registers, bytes) of sets of 64-bit hashes; empty sets are all 0."""
    out = np.zeros((len(sets), registers), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    begin = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    by, other = multipliers(registers, seed=1), multipliers(registers, seed=2)
    least = np.empty((registers, len(full)), U64)
    for r in range(registers):
        least[r] = np.minimum.reduceat((flat ^ other[r]) * by[r], begin)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint8).T
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets from theirs."""
    return np.maximum(a, b)


def _log_likelihood(j, u, v, above, below, equal):
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    safe = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-12)), 0.0)
    return safe(above, up) + safe(below, down) + safe(equal, 1 - up - down)


def likelihoods(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches the likeliest similarity, and by how much its log likelihood exceeds the threshold's."""
    above = (a > b).sum(axis=1)
    below = (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    most = high.copy()
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = _log_likelihood(x, u, v, above, below, equal) > _log_likelihood(y, u, v, above, below, equal)
        high, low = np.where(left, y, high), np.where(left, low, x)
    best = (low + high) / 2
    at = np.minimum(threshold, most)
    return best, _log_likelihood(best, u, v, above, below, equal) - _log_likelihood(at, u, v, above, below, equal)


def features(docs: DataFrame, k: int, key: str, text: str, carry: bool = False) -> DataFrame:
    """Per row: id, n_shingles, a digest of the set (null without shingles), and its sketch, or the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = shingle_hashes(*word_hashes(*bounds(piece.column("text"))), k)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            if carry:
                last = piece.column("row")
            else:
                last = pa.array([r.tobytes() if len(s) else None for r, s in zip(sketch(sets), sets, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), last], ["id", "n", "digest", "row" if carry else "sketch"])

    rows = _rows(docs, key, text)
    if not carry:
        return rows.mapInArrow(run, "id long, n long, digest binary, sketch binary")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    carried = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), whole)
    schema = StructType.fromDDL("id long, n long, digest binary").add("row", carried.schema["row"].dataType)
    return carried.mapInArrow(run, schema)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes and registers allow the similarity."""
    sized = classes.select("cid", "n", "sketch")
    side = lambda s: sized.select(*[F.col(c).alias(f"{c}_{s}") for c in sized.columns])
    both = pairs.join(side("b"), F.col("b") == F.col("cid_b")).join(side("a"), F.col("a") == F.col("cid_a"))
    both = both.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(piece.column(c).to_pylist()), np.uint8).reshape(piece.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                n_a, n_b = (piece.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                best, gap = likelihoods(a, b, n_a, n_b, threshold)
                keep = pa.array((best >= threshold) | (gap <= LIKELIHOOD_GAP))
                yield piece.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose full sets are similar enough.

    Texts are fetched by the classes' first ids, which other rows may share; those
    whose own digest is the class's belong to it, and one of them serves.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    chosen = stored(classes.select("cid", "first_id", "digest").join(wanted, "cid"), "wanted")
    ids = stored(chosen.select("first_id").distinct(), "wanted-ids")
    told = features(rows.join(small_side(ids), F.col("id").eqNullSafe(F.col("first_id")), "left_semi"), k, "id", "text", carry=True)
    own = told.select("id", "digest", F.col("row.text").alias("text"))
    fetched = stored(own.join(small_side(chosen), (F.col("id").eqNullSafe(F.col("first_id"))) & (own["digest"] == chosen["digest"])).select("cid", chosen["digest"], "text"), "texts")
    # Only rows that repeat an id, or have none, give a class more than one text.
    texts = fetched if fetched.count() == chosen.count() else stored(fetched.dropDuplicates(["cid"]), "texts")
    side = lambda s: texts.select(*[F.col(c).alias(f"{c}_{s}") for c in texts.columns])
    both = pairs.join(side("b"), F.col("b") == F.col("cid_b")).join(side("a"), F.col("a") == F.col("cid_a"))
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def sets(piece: pa.RecordBatch, s: str) -> list[np.ndarray]:
            digests = piece.column(f"digest_{s}").to_pylist()
            fresh = {d: i for i, d in enumerate(digests) if d not in known}
            if fresh:
                made = shingle_hashes(*word_hashes(*bounds(piece.column(f"text_{s}").take(pa.array(list(fresh.values()))))), k)
                known.update(zip(fresh, made, strict=True))
            return [known[d] for d in digests]

        for piece in slices(batches, "text_b"):
            keep = []
            for x, y in zip(sets(piece, "a"), sets(piece, "b"), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= hundredths * (len(x) + len(y) - shared))
            yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if sum(x.nbytes for x in known.values()) > 32 << 20:
                known.clear()

    found = both.select("a", "b", "digest_a", "text_a", "digest_b", "text_b").mapInArrow(run, "a long, b long").distinct()
    out = stored(found, "links")
    discard(chosen, ids, fetched, *([] if texts is fetched else [texts]))
    return out


def components(links: DataFrame) -> DataFrame:
    """(cid, root) of every node of the links (a, b): root is the least node that it is connected with.

    Labels spread along links and are then followed once more each round, so
    long chains take few rounds.  Each round's labels are a stored table.
    """
    ways = stored(links.select("a", "b").union(links.select("b", "a")).toDF("cid", "other"), "ways")
    labels = stored(ways.groupBy("cid").agg(F.min("other").alias("m")).select("cid", F.least("cid", "m").alias("root")), "labels")
    while True:
        near = ways.join(labels.select(F.col("cid").alias("other"), "root"), "other").groupBy("cid").agg(F.min("root").alias("near"))
        met = labels.join(near, "cid").select("cid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        ahead = labels.select(F.col("cid").alias("root"), F.col("root").alias("next"))
        moved = met.join(ahead, "root").select("cid", "old", F.least("root", "next").alias("root"))
        before, labels = labels, stored(moved, "labels")
        discard(before)
        if labels.filter("old <> root").isEmpty():
            discard(ways)
            return labels.select("cid", "root")


def _buckets(classes: DataFrame) -> DataFrame:
    """(slot, band, cid, n, weight) of the buckets with two classes or more; weight is how many classes a class meets."""
    bands = F.array(*[F.xxhash64(F.substring("sketch", i * ROWS + 1, ROWS), F.lit(i)) for i in range(BANDS)])
    rows = classes.select("cid", "n", F.posexplode(bands).alias("slot", "band"))
    several = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "bands")
    met = stored(rows.join(several, "band"), "met")
    weights = met.groupBy("cid").agg(F.sum("c").alias("weight"))
    out = stored(met.join(weights, "cid").select("slot", "band", "cid", "n", "weight"), "buckets")
    discard(several, met)
    return out


def _remaining(rooted: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (a, b) of a bucket's classes in different components.

    The classes of a bucket come with their sketches to one place, those of a
    large bucket in blocks of about BLOCK, each pair of blocks to a place of its
    own.  There all are compared in numpy, and only plausible pairs become rows.
    """
    sizes = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("c"))
    blocks = sizes.select("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    spread = rooted.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("slot", "band", "cid", "n", "root", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = keyed.join(classes.select("cid", "sketch"), "cid")
    group = ("band", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        before = None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            keys = list(zip(*(columns[c] for c in group), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != before:
                    if held and (out := _compared(held, threshold)) is not None:
                        yield out
                    held, before = {c: [] for c in columns}, keys[a]
                for c, values in columns.items():
                    held[c] += values[a:b]
        if held and (out := _compared(held, threshold)) is not None:
            yield out

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _compared(bucket: dict[str, list], threshold: float) -> pa.RecordBatch | None:
    """The plausible pairs of one bucket, or of two blocks of it."""
    cid, root, own = (np.array(bucket[c]) for c in ("cid", "root", "own"))
    n = np.array(bucket["n"], float)
    if len(cid) < 2:
        return None
    sketches = np.frombuffer(b"".join(bucket["sketch"]), np.uint8).reshape(len(cid), -1)
    slot = bucket["slot"][0]
    within = bucket["lo"][0] == bucket["hi"][0]
    left, right = [], []
    for x in range(len(cid) - 1):
        y = np.arange(x + 1, len(cid))
        met = (root[y] != root[x]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * (threshold - 1e-9))
        if not within:
            met &= own[y] != own[x]
        y = y[met]
        if len(y) and slot:
            # A pair is judged in the first band that it shares.
            same = (sketches[y, : slot * ROWS] == sketches[x, : slot * ROWS]).reshape(len(y), slot, ROWS).all(axis=2).any(axis=1)
            y = y[~same]
        left.append(np.full(len(y), x))
        right.append(y)
    a, b = np.concatenate(left), np.concatenate(right)
    keep = []
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        best, gap = likelihoods(sketches[i], sketches[j], n[i], n[j], threshold)
        keep.append((best >= threshold) | (gap <= LIKELIHOOD_GAP))
    if not keep:
        return None
    keep = np.concatenate(keep)
    low, high = np.minimum(cid[a], cid[b])[keep], np.maximum(cid[a], cid[b])[keep]
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"]) if len(low) else None


def link_classes(classes: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """(cid, root) of the classes that are linked with others."""
    buckets = _buckets(classes)
    links: DataFrame | None = None
    roots: DataFrame | None = None
    tested: DataFrame | None = None
    found = 1.0
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (threshold - 1e-9)
    for turn in range(MOST_ROUNDS + 1):
        last = turn == MOST_ROUNDS or found < LEAST_YIELD
        rooted = buckets.withColumn("root", F.col("cid")) if roots is None else buckets.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        if turn:
            split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
            rooted = stored(rooted.join(split, "band"), "open-buckets")
        if last:
            likely = _remaining(rooted, classes, threshold)
        else:
            # First the class that meets most, as the origin of many copies does; then another order
            # each round.  The order is the same in all buckets: few leaders, few pairs.
            order = -F.col("weight") if turn == 0 else F.xxhash64("cid", F.lit(turn))
            rank = F.struct(order.alias("h"), F.col("cid"), F.col("root"), F.col("n"))
            leaders = rooted.groupBy("band").agg(F.min(rank).alias("l")).select("band", F.col("l.cid").alias("a"), F.col("l.root").alias("root_a"), F.col("l.n").alias("n_a"))
            met = rooted.join(leaders, "band").filter((F.col("a") != F.col("cid")) & (F.col("root") != F.col("root_a")) & near("n", "n_a"))
            pairs = met.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct()
            likely = _plausible(pairs, classes, threshold)
        if tested is not None:
            likely = likely.join(tested, ["a", "b"], "left_anti")
        likely = stored(likely, "likely")
        fresh = _confirmed(likely, classes, rows, k, threshold)
        linked, asked = fresh.count(), likely.count()
        found = linked / max(1, asked)
        if linked:
            links = fresh if links is None else links.union(fresh)
            roots = components(links)
        if turn:
            discard(rooted)
        if last:
            break
        tested = likely if tested is None else tested.union(likely)
    discard(buckets)
    return roots if roots is not None else classes.limit(0).select("cid", F.col("cid").alias("root"))


def _named(docs: DataFrame, k: int, threshold: float, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The features of the rows, (digest, root, component_id) of the classes, and the stored classes that this reads."""
    made = stored(features(docs, k, key, text), "features")
    by_set = made.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(by_set.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = link_classes(classes, _rows(docs, key, text), k, threshold)
    placed = classes.select("digest", "first_id", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return made, placed.join(names, "root").select("digest", "root", "component_id"), classes


def groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept, whether the row names its component."""
    made, named, _ = _named(docs, k, threshold, key, text)
    out = made.select("id", "n", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row with the least id stays.

    Rows are told by their id where it is unique.  Those of repeated or null ids
    are told by their shingle set, and one of each component stays.
    """
    made, named, classes = _named(docs, k, threshold, key, text)
    rooted = made.select("id", "digest").join(named, "digest", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
    by_id = stored(rooted.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.first("component_id").alias("component_id")), "ids")
    own, other = F.col(f"`{key}`").cast("long"), unused("_id", docs.columns)
    several = F.col("rows") > 1
    gone = stored(by_id.filter(several | F.col("id").isNull() | (F.col("id") != F.col("component_id"))).select(F.col("id").alias(other)), "gone")
    out = docs.join(small_side(gone), own.eqNullSafe(F.col(other)), "left_anti")
    again = stored(by_id.filter(several | F.col("id").isNull()).select(F.col("id").alias(other)), "repeated-ids")
    if again.isEmpty():
        discard(made, classes)
        return out
    told = features(docs.join(small_side(again), own.eqNullSafe(F.col(other)), "left_semi"), k, key, text, carry=True)
    met = told.join(named.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    alone = met.filter("digest IS NULL")
    first = met.filter("digest IS NOT NULL").filter(F.coalesce("component_id", F.col("id")).eqNullSafe(F.col("id"))).dropDuplicates(["root"])
    rest = alone.unionByName(first).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return out.unionByName(rest)
