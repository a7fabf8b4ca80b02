"""Token-ID output: patched frame-of-reference blocks.

Documents are dealt by range of their id, encoded, and written as segments, each
a run of whole documents and a file image of its own::

    magic "PFR1", u32 ids, u32 blocks, u32 exceptions
    u32 x (blocks + 1)       where each block's packed bytes begin (the index)
    u32 x blocks             least id of each block
    u8  x blocks             packed width of each block, in bits
    u32 x (blocks + 1)       where each block's exceptions begin
    u8  x exceptions         place in the block
    u32 x exceptions         the bits above the width
    packed planes            128 ids less their minimum, bit planes of 16 bytes

The width is that of a percentile of the block's values; what needs more bits
has its upper part in the exception list.  Segments are rows of a Parquet table
in the shared folder, so Spark's committer makes a retried task's output whole.

Defined results: a null or empty text is just the end id; a null doc_id sorts
first; rows that repeat a doc_id follow each other in an order that their texts fix;
columns other than the id and the text are ignored; an empty table gives no
segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkgrid.llm.arrowtext import U64, mix64, multipliers, slices
from sparkgrid.scratch import shared_dir

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 17
#: Places of the table of remembered pre-tokens, and ids held for them; it is emptied beyond.
SLOT_BITS = 20
POOL_IDS = 4_000_000
MAGIC = b"PFR1"


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The file image of a segment of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n], grid[n:] = ids, ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - least[:, None]
    cut = np.partition(grid, BLOCK * percentile // 100 - 1, axis=1)[:, BLOCK * percentile // 100 - 1] if blocks else least
    width = np.frexp(cut.astype(np.float64))[1].astype(np.uint8)
    high = grid >> np.minimum(width, 31)[:, None] >> (width == 32)[:, None].astype(np.uint32)
    row, place = np.nonzero(high)
    top = int(width.max(initial=0))
    planes = np.empty((blocks, top, BLOCK // 8), np.uint8)
    for b in range(top):
        planes[:, b] = np.packbits(((grid >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1)
    packed = planes[np.arange(top)[None, :] < width[:, None]].tobytes()
    starts = np.concatenate([[0], np.cumsum(width.astype(np.uint32) * (BLOCK // 8))]).astype("<u4")
    outliers = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))]).astype("<u4")
    head = np.array([n, blocks, len(row)], "<u4")
    parts = [head, starts, least.astype("<u4"), width, outliers, place.astype(np.uint8), high[row, place].astype("<u4")]
    return MAGIC + b"".join(x.tobytes() for x in parts) + packed


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a segment's file image, or those of its blocks first to last."""
    if image[:4] != MAGIC:
        raise ValueError("not a segment of packed token ids")
    n, blocks, patched = np.frombuffer(image, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    starts, least, width = take("<u4", blocks + 1), take("<u4", blocks), take("u1", blocks)
    outliers, place, high = take("<u4", blocks + 1), take("u1", patched), take("<u4", patched)
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    rows = last - first
    top = int(width[first:last].max(initial=0))
    planes = np.zeros((rows, top, BLOCK // 8), np.uint8)
    body = np.frombuffer(image, np.uint8, int(starts[last] - starts[first]) if rows else 0, at + int(starts[first]))
    planes[np.arange(top)[None, :] < width[first:last, None]] = body.reshape(-1, BLOCK // 8)
    grid = np.zeros((rows, BLOCK), np.uint32)
    for b in range(top):
        grid |= np.unpackbits(planes[:, b], axis=1).astype(np.uint32) << np.uint32(b)
    a, z = int(outliers[first]), int(outliers[last])
    row = np.repeat(np.arange(rows), np.diff(outliers[first : last + 1].astype(np.int64)))
    grid[row, place[a:z]] |= high[a:z] << width[first:last][row].astype(np.uint32)
    grid += least[first:last, None]
    return grid.reshape(-1)[: max(0, n - first * BLOCK)]


#: Classes of bytes in byte-level BPE's pre-tokens; 5 is for what numpy does not settle here.
BLANK, SPACE, LETTER, DIGIT, MARK, UNSURE = range(6)
CLASSES = np.full(256, MARK, np.uint8)
CLASSES[[9, 10, 13]] = SPACE
CLASSES[32] = BLANK
CLASSES[48:58] = DIGIT
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[[*range(9), 11, 12, *range(14, 32), 127]] = UNSURE
CLASSES[128:] = LETTER
#: Of other characters only the letters U+00C0 to U+024F, less two signs, are settled: by their first byte.
CLASSES[[0xC2, *range(0xCA, 0x100)]] = UNSURE
CLASSES[[0xC0, 0xC1]] = UNSURE
PROBE = "It's 3 o'clock,  she'll say.\n\n\t Était-ce (vrai)? 12,5 % -- x_1 'd \n y"


def pretokens(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of texts start, and which texts have bytes that this does not settle.

    A pre-token is a run of letters, of digits or of marks with a blank before it,
    a contraction, or white space; of several white spaces before something else
    the last is apart.
    """
    kind = CLASSES[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    before = np.empty_like(kind)
    before[0], before[1:] = SPACE, kind[:-1]
    before[edge[:-1]] = SPACE
    after = np.empty_like(kind)
    after[-1], after[:-1] = SPACE, kind[1:]
    white = kind <= SPACE
    ends = edge[1:]
    starts = np.where(white, (before > SPACE) | edge[:-1] | ((after > SPACE) & ~ends), (kind != before) & (before != BLANK))
    starts[begin[:-1][np.diff(begin) > 0]] = True
    unsure = kind == UNSURE
    sign = np.flatnonzero(data == 0xC3)
    sign = sign[sign + 1 < n]
    unsure[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = True
    unsure[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # what begins like a special token
    quote = np.flatnonzero((data == 39) & starts)
    if len(quote):
        room = np.searchsorted(begin, quote, "right")
        left = begin[np.minimum(room, len(begin) - 1)] - quote
        one = data[np.minimum(quote + 1, n - 1)]
        two = data[np.minimum(quote + 2, n - 1)]
        pair = one.astype(np.int32) << 8 | two
        short = (left > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (left > 2) & np.isin(pair, [0x7265, 0x7665, 0x6C6C])  # re, ve, ll
        for met, size in ((long & ~short, 3), (short, 2)):
            at = quote[met]
            starts[at + 1] = False
            if size == 3:
                starts[at + 2] = False
            at = at[left[met] > size] + size
            # A blank after it starts something already; anything else does now.
            starts[at] = True
    places = np.flatnonzero(starts)
    doubt = np.add.reduceat(np.append(unsure, False), np.minimum(begin[:-1], n)) > 0
    return places, doubt & (np.diff(begin) > 0)


class Encoder:
    """Ids of whole texts by the tokenizers library, pre-tokens remembered.

    Byte-level BPE merges within pre-tokens alone, so a text's ids are those of
    its pre-tokens in a row.  Pre-tokens are cut and hashed (128 bits) in numpy and
    looked up in a table of fixed size; those not in it go to the library in one
    text, kept apart by line breaks.  Texts that the cutting does not settle go to
    it whole, and so does every text if a probe shows that the vocabulary's
    pre-tokens are others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        # Secret multipliers, so that no text can be made whose pre-tokens collide; the ids do not depend on them.
        self.seeds = [int.from_bytes(os.urandom(8), "little") for _ in range(2)]
        self.by = [multipliers(64, seed) for seed in self.seeds]
        self.apart = self.ids(["\n"])[0]
        self.cuts = len(self.apart) == 1
        self.cuts = self.cuts and self.encode([PROBE])[0].tobytes() == self.ids([PROBE])[0].tobytes()

    def forget(self) -> None:
        self.slots = np.zeros((4, 1 << SLOT_BITS), U64)  # two hashes; where in the pool, and how many
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def keep(self, ids: np.ndarray) -> int:
        """Append to the pool; returns the place."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def learned(self, words: list[bytes]) -> np.ndarray:
        """Place in the pool and number of ids, for each of distinct pre-tokens."""
        out = np.zeros((2, len(words)), U64)
        space = np.array([w.isspace() for w in words], bool)
        plain = np.flatnonzero(~space)
        (flat,) = self.ids([b"\n".join([words[i] for i in plain]).decode()])
        cuts = np.flatnonzero(flat == self.apart[0])
        if len(cuts) == len(plain) - 1:
            at = self.keep(flat)
            edges = np.concatenate([[-1], cuts, [len(flat)]])
            out[:, plain] = (edges[:-1] + 1 + at).astype(U64), (np.diff(edges) - 1).astype(U64)
            other = np.flatnonzero(space)
        else:
            other = np.arange(len(words))
        for i, ids in zip(other, self.ids([words[i].decode() for i in other]) if len(other) else [], strict=True):
            out[:, i] = self.keep(ids), len(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        raw = [t.encode() for t in texts]
        flat = b"".join(raw)
        if not self.cuts or not flat:
            return self.ids(texts)
        data = np.frombuffer(flat, np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        starts, doubt = pretokens(data, begin)
        sizes = np.diff(np.append(starts, len(data)))
        longest = int(sizes.max())
        if longest > len(self.by[0]):
            self.by = [multipliers(longest, seed) for seed in self.seeds]
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        values = data.astype(U64) + U64(1)
        first, second = (mix64(np.add.reduceat(values * by[place], starts) + sizes.astype(U64)) for by in self.by)
        if self.used > POOL_IDS:
            self.forget()
        slot = (first >> U64(64 - SLOT_BITS)).astype(np.int64)
        held, counts = self.slots[2][slot], self.slots[3][slot]
        lost = np.flatnonzero((self.slots[0][slot] != first) | (self.slots[1][slot] != second) | (counts == 0))
        if len(lost):
            # Doubtful texts' cuts may split a character; they are encoded whole.
            lost = lost[~doubt[np.searchsorted(begin, starts[lost], "right") - 1]]
        if len(lost):
            _, at, back = np.unique(first[lost], return_index=True, return_inverse=True)
            one = lost[at]
            clash = second[lost] != second[one][back]  # of 64 bits, not of 128
            doubt[np.searchsorted(begin, starts[lost[clash]], "right") - 1] = True
            fresh = self.learned([flat[a : a + n] for a, n in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
            held[lost], counts[lost] = fresh[:, back]
            self.slots[:, slot[one]] = first[one], second[one], *fresh
        counts = counts.astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(held.astype(np.int64) - total[:-1], counts)]
        edges = total[np.searchsorted(starts, begin)].tolist()
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        whole = np.flatnonzero(doubt).tolist()
        for i, x in zip(whole, self.ids([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = x
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: loading a vocabulary takes time."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


SEGMENTS = "shard int, segment int, start long, doc_ids array<long>, counts array<long>, image binary"


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts and write their segments to ``path`` in ascending order of the key."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    # The hash as a second key keeps one repeated id from filling a task.
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    closing = np.array([end_id], "<u4")

    def encode(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        start, number = 0, 0

        def segment() -> pa.RecordBatch:
            nonlocal start, number
            flat = np.concatenate(parts)
            row = pa.RecordBatch.from_pydict(
                {"shard": [shard], "segment": [number], "start": [start], "doc_ids": [ids.copy()], "counts": [counts.copy()], "image": [pack(flat)]},
                schema=pa.schema(
                    [("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("image", pa.binary())]
                ),
            )
            start, number = start + len(flat), number + 1
            for kept in (ids, counts, parts):
                kept.clear()
            return row

        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId(), 0
        for piece in slices(shards, "text"):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            for i, x in zip(piece.column("id").to_pylist(), encoder(vocabulary).encode(texts), strict=True):
                ids.append(i)
                counts.append(len(x) + 1)
                parts += (x, closing)
                held += counts[-1]
                if held >= SEGMENT_IDS:
                    yield segment()
                    held = 0
        if ids:
            yield segment()

    ranged.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Decode the segments: shard, start within the shard, and ids of every document."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = unpack(one["image"])
                edges = np.concatenate([[0], np.cumsum(one["counts"])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one["shard"]] * len(one["counts"]), pa.int32()),
                        pa.array(one["doc_ids"], pa.int64()),
                        pa.array(one["start"] + edges[:-1], pa.int64()),
                        pa.array(one["counts"], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64()),
                    ],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spark.read.schema(SEGMENTS).parquet(path).mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32.

    Where a shard starts is the sum of those before it, one row for each shard.
    """
    sizes = spark.read.schema(SEGMENTS).parquet(path).select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = read(spark, path).join(base, "shard")
    return placed.select("doc_id", (F.col("_base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Write ``docs`` to the shared folder in the file format and read them back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, vocabulary, path, **how)
    return documents(docs.sparkSession, path)
