"""Language ID: multinomial naive Bayes over hashed character n-grams.

Labelled rows give n-gram counts by language; the matrix of their smoothed log
probabilities is broadcast, and batches are scored by gathering its rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from; equal texts get equal
results; the first of the sorted languages wins a tie; rows that repeat an id
each give theirs; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrid.llm.arrowtext import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Training rows at most (a hash of the id picks them); they bound the languages and the counts that the driver gets.
MAX_TRAIN_ROWS = 20_000
UND = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the bounds of each text's, and whether it has a letter.

    Letters count in lower case; what is between them counts as one blank.
    """
    points = np.frombuffer("".join(f"\n{t.lower()}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    alpha = letters()[points]
    has = np.add.reduceat(alpha, begin[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    keep[begin[:-1]] = True
    chars = np.where(alpha, points, np.uint32(32))[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])[begin]
    buckets = np.empty((len(chars), len(ORDERS)), np.uint16)
    code = np.zeros(len(chars), np.uint32)
    for n, order in enumerate(ORDERS):
        # The n-gram that ends at a character; at a text's start the one before's end mixes in nothing but a blank.
        code = np.zeros(len(chars), np.uint32)
        for back in range(order):
            shifted = np.full(len(chars), 32, np.uint32)
            shifted[back:] = chars[: len(chars) - back]
            if back:
                for d in range(back):
                    edge = kept[:-1] + d
                    shifted[edge[edge < kept[1:]]] = 32
            code = (code ^ shifted) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        buckets[:, n] = (code * np.uint32(0x85EBCA6B) + np.uint32(order)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return buckets, kept, has


class Model:
    """Languages in order, and the log probability of each bucket for each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        self.logs = np.log((counts + SMOOTHING) / (total + SMOOTHING * len(counts))).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability under equal priors for each text."""
        if not self.languages or not texts:
            return [UND] * len(texts), np.zeros(len(texts))
        buckets, begin, has = ngrams(texts)
        by_char = self.logs[buckets[:, 0]]
        for n in range(1, len(ORDERS)):
            by_char += self.logs[buckets[:, n]]
        logs = np.add.reduceat(by_char, begin[:-1], axis=0, dtype=np.float64)
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if h else UND for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the rows with text and language, or a hash sample of about ``max_rows`` of them."""
    rows = labelled.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * max_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in slices(batches, "text"):
            langs, texts = piece.column("lang").to_pylist(), piece.column("text").to_pylist()
            for one in sorted(set(langs)):
                buckets, _, _ = ngrams([t for t, x in zip(texts, langs, strict=True) if x == one])
                sums.setdefault(one, np.zeros(BUCKETS, np.int64))
                sums[one] += np.bincount(buckets.ravel(), minlength=BUCKETS)
        for one, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            texts = [t or "" for t in piece.column(text).cast(pa.large_string()).to_pylist()]
            langs, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*piece.select(rest).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL("lang_pred string, score double").fields))


def held_out(key: Column, mod: int, rest: int) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, by remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == rest, F.lit(False))
