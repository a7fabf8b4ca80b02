"""Toxicity: a convolutional text classifier, trained here in numpy.

Words are hashed to embeddings; filters of several widths slide over them, the
largest response of each counts, and a linear layer makes the logit.  Its inputs
are the text alone.  The classifier is trained on a bounded sample; the scale that turns
logits into probabilities, and a threshold for each language, are fitted on
histograms of all other labelled rows, a part of the sample among them.

Scoring uses that a filter's response is a sum of one number per word and place:
a table of those replaces embeddings and matrix products.

Defined results: a null or empty text scores as a text without words does; equal
texts get equal scores; without labels of both kinds the score is the share of
toxic rows, or 0.5 if there is none; a language without enough labels has the
threshold of all; rows that repeat an id each give theirs; other columns pass
through (``score`` and ``flagged`` are replaced); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrid.llm.arrowtext import U64, bounds, byte_table, slices, word_hashes
from sparkgrid.scratch import small_side, stored

BUCKETS = 1 << 16
EMBEDDING = 12
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
FILTERS = 8
EPOCHS = 4
#: Documents that count against a bucket's log odds at the start.
SHRINK = 10
BATCH = 32
CUT = 0.3
#: Bins of the histograms of logits: so many for each unit, up to a bound on either side.
BINS, FURTHEST = 256, 64
#: Training rows and words at most; a hash of the id picks the rows.
MAX_TRAIN_ROWS = 8_000
MAX_TRAIN_WORDS = 6_000_000
#: Toxic and other rows of a language that it takes to fit its own threshold.
LEAST_LABELS = 20
#: Letters, digits and bytes of other characters: punctuation parts words.
MEMBER = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
PAD = BUCKETS
NAMES = [(w, j) for w in WIDTHS for j in range(w)]


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its beginnings, and where the texts begin.

    Rows are words, each text followed by padding; the columns are the word and
    its first 4 to 7 bytes, so inflected forms share what their stem learns.
    """
    hashes, begin, starts = word_hashes(*bounds(column), MEMBER, PREFIXES)
    gap = max(WIDTHS)
    texts = len(begin) - 1
    out = np.full((len(hashes) + gap * texts, 1 + len(PREFIXES)), PAD, np.int32)
    row = np.arange(len(hashes)) + gap * np.repeat(np.arange(texts), np.diff(begin))
    bits = U64(64 - BUCKETS.bit_length() + 1)
    out[row, 0] = hashes >> bits
    for k, h in enumerate(starts):
        out[row, k + 1] = np.where(h == 0, PAD, h >> bits)
    return out, begin + gap * np.arange(texts + 1)


def gathered(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each word the sum of the table's rows for it and its beginnings."""
    out = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += table[ids[:, k]]
    return out


def within(responses: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """The responses, with places from which a filter would reach into the next text ruled out."""
    for j in range(1, width):
        responses[begin[1:] - j] = -np.inf
    return responses


class Net:
    """Weights of the classifier; ``a`` and ``b`` scale its logit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS + 1, EMBEDDING)) * 0.1).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = [(rng.standard_normal((EMBEDDING, FILTERS)) * 0.3).astype(np.float32) for _ in NAMES]
        self.filters[0][0, 0] = 1.0  # one filter starts on what the embedding's first place starts with
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.out[0] = 1.0
        self.shift = np.float32(0)
        self.a, self.b, self.rate = 1.0, 0.0, 0.5
        self.trained = False

    def responses(self, ids: np.ndarray, begin: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
        """For each width the responses at every place of the padded texts."""
        out, at = [], 0
        for w in WIDTHS:
            total = gathered(tables[at], ids)
            for j in range(1, w):
                total[:-j] += gathered(tables[at + j], ids[j:])
            out.append(within(total, begin, w))
            at += w
        return out

    def tables(self) -> list[np.ndarray]:
        return [self.embedding @ f for f in self.filters]

    def logits(self, ids: np.ndarray, begin: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pooled = [np.maximum(np.maximum.reduceat(r, begin[:-1], axis=0) + b, 0) for r, b in zip(self.responses(ids, begin, tables), self.bias, strict=True)]
        # Row by row, so that a score does not depend on the size of its batch.
        return (np.concatenate(pooled, axis=1) * self.out).sum(axis=1) + self.shift

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(logits), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.a * logits.astype(np.float64) + self.b, -50, 50)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """Train on the padded word ids of texts; the embeddings start from log odds."""
        rng = np.random.default_rng(seed)
        counts = np.zeros((2, BUCKETS + 1))
        for d, y in zip(docs, labels, strict=True):
            counts[int(y), np.unique(d)] += 1
        n = np.bincount(labels, minlength=2)
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        seen = counts.sum(axis=0)
        self.embedding[:, 0] = np.where(seen > 0, odds * seen / (seen + SHRINK), 0)
        self.embedding[PAD] = 0
        self.bias[0, 0] = -1.0
        cat = np.concatenate(self.filters, axis=1)
        moments: dict[str, list] = {}

        def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int, rate: float = 3e-3) -> None:
            m = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.001 * (grad * grad - m[1])
            value -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)

        squares = np.zeros(BUCKETS + 1, np.float32)
        shift = np.zeros(1, np.float32)
        t = 0
        for _ in range(EPOCHS):
            for at in range(0, len(docs), BATCH):
                if at == 0:
                    order = rng.permutation(len(docs))
                t += 1
                picked = order[at : at + BATCH]
                sizes = np.array([len(docs[i]) for i in picked])
                ids = np.concatenate([docs[i] for i in picked])
                begin = np.concatenate([[0], np.cumsum(sizes)])
                vectors = gathered(self.embedding, ids)
                raw = vectors @ cat
                k, best, value = 0, [], []
                for w, b in zip(WIDTHS, self.bias, strict=True):
                    r = raw[:, k * FILTERS : (k + 1) * FILTERS].copy()
                    for j in range(1, w):
                        r[:-j] += raw[j:, (k + j) * FILTERS : (k + j + 1) * FILTERS]
                    r = within(r, begin, w)
                    where = np.stack([begin[d] + r[begin[d] : begin[d + 1]].argmax(axis=0) for d in range(len(picked))])
                    best.append(where)
                    value.append(np.take_along_axis(r, where, axis=0) + b)
                    k += w
                z = np.concatenate(value, axis=1)
                hidden = np.maximum(z, 0)
                logit = hidden @ self.out + shift[0]
                miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[picked]).astype(np.float32) / len(picked)
                g_out = hidden.T @ miss
                g_z = np.outer(miss, self.out) * (z > 0)
                g_cat = np.zeros_like(cat)
                g_bias = np.zeros_like(self.bias)
                rows, grads = [], []
                k = 0
                for n_w, (w, where) in enumerate(zip(WIDTHS, best, strict=True)):
                    g = g_z[:, n_w * FILTERS : (n_w + 1) * FILTERS]
                    g_bias[n_w] = g.sum(axis=0)
                    for j in range(w):
                        place = np.minimum(where + j, len(ids) - 1)
                        block = slice((k + j) * FILTERS, (k + j + 1) * FILTERS)
                        g_cat[:, block] = np.einsum("dfe,df->ef", vectors[place], g)
                        change = (g[:, :, None] * cat[:, block].T[None]).reshape(-1, EMBEDDING)
                        for column in range(ids.shape[1]):
                            rows.append(ids[place, column].ravel())
                            grads.append(change)
                    k += w
                adam("cat", cat, g_cat, t)
                adam("bias", self.bias, g_bias, t)
                adam("out", self.out, g_out, t)
                adam("shift", shift, np.array([miss.sum()], np.float32), t)
                who, back = np.unique(np.concatenate(rows), return_inverse=True)
                change = np.zeros((len(who), EMBEDDING), np.float32)
                np.add.at(change, back, np.concatenate(grads))
                squares[who] += (change * change).sum(axis=1)
                self.embedding[who] -= 0.05 * change / (np.sqrt(squares[who])[:, None] + 1e-6)
                self.embedding[PAD] = 0
        self.filters = [cat[:, i * FILTERS : (i + 1) * FILTERS] for i in range(len(NAMES))]
        self.shift = shift[0]
        self.trained = True

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> None:
        """Logistic fit of the labels on the logits, each as often as its weight, with a weak pull to (1, 0)."""
        x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (weights * (p - labels)) + 0.5 * (w - np.array([1.0, 0.0]))
            curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
            step = np.linalg.solve(curve, grad)
            w -= np.clip(step, -2, 2)
            if abs(step).max() < 1e-9:
                break
        self.a, self.b = max(0.05, float(w[0])), float(w[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float = CUT) -> float:
    """The threshold with the best F1, the middle of the gap if several do equally."""
    return histogram_threshold(scores, scores, np.ones(len(scores)), labels, default)


def histogram_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, toxic: np.ndarray, default: float = CUT) -> float:
    """As ``best_threshold``, of bins with their least and largest score, rows and toxic rows."""
    if not toxic.sum():
        return default
    order = np.lexsort((-low, -high))
    low, high, n, toxic = low[order], high[order], n[order], toxic[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    last = np.append(low[:-1] > high[1:], True)  # equal scores stand or fall together
    f1 = np.where(last, f1, -1)
    i = int(f1.argmax())
    below = high[i + 1] if i + 1 < len(high) else 0.0
    return float((low[i] + below) / 2)


def known_labels(labels: DataFrame, label: str, key: str, max_rows: int) -> DataFrame:
    """All labels as a stored table (_key, h, y, sampled): a hash samples about ``max_rows`` of them."""
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.col(f"`{label}`").cast("int").alias("y"))
    known = stored(known.filter(F.col("y").isin(0, 1)), "labels")
    n = known.count()
    sampled = F.lit(True) if n <= max_rows else F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * max_rows / n)
    return known.withColumn("sampled", sampled)


def labelled(docs: DataFrame, known: DataFrame, text: str, key: str) -> DataFrame:
    """Texts of the sampled labels, as a stored table (h, text, y).

    The sample is taken before the join, so what is broadcast has a bound and the
    texts are not shuffled.
    """
    met = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(met.join(small_side(stored(known.filter("sampled"), "sample")), F.col("_id") == F.col("_key")).select("h", "text", "y"), "labelled")


def kept_back(h: np.ndarray) -> np.ndarray:
    """Which of the sampled rows are not trained on."""
    return (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(6) == 0


def histograms(docs: DataFrame, known: DataFrame, net: Net, text: str, key: str, lang: str) -> pa.Table:
    """(lang, bin, n, toxic, low, high) of the logits of all rows of ``known``, in order.

    Many labels are joined after scoring, so the texts are not shuffled then either.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.tables(), net.bias, net.out, net.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, *weights = shared.value
        own = Net.__new__(Net)
        own.bias, own.out, own.shift = weights
        for piece in slices(batches, "text"):
            logits = own.logits(*word_ids(piece.column("text")), tables).astype(np.float64)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column("lang"), pa.array(logits)], [piece.schema.names[0], "lang", "logit"])

    known = stored(known.select("_key", "y"), "known")
    met = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    side = small_side(known)
    same = F.col("_id") == F.col("_key")
    if side is known:
        scored = met.mapInArrow(run, f"_id {met.schema['_id'].dataType.simpleString()}, lang string, logit double").join(known, same)
    else:
        scored = met.join(side, same).select("y", "lang", "text").mapInArrow(run, "y int, lang string, logit double")
    binned = F.floor(F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), "logit")) * BINS).alias("bin")
    out = scored.groupBy("lang", binned).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.min("logit").alias("low"), F.max("logit").alias("high"))
    return out.toArrow().sort_by([("lang", "ascending"), ("bin", "ascending")])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", lang: str = "lang", max_rows: int = MAX_TRAIN_ROWS, max_words: int = MAX_TRAIN_WORDS) -> tuple[Net, dict[str, float]]:
    """The classifier and the thresholds by language ("" for all) from labels of documents.

    If there are more rows or words than the bounds, a hash of the id picks a
    share of the rows to train on; each row taken counts whole.  What comes to the
    driver is at most about ``max_words`` words' bucket numbers, and histograms.
    All labelled rows that are not trained on make the scale and the thresholds.
    """
    known = known_labels(labels, label, key, max_rows)
    some = labelled(docs, known, text, key)
    (size,) = some.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(1.0, max_words * 5 / max(size, 1))
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * share))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            ids, begin = word_ids(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("h"), piece.column("y"), pa.array([ids[a:b].astype("<i4").tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], ["h", "y", "ids"])

    table = some.mapInArrow(hashed, "h long, y int, ids binary").toArrow().sort_by("h").combine_chunks()
    labels = table.column("y").to_numpy().astype(np.int64)
    net = Net()
    net.rate = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return net, {"": CUT}
    rows = [np.frombuffer(x, "<i4").reshape(-1, 1 + len(PREFIXES)) for x in table.column("ids").to_pylist()]
    h = table.column("h").to_numpy()
    kept = kept_back(h)
    if len(set(labels[kept].tolist())) < 2 or len(set(labels[~kept].tolist())) < 2:
        kept = np.zeros(len(rows), bool)
    net.fit([d for d, k in zip(rows, kept, strict=True) if not k], labels[~kept])
    held = docs.sparkSession.createDataFrame(pa.table({"h": np.unique(h[~kept])}))
    both = lambda t: 0 < sum(t.column("toxic").to_pylist()) < sum(t.column("n").to_pylist())
    bins = histograms(docs, known.join(F.broadcast(held), "h", "left_anti"), net, text, key, lang)
    if not both(bins):
        bins = histograms(docs, known, net, text, key, lang)
    n, toxic, low, high = (bins.column(c).to_numpy().astype(np.float64) for c in ("n", "toxic", "low", "high"))
    middle = (low + high) / 2
    net.calibrate(np.concatenate([middle, middle]), np.repeat([1.0, 0.0], len(n)), np.concatenate([toxic, n - toxic]))
    low, high = net.probability(low), net.probability(high)
    # Bins of all languages are one where they are the same part of the scale.
    place, at = np.unique(bins.column("bin").to_numpy(), return_inverse=True)
    least, most = np.full(len(place), np.inf), np.full(len(place), -np.inf)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    thresholds = {"": histogram_threshold(least, most, np.bincount(at, n), np.bincount(at, toxic))}
    langs = np.array(bins.column("lang").to_pylist())
    for one in sorted(set(langs.tolist()) - {""}):
        mine = langs == one
        if min(toxic[mine].sum(), (n - toxic)[mine].sum()) >= LEAST_LABELS:
            thresholds[one] = histogram_threshold(low[mine], high[mine], n[mine], toxic[mine])
    return net, thresholds


def score(docs: DataFrame, net: Net, thresholds: dict[str, float], text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` with score, from the text alone, and flagged: whether it reaches its language's threshold."""
    rest = [c for c in docs.columns if c not in ("score", "flagged")]
    # Only the tables leave the driver: (buckets + 1) x filters numbers for each width and place.
    shared = docs.sparkSession.sparkContext.broadcast((net.tables(), net.bias, net.out, net.shift, net.a, net.b, net.rate, net.trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, *weights = shared.value
        own = Net.__new__(Net)
        own.bias, own.out, own.shift, own.a, own.b, own.rate, own.trained = weights
        for piece in slices(batches, text):
            ids, begin = word_ids(piece.column(text))
            scores = own.probability(own.logits(ids, begin, tables))
            langs = piece.column(lang).to_pylist() if lang in rest else [None] * piece.num_rows
            flagged = [bool(s >= thresholds.get(x or "", thresholds[""])) for s, x in zip(scores, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*piece.select(rest).columns, pa.array(scores, pa.float64()), pa.array(flagged, pa.bool_())], [*rest, "score", "flagged"])

    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL("score double, flagged boolean").fields))
