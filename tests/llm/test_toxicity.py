import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkgrid.llm import toxicity

BAD = ["vilestem" + s for s in ("er", "ing", "ed", "ous")]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(10, 80))]
        toxic = k % 7 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + "!!")
        docs.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def fitted(spark, documents, n=700):
    docs, labels = corpus(n, 1)
    return toxicity.train(documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_LABELS", 5)
    net, thresholds = fitted(spark, documents)
    docs, labels = corpus(300, 2)
    rows = toxicity.score(documents(docs), net, thresholds).collect()
    right = sum((r["score"] >= 0.3) == bool(labels[r["doc_id"]][2]) for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and set(thresholds) == {"", "en"}
    unseen = toxicity.score(documents([(1, "w1 w2 VILESTEMish w3"), (2, "w1 w2 w3")]), net, thresholds)
    got = {r["doc_id"]: r["score"] for r in unseen.collect()}
    assert got[1] > got[2]


def test_odd_rows(spark, documents, odd_rows):
    net, thresholds = fitted(spark, documents, 200)
    docs = documents(odd_rows).withColumns({"score": F.lit("mine"), "flagged": F.lit("f"), "ids": F.lit("i")})
    rows = toxicity.score(docs, net, thresholds).collect()
    assert len(rows) == len(odd_rows) and len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(docs.limit(0), net, thresholds).count() == 0
    assert toxicity.score(docs.drop("lang", "score", "flagged"), net, thresholds).count() == len(odd_rows)


def test_without_both_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    net, thresholds = toxicity.train(documents([(1, "a b")]), none)
    assert toxicity.score(documents([(1, "a b")]), net, thresholds).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    net, thresholds = toxicity.train(documents([(1, "a b"), (2, "c")]), one)
    assert toxicity.score(documents([(1, "a b")]), net, thresholds).first()["score"] == 0.0


def test_scores_do_not_depend_on_company():
    net = toxicity.Net()
    tables = net.tables()
    texts = ["", "one", "Two words", "a longer text of some words"]
    together = net.logits(*toxicity.word_ids(pa.array(texts)), tables)
    alone = [net.logits(*toxicity.word_ids(pa.array([t])), tables)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_thresholds():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([0.9, 0.8]), np.array([0, 0])) == toxicity.CUT
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.1]), np.array([1, 0, 0])) == 0.3


def test_thresholds_of_histograms():
    low, high = np.array([0.8, 0.4, 0.1]), np.array([0.9, 0.6, 0.2])
    assert abs(toxicity.histogram_threshold(low, high, np.array([5, 1, 50]), np.array([5, 1, 0])) - 0.3) < 1e-12
    # Bins that share a score stand or fall together.
    assert toxicity.histogram_threshold(np.array([1.0, 1.0, 0.1]), np.array([1.0, 1.0, 0.2]), np.array([5, 5, 9]), np.array([5, 0, 0])) == 0.6


def test_thresholds_cover_labels_beyond_the_sample(spark, documents, monkeypatch):
    docs, labels = corpus(1400, 1)
    docs = [(k, t, "es" if k % 5 == 0 else "en", s) for k, t, _, s in docs]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # 40 toxic rows of es in all; a sixth of a sample of 300 rows has one or two.
    net, thresholds = toxicity.train(documents(docs), known, max_rows=300)
    assert set(thresholds) == {"", "en", "es"}
    seen = {r["doc_id"]: r["flagged"] for r in toxicity.score(documents(docs), net, thresholds).collect()}
    assert sum(seen[k] == bool(y) for k, _, y in labels) >= 0.9 * len(labels)
    # The same where the labels are too many to be broadcast.
    monkeypatch.setattr(toxicity, "small_side", lambda df: df)
    _, shuffled = toxicity.train(documents(docs), known, max_rows=300)
    assert shuffled.keys() == thresholds.keys() and all(abs(shuffled[k] - thresholds[k]) < 1e-6 for k in shuffled)


def plain_score(net, text):
    """The forward pass word by word: embeddings, filters at every place, the largest response of each, a sum."""
    words = "".join(c if c.encode()[0] >= 128 or c.isascii() and c.isalnum() else " " for c in text).split()
    vectors = []
    for word in words:
        pieces = [word] + [word.encode()[:n] for n in toxicity.PREFIXES if len(word.encode()) > n]
        ids, _ = toxicity.word_ids(pa.array([word]))
        buckets = [b for b in ids[0].tolist() if b != toxicity.PAD]
        assert len(buckets) == len(pieces)
        vectors.append(sum(net.embedding[b].astype(float) for b in buckets))
    vectors += [np.zeros(toxicity.EMBEDDING)] * max(toxicity.WIDTHS)
    pooled, at = [], 0
    for width, bias in zip(toxicity.WIDTHS, net.bias, strict=True):
        responses = [sum(vectors[p + j] @ net.filters[at + j].astype(float) for j in range(width)) for p in range(len(vectors) - width + 1)]
        pooled += np.maximum(np.max(responses, axis=0) + bias, 0).tolist()
        at += width
    logit = float(np.dot(pooled, net.out) + net.shift)
    return 1 / (1 + np.exp(-(net.a * logit + net.b)))


def test_query_against_a_plain_forward_pass(spark, documents):
    net, thresholds = fitted(spark, documents, 300)
    docs, _ = corpus(40, 9)
    docs += [(900, "", "en", "s"), (901, None, "xx", "s"), (902, "one", None, "s"), (903, "Ünïcödé, VILESTEMed! \U0001f600 it's", "en", "s")]
    rows = toxicity.score(documents(docs), net, thresholds).collect()
    for r in rows:
        expected = plain_score(net, r["text"] or "")
        assert abs(r["score"] - expected) < 1e-4
        assert r["flagged"] == (r["score"] >= thresholds.get(r["lang"] or "", thresholds[""]))
