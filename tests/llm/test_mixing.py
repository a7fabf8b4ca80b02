from collections import defaultdict

from pyspark.sql import functions as F

from sparkgrid.llm import mixing


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by the rule itself: share, stop at the cap, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > cap * sizes[s] or sizes[s] == 0]
        if not over:
            return done | {s: weight[s] * level for s in free}
        done |= {s: float(cap * sizes[s]) for s in over}


def mixed(frame):
    return mixing.mix(frame, mixing.word_count(F.col("text")))


def test_targets(spark, documents):
    for k, sizes in enumerate([{"a": 5, "b": 900, "c": 3, None: 40}, {"x": 7}, {"é": 10, "z": 0, "A": 200, "b": 1, "c": 1, "d": 1}, {}]):
        docs = documents([(100 * k + n, " w" * size, "en", s) for n, (s, size) in enumerate(sizes.items())])
        got = {r["source"]: r["target"] for r in mixed(docs).collect()}
        want = shares(sizes) if sizes else {}
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_copies(spark, documents):
    docs = documents([(n, "w " * (1 + n % 7), "en", "ab"[n % 10 == 0]) for n in range(3000)])
    rows = mixed(docs).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in mixed(docs.repartition(7)).collect())
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
    out = mixing.emit(docs, mixing.word_count(F.col("text")))
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in rows)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    rows = mixed(docs).collect()
    assert len(rows) == len(odd_rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    assert {r["size"] for r in rows if r["text"] is None or not r["text"].strip()} == {0}
    assert mixing.emit(docs.limit(0), F.lit(1)).count() == 0


def test_clashing_columns(spark, documents):
    docs = documents([(1, "a b", "en", "s"), (2, "c", "en", "t")]).withColumns({"size": F.lit("mine"), "copies": F.lit("own"), "rate": F.lit("r")})
    out = mixing.emit(docs, mixing.word_count(F.col("text"))).collect()
    assert out and {(r["size"], r["copies"], r["rate"]) for r in out} == {("mine", "own", "r")}
    assert {r["size"] for r in mixed(docs).collect()} == {1, 2}
