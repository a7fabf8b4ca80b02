import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkgrid.llm import neardup
from sparkgrid.llm.arrowtext import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[n : n + k]) for n in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, hundredths=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= hundredths * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    out = []
    for n, (i, _) in enumerate(rows):
        c = least.get(find(n), i)
        out.append((i, len(sets[n]), c, i == c))
    return sorted(out, key=repr)


def edited(rng, words, rate):
    return [f"n{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))] for _ in range(25)]
    rows, n = [], 0
    for words in base:
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((n, " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.1])))))
            n += 1
    hub = [f"h{k}" for k in range(100)]
    rows += [(1000 + k, " ".join(edited(rng, hub, 0.025))) for k in range(40)]  # linked with each other in part only
    rng.shuffle(rows)
    return rows


def run(frame, **how):
    return sorted((tuple(r) for r in neardup.groups(frame, **how).collect()), key=repr)


def test_random_corpus(spark, documents):
    rows = corpus()
    assert run(documents(rows), k=4) == brute(rows, 4)


def test_odd_rows(spark, documents, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert run(documents(rows), k=4) == brute(rows, 4)
    assert run(documents([])) == []
    clash = documents(rows).withColumns({"cid": F.lit("c"), "digest": F.lit("d"), "component_id": F.lit("x"), "id": F.lit("i")})
    assert run(clash, k=4) == brute(rows, 4)


def test_near_copies_under_null_and_repeated_ids(spark, documents):
    rng = random.Random(9)
    rows = []
    for n in range(12):
        words = [f"t{n}x{k}" for k in range(60)]
        near = [*words[:-1], "end"]
        # Pairs within null ids, within one id, between the two, and with an id of their own.
        one, other = [(None, None), (7, 7), (None, 7), (7, 100 + n)][n % 4]
        rows += [(one, " ".join(words)), (other, " ".join(near))] + [(one, " ".join(words))] * (n % 3)
    want = brute(rows, 4)
    for _ in range(2):
        rng.shuffle(rows)
        assert run(documents(rows), k=4) == want
    kept = [(r["doc_id"], r["text"].split("x")[0]) for r in neardup.keep_one(documents(rows), k=4).collect()]
    assert len(kept) == 12 and len({t for _, t in kept}) == 12


def test_keep_one(spark, documents, odd_rows):
    rows = corpus(2)
    kept = neardup.keep_one(documents(rows), k=5)
    assert kept.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, _, k in brute(rows, 5) if k)
    # Of repeated ids each component keeps one row, and texts without shingles all stay.
    left = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in neardup.keep_one(documents(odd_rows)).collect()), key=repr)
    assert left == sorted([(1, ""), (2, ""), (3, " \n\t "), (4, "one"), (4, "two words"), (None, "a row wit"), (None, ""), (7, "word0 wor"), (9, "Ünïcödé \U0001f600")], key=repr)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["cid"]: r["root"] for r in neardup.components(links).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for n, j in ((1000, 0.8), (1000, 0.3), (60, 0.9)):
        both = round(2 * n * j / (1 + j))
        hashes = mix64(rng.integers(0, 2**63, 2 * n - both).astype(np.uint64))
        a, b = hashes[:n], hashes[n - both :]
        x, y, z = neardup.sketch([a, b, hashes])
        assert (neardup.merge(x, y) == z).all()
        best, _ = neardup.likelihoods(x[None], y[None], np.array([n]), np.array([n]), 0.8)
        assert abs(best[0] - both / (2 * n - both)) < 0.12
    assert not neardup.sketch([np.zeros(0, np.uint64)]).any()


def test_blocks_of_a_bucket_meet(monkeypatch):
    rng = np.random.default_rng(5)
    base = mix64(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base, mix64(rng.integers(0, 2**63, k).astype(np.uint64))])) for k in range(0, 60, 6)]
    sketches = [r.tobytes() for r in neardup.sketch(sets)]
    whole = {"cid": list(range(10)), "root": list(range(10)), "own": [0] * 10, "n": list(map(len, sets)), "sketch": sketches, "slot": [0] * 10, "lo": [0] * 10, "hi": [0] * 10}
    pairs = lambda b: set(zip(*b.to_pydict().values(), strict=True)) if b is not None else set()
    want = pairs(neardup._compared(whole, 0.8))
    assert want == {(a, b) for a in range(10) for b in range(a + 1, 10)}
    own = [k % 2 for k in range(10)]
    part = lambda lo, hi: {c: [v for v, o in zip(values, own, strict=True) if o in (lo, hi)] for c, values in (whole | {"own": own, "lo": [lo] * 10, "hi": [hi] * 10}).items()}
    got = [pairs(neardup._compared(part(*k), 0.8)) for k in ((0, 0), (0, 1), (1, 1))]
    assert set.union(*got) == want and sum(map(len, got)) == len(want)
    linked = whole | {"root": [0] * 10}
    assert neardup._compared(linked, 0.8) is None
