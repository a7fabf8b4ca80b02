import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkgrid.llm import suffix
from sparkgrid.llm.suffix import LENGTH


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + LENGTH] for t in texts for k in range(len(t) - LENGTH + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(frame):
    out = suffix.dedupe(frame)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()), key=repr)


def corpus():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(n) for n in (150, 180, 260, 700)]
    rows = []
    for k in range(40):
        parts = [noise(rng.randrange(0, 400))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts += [p[a : len(p) - rng.randrange(0, 60)], noise(rng.randrange(0, 30))]
        rows.append((k, "".join(parts)))
    rows += [(50, rows[3][1]), (51, "ab" * 300), (52, "x" * 199), (53, "x" * 200), (54, "x" * 201), (55, "\x00" * 250), (56, "\x00" * 210 + "q"), (57, noise(199) + "y"), (50, rows[3][1])]
    return rows


def test_random_corpus(spark, documents):
    rows = corpus()
    assert run(documents(rows).repartition(5)) == brute(rows)


def test_odd_rows(spark, documents, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert [r for r in run(documents(rows)) if r[0] not in (7, 8)] == [r for r in brute([x for x in rows if x[0] not in (7, 8)])]
    long = [r for r in run(documents(rows)) if r[0] in (7, 8)]
    assert len(long) == 2 and all(r[1] == r[2] and r[3] == 1 for r in long)
    assert run(documents([])) == []
    clash = documents(rows).withColumns({"spans": F.lit("s"), "text_hash": F.lit("h"), "gram": F.lit("g"), "_ranges": F.lit("r"), "_doc": F.lit("d"), "_hash": F.lit("x")})
    assert run(clash) == run(documents(rows))
    out = suffix.dedupe(clash).select("text_hash", "gram", "_ranges", "_doc", "_hash").distinct().collect()
    assert [tuple(r) for r in out] == [("h", "g", "r", "d", "x")]


def test_family_of_levels():
    rng = random.Random(2)
    pool = [bytes(rng.choice(b"ab") for _ in range(LENGTH + 5)) for _ in range(6)]
    texts = [rng.choice(pool)[: LENGTH + rng.randrange(6)] for _ in range(60)]
    counts = [len(t) - LENGTH + 1 for t in texts]
    family = suffix.Family()
    for at in range(0, 60, 7):
        family.add(texts[at : at + 7], counts[at : at + 7])
    sizes = [len(level[1]) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    strings = [t[k : k + LENGTH] for t, n in zip(texts, counts, strict=True) for k in range(n)]
    seen = Counter(strings)
    assert family.flags().tolist() == [seen[s] > 1 for s in strings]


def test_parts_of_long_texts_choose_alike(monkeypatch):
    data = np.frombuffer(bytes(random.Random(5).choice(b"abcdef") for _ in range(5000)), np.uint8)
    whole = suffix.stretches(data)
    monkeypatch.setattr(suffix, "PART", 1024)
    parts = suffix.stretches(data)
    anchors = lambda s: {p: a for f, e, a in zip(*s[:3], strict=True) for p in range(f, e + 1)}
    assert anchors(whole) == anchors(parts)
