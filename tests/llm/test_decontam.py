import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkgrid.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontam.CAPITALS, decontam.SMALL)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=8):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[k : k + n]) in wins and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def run(spark, documents, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontam.contamination(documents([d[:2] for d in docs]), table).collect()), key=repr)


def test_random_texts(spark, documents):
    rng = random.Random(4)
    vocabulary = ["the", "of", "é1", "Ab", "x", "y2", "zz"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 8, 9, 14])))) for k in range(12)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=30)) + ". " + (rng.choice(items)[1] or "")) for k in range(40)]
    assert run(spark, documents, docs, items) == brute(docs, items)


def test_odd_rows(spark, documents, odd_rows):
    docs = [r[:2] for r in odd_rows]
    items = [(1, "two words"), (2, None), (None, "ONE"), (3, ""), (1, "word1 word2 word3 word4 word5 word6 word7 word8 word9"), (4, "Two, words!")]
    assert run(spark, documents, docs, items) == brute(docs, items)
    assert run(spark, documents, [], items) == []
    assert run(spark, documents, docs, []) == brute(docs, [])


def test_clashing_columns(spark, documents):
    docs = documents([(1, "a b c")]).withColumns({"uid": F.lit("u"), "terms": F.lit("t"), "n_words": F.lit("n"), "wid": F.lit(3)})
    items = spark.createDataFrame([(5, "b c", "clash")], "item_id long, text string, wid string")
    assert decontam.contamination(docs, items).first()["n_hit"] == 2


def test_proximity(spark, documents):
    docs = documents([(1, "red x fox"), (2, "fox a b c d red"), (3, "fox red"), (4, "red red red")])
    index = decontam.build_index(docs)
    items = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    near = decontam.proximity(index, decontam.rare_first(index, decontam.test_windows(items)[0]), span=3)
    assert sorted(r[0] for r in near.join(decontam.documents(index), "uid").select("doc_id").distinct().collect()) == [1, 3]


def test_proximity_against_brute_force(spark, documents):
    rng = random.Random(12)
    vocabulary = ["the", "of", "é1", "ab", "x", "y2", "zz"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 3, 4, 4, 9])]
    docs = [(k, " ".join(rng.choices(vocabulary, k=25))) for k in range(30)]
    wins = {tuple(w[k : k + 8]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 7))}
    index = decontam.build_index(documents(docs))
    ranked = decontam.rare_first(index, decontam.test_windows(spark.createDataFrame(items, "item_id long, text string"))[0])
    rarest = {r["wid"]: r["lists"][0]["term"] for r in ranked.collect()}
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    hashes = {r["h"]: r["w"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    sets = {r["wid"]: frozenset(hashes[x["term"]] for x in r["lists"]) for r in ranked.collect()}
    assert set(sets.values()) == {frozenset(w) for w in wins}
    expected = set()
    for doc_id, text in docs:
        w = words(text)
        for wid, wanted in sets.items():
            for p, word in enumerate(w):
                if word == hashes[rarest[wid]] and any(wanted <= set(w[s : s + 5]) for s in range(max(0, p - 4), p + 1)):
                    expected.add((doc_id, wid, p))
    near = decontam.proximity(index, ranked, span=5).join(decontam.documents(index), "uid")
    rows = [(r["doc_id"], r["wid"], r["pos"]) for r in near.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and expected


def test_postings_lie_by_term(spark, documents):
    index = decontam.build_index(documents([(k, f"w{k} of the w{k + 1}") for k in range(50)] + [(99, None)]).repartition(3))
    shards = index.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "term", "uid", "pos").collect()
    by_file = {}
    for r in sorted(shards, key=lambda r: r["at"]):
        by_file.setdefault(r["f"], []).append(r["term"])
    assert all([t for t in x if t is not None] == sorted(t for t in x if t is not None) for x in by_file.values())
    assert sorted((r["doc_id"], r["n_words"]) for r in decontam.documents(index).collect()) == [*((k, 4) for k in range(50)), (99, 0)]


def test_blocks_hold_everything(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 3)
    items = [(k, f"alpha beta gamma delta w{k}") for k in range(9)]
    docs = [(k, f"so alpha beta gamma delta w{k} it is") for k in range(9)]
    assert run(spark, documents, docs, items) == brute(docs, items)


def test_native(spark, documents):
    items = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    plan = decontam.contamination(documents([(1, "a red fox")]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
