import random

from pyspark.sql import functions as F

from sparkgrid.llm import langid

WORDS = {"en": "the of and that with this from have which".split(), "fr": "être qui dans pour avec été où leçon".split(), "de": "der und nicht über für straße auch".split()}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def trained(documents):
    rng = random.Random(1)
    return langid.train(documents([(k, text(rng, lang), lang) for k, lang in enumerate(list(WORDS) * 30)]))


def test_held_out_accuracy(spark, documents):
    rng = random.Random(2)
    docs = documents([(k, text(rng, lang, 8), lang) for k, lang in enumerate(list(WORDS) * 30)])
    rows = langid.predict(docs, trained(documents)).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in rows)


def test_odd_rows(spark, documents, odd_rows):
    model = trained(documents)
    docs = documents([*odd_rows, (20, "12 ² ½ !? \U0001f600"), (21, "ª")]).withColumns({"score": F.lit("mine"), "lang_pred": F.lit("x")})
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(odd_rows) + 2
    for r in rows:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == has and (r["score"] > 0) == has
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(documents([]))
    assert {r["lang_pred"] for r in langid.predict(documents(odd_rows), nothing).collect()} == {"und"}
    assert langid.train(documents([(1, None, "en"), (2, "hello", None)])).languages == []


def test_equal_texts_score_alike_in_any_company():
    model = langid.Model(["a", "b"], langid.np.random.default_rng(1).random((langid.BUCKETS, 2)) * 9)
    alone = model.predict(["hello there"])
    among = model.predict(["zz", "hello there", "", "q w"])
    assert alone[0][0] == among[0][1] and alone[1][0] == among[1][1]


def test_sample_is_bounded(spark, documents):
    rng = random.Random(1)
    docs = documents([(k, text(rng, "en", 5), "en") for k in range(400)])
    assert langid.train(docs, max_rows=50).languages == ["en"]


def plain_buckets(value):
    """Every n-gram's bucket, character by character."""
    chars, before = [32], False
    for c in value.lower():
        if c.isalpha():
            chars.append(ord(c))
        elif before:
            chars.append(32)
        before = c.isalpha()
    out = []
    for end in range(len(chars)):
        for order in langid.ORDERS:
            code = 0
            for back in range(order):
                code = ((code ^ (chars[end - back] if end >= back else 32)) * 0x9E3779B1) % 2**32
                code ^= code >> 15
            out.append(((code * 0x85EBCA6B + order) % 2**32) * langid.BUCKETS >> 32)
    return out


def test_query_against_plain_naive_bayes(spark, documents):
    import math
    from collections import Counter
    from zlib import crc32

    rng = random.Random(5)
    rows = [(k, text(rng, lang, rng.randrange(1, 12)) + rng.choice(["", "!", " 12-x"]), rng.choice([lang, None])) for k, lang in enumerate(list(WORDS) * 25)]
    rows += [(300, None, "en"), (301, "99 ?", "en"), (302, "", None)]
    frame = documents(rows)
    out = langid.held_out(F.col("doc_id"), 3, 1)
    got = {r["doc_id"]: r for r in langid.predict(frame.select("doc_id", out.alias("held_out"), "text"), langid.train(frame.filter(~out))).collect()}
    counts = {}
    for k, t, lang in rows:
        if lang and t is not None and crc32(str(k).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(plain_buckets(t))
    logs = {x: {b: math.log((c[b] + langid.SMOOTHING) / (c.total() + langid.SMOOTHING * langid.BUCKETS)) for b in range(langid.BUCKETS)} for x, c in counts.items()}
    for k, t, _ in rows:
        assert got[k]["held_out"] == (crc32(str(k).encode()) % 3 == 1)
        if not any(c.isalpha() for c in t or ""):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        total = {x: sum(table[b] for b in plain_buckets(t)) for x, table in logs.items()}
        best = max(sorted(total), key=total.get)
        posterior = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert got[k]["lang_pred"] == best and abs(got[k]["score"] - posterior) < 1e-3
