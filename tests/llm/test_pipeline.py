import math
import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_decontam import words
from tests.llm.test_mixing import shares
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_neardup import corpus
from tests.llm.test_tokenfile import brute as token_brute


def fixture(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 4}") for i, t in corpus(7)]
    item = " ".join(f"q{k}" for k in range(12))
    rows += [(2000, "w1 w2 " + item + " w3", "en", "s1"), (2001, "1234 !!", "en", "s2"), (2002, None, "en", "s2"), (2003, "", None, None)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "something else of eight words or more it is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {i for i, _, _, k in near_brute([r[:2] for r in lettered], 5) if k}
    clean = [r for r in lettered if r[0] in kept and r[0] != 2000]
    size = {r[0]: len((r[1] or "").split()) for r in clean}
    total = {}
    for r in clean:
        total[r[3]] = total.get(r[3], 0) + size[r[0]]
    targets = shares(total)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    times = {}
    for r in got:
        times[r[0]] = times.get(r[0], 0) + 1
    for r in clean:
        rate = targets[r[3]] / total[r[3]]
        assert times.get(r[0], 0) in {math.floor(rate + 1e-12), math.floor(rate - 1e-12) + 1}
    assert set(times) <= {r[0] for r in clean} and words("Q1 q2") == ["q1", "q2"]
    expanded = [(i, t) for i, t, *_ in clean for _ in range(times.get(i, 0))]
    assert sorted(got) == sorted(token_brute(expanded))


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    clash = docs.withColumns({"score": F.lit("s"), "lang_pred": F.lit("l"), "size": F.lit("z")})
    out = corpus_pipeline.language(spark, clash, str(tmp_path))
    assert out.columns == clash.columns and out.first()["score"] == "s"
