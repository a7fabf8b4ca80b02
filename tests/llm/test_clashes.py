"""Extra columns that bear any name the operators use inside, or one that needs quoting."""

import re
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkgrid import scratch
from sparkgrid.llm import decontam, flac, langid, mixing, neardup, pii, suffix, tokenfile, toxicity

OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def inner_names():
    """Every alias, added column and schema field in the modules, and a few odd ones."""
    found = {"a b", "a:b", "id", "row", "_score", "_lang_pred"}
    for folder in (Path(scratch.__file__), *Path(neardup.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)):
        code = folder.read_text()
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|select|groupBy|col)\((?:"\w+", )?"(\w+)"', code))
        found |= set(re.findall(r'"(\w+)"', code)) & set(re.findall(r'"(_\w+)"', code))
        for schema in re.findall(r'"(\w+ (?:long|int|string|binary)(?:, `?\w+`? [\w<>:,]+)+)"', code):
            found |= {f.split()[0].strip("`") for f in schema.split(", ")}
    lower = {}
    for name in sorted(found - OWN):
        lower.setdefault(name.lower(), name)
    return [n for k, n in lower.items() if k not in OWN]


@pytest.fixture(scope="module")
def clash(spark, documents):
    copy = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf " * 4
    rows = [(k, f"{copy} {k % 2}", "en", "s") for k in range(4)] + [(9, "ein kurzer text", "de", "t"), (None, None, None, None), (9, copy, "en", None)]
    plain = documents(rows)
    names = inner_names()
    assert {"_source", "_ranges", "_doc", "_id", "_score", "_mark"} <= set(names)
    return plain, plain.select("*", *[F.lit(f"own {n}").alias(n) for n in names]), names


def same(clash, run, replaced=(), passes=True):
    """The operator's result is that without the columns, which pass through where it is one that keeps rows."""
    plain, wide, names = clash
    a, b = run(plain), run(wide)
    got = b.collect()
    assert sorted(repr(tuple(r[c] for c in a.columns)) for r in got) == sorted(repr(tuple(r)) for r in a.collect())
    if passes:
        left = [n for n in names if n not in replaced]
        assert {tuple(r[n] for n in left) for r in got} == {tuple(f"own {n}" for n in left)}


def test_mixing(clash):
    words = mixing.word_count(F.col("text"))
    same(clash, lambda d: mixing.mix(d, words), mixing.COLUMNS)


def test_suffix(clash):
    same(clash, suffix.dedupe, suffix.ADDED)


def test_near_duplicates(clash):
    same(clash, neardup.groups, passes=False)


def test_language(clash):
    model = langid.train(clash[0])
    same(clash, lambda d: langid.predict(d, model), ("lang_pred", "score"))


def test_toxicity(spark, clash):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    net, thresholds = toxicity.train(clash[1], labels)
    same(clash, lambda d: toxicity.score(d, net, thresholds), ("score", "flagged"))


def test_pseudonyms(clash):
    same(clash, lambda d: pii.pseudonymise(d, b"k"), ("n_found", "kinds"))


def test_operators_that_ignore_columns(spark, clash):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    wide = items.select("*", *[F.lit("x").alias(n) for n in clash[2] if n != "item_id"])
    same(clash, lambda d: decontam.contamination(d, items if d is clash[0] else wide), passes=False)
    path = public_tokenizers.path("byte_bpe_50k.json")
    same(clash, lambda d: tokenfile.encode_documents(d, path), passes=False)
    same(clash, lambda d: flac.summaries(flac.keep(d)), passes=False)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, clash, tmp_path, name, stage):
    spark.createDataFrame([(1, "ein kurzer text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same(clash, lambda d: stage(spark, d, str(tmp_path)), passes=stage is not corpus_pipeline.tokens)
