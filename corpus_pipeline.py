"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.llm import decontam, langid, mixing, neardup, tokenfile
from sparkgrid.scratch import small_side, stored, unused

#: A text whose language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labels of this input teach.

    Texts that are null, empty or without a letter go; equal texts and repeated
    rows share their fate; a null id, language or source changes nothing, but rows
    without a language teach none; of an input that teaches no language nothing
    is left; every column of the input stays, whatever its name.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"), 3, 1)))
    apart = {c: unused(f"_{c}", docs.columns) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    told = langid.predict(docs.withColumnsRenamed(apart), model)
    kept = told.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({b: a for a, b in apart.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more.

    Null, empty and blank texts have no copies and stay; of equal texts the row
    with the least id stays, of rows that repeat an id or have none one of each
    group; long texts count whole; an empty input stays empty; every column of the
    input stays, whatever its name.
    """
    return neardup.keep_one(docs, k=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: one passage is a leak.

    Null and empty texts and those without words stay; a row is judged by its own
    text, also where an id is null or repeated; without items, or items with words,
    all stay; every column of the input stays, whatever its name.
    """
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", "text", mark.alias("mark"))
    dirty = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id", "mark"))
    own = [unused(c, docs.columns) for c in ("_id", "_mark")]
    dirty = small_side(dirty.toDF(*own))
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col(own[0])) & (mark == F.col(own[1])), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A null, empty or blank text has size 0 and adds nothing to its source; a null
    source is one of its own; rows that repeat an id are taken alike, rows without
    one as the text ``null`` would be; an empty input stays empty; every column of
    the input stays, whatever its name.
    """
    return mixing.emit(docs, mixing.word_count(F.col("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the block format and read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is just the end id; a null id comes first, rows that
    repeat one follow each other; other columns are ignored; an empty input gives
    no row.
    """
    return tokenfile.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source mixing", mix),
    ("token output", tokens),
]

#: Language ID has no SQL, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
