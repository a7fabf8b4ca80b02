"""The operators over the tables they are meant for, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.llm import chat, decontam, flac, langid, mixing, neardup, pii, suffix, tokenfile, toxicity
from sparkgrid.scratch import stored

#: The key of the pseudonyms; a deployment passes its own secret.
PSEUDONYM_KEY = b"sparkgrid-example-key"
VOCABULARY = "byte_bpe_50k.json"
#: Samples of a frame of a text's stream.
FRAME = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=4)


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs.filter(~out))
    return langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "n_found", F.to_json("kinds").alias("kinds"), "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out)
    net, thresholds = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", out.alias("held_out"), "text", "lang"), net, thresholds)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "flagged")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.summaries(flac.keep(table(spark, sf_dir, "documents"), block=FRAME))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    # The sizes are stored, so the texts are read once.
    mixed = mixing.mix(stored(docs.withColumnRenamed("size", "words"), "sizes"), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_rotation, op2_near_duplicates, op3_repeated_strings, op4_language_id, op5_pseudonyms, op6_toxicity, op7_token_file, op8_flac, op9_decontamination, op10_source_mixing)
}

ORACLE_SQL = {
    "op1_chat_rotation": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
        ), seen AS (
            SELECT s.conv_id, p.perspective, s.turn, s.role, s.text,
                CASE WHEN s.role = p.perspective THEN '<|assistant|>' ELSE '<|user:' || s.role || '|>' END
                    || chr(10) || s.text || '<|end|>' || chr(10) AS rendered,
                (s.role = p.perspective)::INT AS mask
            FROM said s JOIN (SELECT DISTINCT conv_id, role AS perspective FROM said) p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
        )
        SELECT conv_id, perspective, row_number() OVER w AS seq, turn, role, rendered,
            (sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) - length(rendered))::BIGINT AS begin_char,
            length(rendered)::BIGINT AS n_chars, mask
        FROM seen
        WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
    """,
    "op2_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM d
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), named AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
        )
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM named LEFT JOIN sizes USING (doc_id)
    """,
    "op9_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win, least(len(w), 8) AS k
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)
        ), starts AS (
            SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM windows)
            WHERE i + k - 1 <= len(w)
        ), hits AS (
            SELECT s.doc_id, s.i, s.k, x.item FROM starts s JOIN windows x ON s.win = x.win AND s.k = x.k
        ), items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
        ), places AS (
            SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits)) GROUP BY 1
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
            sha256(coalesce(t.all_items, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
        FROM d LEFT JOIN items t USING (doc_id) LEFT JOIN places p USING (doc_id)
    """,
    "op10_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS n, list_value(5, 2, 1)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
            FROM d GROUP BY source
        ), stacked AS (
            SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weight,
                sum(3 * n) OVER o - 3 * n AS caps, sum(w) OVER o - w AS ws
            FROM s WINDOW o AS (ORDER BY 3 * n * (10 // w), source NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), marked AS (
            SELECT *, (3 * n)::HUGEINT * (weight - ws) <= w * (total - caps) AS stops FROM stacked
        ), spent AS (
            SELECT coalesce(sum(3 * n) FILTER (stops), 0) AS used, coalesce(sum(w) FILTER (stops), 0) AS heavy FROM marked
        ), targets AS (
            SELECT source, n, CASE WHEN stops THEN (3 * n)::DOUBLE
                ELSE (w * (total - used))::DOUBLE / greatest(1, weight - heavy)::DOUBLE END AS target FROM marked, spent
        ), drawn AS (
            SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
                ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, n AS source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM drawn
    """,
}
