"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed for each source; each source gets a target, from which its
repetition rate follows; a document comes out floor(rate) times and once more if
a hash of its id falls below the fraction of the rate.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a source without words has target and rate 0; a row whose id is
null draws as the text ``null`` would; rows that repeat an id all draw alike.
Columns of the input that bear the name of one of ``COLUMNS`` are replaced by
``mix`` and kept by ``emit``; any others pass through.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.scratch import ordered_prefix, stored, unused

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = ("size", "source_size", "target", "rate", "copies")
#: 52 bits of a hash make the draw, which a double holds exactly.
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(per_source: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets of a table (source, source_size), one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn.  All of
    the sizes are shared out by weight; a source stops at ``cap`` times its own
    size and what it leaves is shared again.  The fixed point of that is found
    without a loop: in the order of cap / weight, a source stops exactly if the
    level that holds once all before it have stopped would lift it to its cap.
    """
    spark = per_source.sparkSession
    ranked = ordered_prefix(per_source, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)}, "mix-rank")
    turn = F.get(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights)).cast("int"))
    capped = ranked.select("source", "source_size", turn.cast("long").alias("_w"), (F.col("source_size") * cap).alias("_cap"))
    scale = 1
    for w in weights:
        scale *= w
    level = F.col("_cap").cast("decimal(38,0)") * (F.lit(scale) / F.col("_w")).cast("decimal(9,0)")
    stacked = stored(
        ordered_prefix(capped, [level], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, "mix-level"), "mix-levels"
    )
    total, weight = stacked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    wide = lambda c: c.cast("decimal(38,0)")
    left = F.lit(total) - (F.col("_caps") - F.col("_cap"))
    stops = wide(F.col("_cap")) * wide(F.lit(weight) - (F.col("_ws") - F.col("_w"))) <= wide(F.col("_w")) * wide(left)
    marked = stacked.withColumn("_stops", stops)
    used, heavy = marked.filter("_stops").agg(F.coalesce(F.sum("_cap"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    shared = (F.col("_w") * F.lit(total - used)).cast("double") / F.lit(float(max(1, weight - heavy)))
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(shared)
    return stored(marked.select("source", "source_size", target.alias("target")), "mix-targets")


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """``docs`` with ``COLUMNS``: copies is how often the mix takes the row.

    The targets, one row for each source, join by the source; Spark broadcasts
    them if they are small and splits a hot source otherwise.
    """
    rest = [c for c in docs.columns if c not in COLUMNS]
    sized = docs.select(*[F.col(f"`{c}`") for c in rest], size.alias("size"))
    per_source = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("size").cast("long").alias("source_size"))
    own = unused("_source", rest)
    targets = source_targets(per_source, **how).withColumnRenamed("source", own)
    joined = sized.join(targets, F.col(f"`{source}`").eqNullSafe(F.col(own)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.withColumn("rate", rate)
    more = (draw(F.col(f"`{key}`"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", F.floor("rate").cast("long") + more).select(*[F.col(f"`{c}`") for c in rest], *COLUMNS)


def emit(docs: DataFrame, size: Column, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as taken."""
    # A clash with COLUMNS must not cost the caller a column, so the row travels whole.
    key, source = how.pop("key", "doc_id"), how.pop("source", "source")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    flat = docs.select(row, F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_src"), size.alias("_size"))
    taken = mix(flat, F.col("_size"), key="_key", source="_src", **how).filter(F.col("copies") > 0)
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return copies.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
