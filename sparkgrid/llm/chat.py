"""Chat formatting: each dialogue once for every participant, with that speaker as
the assistant, the others as named users, and a loss mask on the assistant's turns.

The rendering comes as one row for each turn, with the place of the turn in the
rendered dialogue, so no dialogue is ever gathered into one task.  All that is
dealt, sorted and summed is numbers; the texts are moved once, when each turn meets
its perspectives at the end:

1. Turns are put in order, which is the same for all perspectives, and the lengths
   they have as users' turns are summed up: prefix sums over ranges.
2. Turns meet the speakers of their dialogue by an equi-join that Spark splits where
   one dialogue is hot, and each speaker's own turns are counted up likewise.
3. An assistant's header differs from a user's by a fixed number of characters, so
   the two sums give the offset.

Defined results: a null role is the speaker ``unknown``; a null text is empty; a
null turn comes first; rows without conv_id form one dialogue; turns with equal
numbers follow by role and then text, and repeated rows all stay; other columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.scratch import ordered_prefix, small_side, stored

ASSISTANT, USER, CLOSE, END = "<|assistant|>\n", "<|user:", "|>\n", "<|end|>\n"
#: Characters of a text that deal turns equal in number and role.
PREFIX = 256


def _same(left: DataFrame, right: DataFrame, *columns: str):
    """Whether the columns of the left are those of the right, whose names have an underscore before."""
    out = F.lit(True)
    for c in columns:
        out &= left[c].eqNullSafe(right[f"_{c}"])
    return out


def _ties(said: DataFrame) -> DataFrame | None:
    """The rank by text of each text among the turns of the same number and role; none if there are no such turns."""
    key = ("conv_id", "turn", "role")
    several = said.groupBy(*key).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo <> hi")
    several = stored(several.select(*[F.col(c).alias(f"_{c}") for c in key]), "chat-ties")
    if several.isEmpty():
        return None
    texts = said.join(several, _same(said, several, *key), "left_semi").groupBy(*key, "hash").agg(F.first("text").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in key]
    # Texts with a common beginning stay in one range, where the whole texts order them.
    ranked = ordered_prefix(texts, [*order, F.col("text")], {"tie": F.lit(1)}, "chat-ranks", [*order, F.substring("text", 1, PREFIX)])
    return ranked.select(*[F.col(c).alias(f"_{c}") for c in (*key, "hash")], "tie")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, seq, turn, role, rendered, begin_char, n_chars, mask).

    ``rendered`` of all rows of a (conv_id, perspective) by ``seq`` is the
    dialogue; the row's characters are [begin_char, begin_char + n_chars), of
    which the text, without its header, counts in the loss where mask is 1.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = turns.select(
        F.monotonically_increasing_id().alias("uid"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        text.alias("text"),
        F.xxhash64(text).alias("hash"),
    )
    said = stored(said, "said")
    as_user = (F.length("text") + F.length("role") + len(USER + CLOSE + END)).cast("long").alias("as_user")
    narrow = said.select("uid", "conv_id", "turn", "role", "hash", as_user)
    ties = _ties(said)
    if ties is None:
        narrow = narrow.withColumn("tie", F.lit(0).cast("long"))
    else:
        narrow = narrow.join(ties, _same(narrow, ties, "conv_id", "turn", "role", "hash"), "left").select(*narrow.columns, F.coalesce("tie", F.lit(0)).alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie")]
    lines = ordered_prefix(narrow, order, {"at": F.lit(1), "upto": F.col("as_user")}, "chat")
    lines = stored(lines.select("uid", "conv_id", "role", "at", (F.col("upto") - F.col("as_user")).alias("before")), "chat-lines")
    first = lines.groupBy("conv_id").agg((F.min("at") - 1).alias("rows0"), F.min("before").alias("chars0"))
    first = first.select(F.col("conv_id").alias("_conv_id"), "rows0", "chars0")
    speakers = lines.groupBy("conv_id", F.col("role").alias("perspective")).agg(F.count(F.lit(1)).alias("said"))
    speakers = speakers.join(first, _same(speakers, first, "conv_id")).select(F.monotonically_increasing_id().alias("view"), F.col("conv_id").alias("_conv_id"), "perspective", "rows0", "chars0", "said")
    # Turns by the speakers of all views before.
    speakers = ordered_prefix(stored(speakers, "speakers"), [F.col("view")], {"turns0": F.col("said")}, "chat-speakers").withColumn("turns0", F.col("turns0") - F.col("said"))
    speakers = stored(speakers, "speakers")
    few = small_side(speakers)
    own = (F.col("role") == F.col("perspective")).cast("int")
    views = lines.join(few.select("_conv_id", "perspective", "view"), _same(lines, few, "conv_id")).select("view", "at", "uid", "before", own.alias("mask"))
    counted = ordered_prefix(views, [F.col("view"), F.col("at")], {"turns": F.col("mask")}, "chat-views")
    # What the assistant's earlier turns are longer than they would be as a user's.
    longer = (F.col("turns") - F.col("mask") - F.col("turns0")) * (F.lit(len(ASSISTANT + END)) - F.length("perspective") - len(USER + CLOSE + END))
    placed = counted.join(few.select("view", "perspective", "rows0", "chars0", "turns0"), "view").select(
        "uid", "perspective", "mask", (F.col("at") - F.col("rows0")).alias("seq"), (F.col("before") - F.col("chars0") + longer).cast("long").alias("begin_char")
    )
    header = F.when(F.col("mask") == 1, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), "role", F.lit(CLOSE)))
    out = said.select("uid", "conv_id", "turn", "role", "text").join(placed, "uid").withColumn("rendered", F.concat(header, "text", F.lit(END)))
    return out.select("conv_id", "perspective", "seq", "turn", "role", "rendered", "begin_char", F.length("rendered").cast("long").alias("n_chars"), "mask")
