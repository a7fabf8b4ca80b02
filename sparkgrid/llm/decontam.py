"""Benchmark decontamination by a distributed positional inverted index.

The index holds a posting for each word of the corpus: its term (a 64-bit hash of
the word), document and position.  It is sharded by document, as search engines
do: each task inverts the documents it read, so a shard's postings lie by term
and the corpus is not shuffled; a term's posting list is its rows in all shards.
It is stored once and serves any benchmark; a lookup reads the lists of the
test terms that it needs, not the texts.

A test window is looked up from its rarest term by corpus frequency: that list,
less the term's offset, gives the candidate starts.  They are intersected with
the list of the next rarest term at its offset, by document and position, and
what is left, little more than the occurrences, with the lists of all others.
Proximity goes by the same lists, compared by ranges of positions.

DataFrame functions only.  Tables of test terms are broadcast in blocks of a
counted size, so a benchmark of any size is looked up in whole; candidates are
broadcast only if they were counted to be few.

Defined results: a null or empty text has no words and hits nothing; an item
without words has no window; an item of fewer words than a window is one window;
rows that repeat an item_id are one item; a null item_id counts as the empty
string; rows that repeat a doc_id each give theirs; other columns are ignored;
empty tables give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.scratch import discard, small_side, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a broadcast table of terms or windows at most; more go in more blocks.
BLOCK_ROWS = 100_000
#: Documents with candidates that are broadcast at most, as bare numbers.
MOST_TOLD = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    # For ASCII the fast lower() is the same as the translation.
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def build_index(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored postings (term, uid, pos), by term in every shard.

    Each document also has a row without a term, for ``documents``: it bears the
    columns to keep, and the number of words as its position.
    """
    kept = {f"keep_{k}": c for k, c in enumerate(keep)}
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(f"`{c}`").alias(n) for n, c in kept.items()], terms(F.col(f"`{text}`")).alias("t"))
    spread = rows.select("uid", *kept, F.posexplode(F.concat("t", F.array(F.lit(None).cast("long")))).alias("pos", "term"))
    last = F.col("term").isNull()
    postings = spread.select("term", "uid", "pos", *[F.when(last, F.col(n)).alias(n) for n in kept])
    out = stored(postings.sortWithinPartitions("term"), "postings")
    out.kept = kept
    return out


def documents(index: DataFrame) -> DataFrame:
    """The documents of an index: uid, the kept columns and n_words."""
    return index.filter("term IS NULL").select("uid", *[F.col(n).alias(c) for n, c in index.kept.items()], F.col("pos").cast("long").alias("n_words"))


def test_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, seq, held), seq being the terms in order, and the sets of items (held, items) that hold them."""
    all_terms = items.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item_id"), terms(F.col(f"`{text}`")).alias("t"))
    n = F.size("t")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).when(n > 0, F.array(F.lit(1)))
    cut = all_terms.select("item_id", "t", F.explode(starts).alias("at")).select("item_id", F.slice("t", F.col("at"), F.lit(window)).alias("seq"))
    distinct = stored(cut.groupBy("seq").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows-items")
    sets = stored(distinct.select("items").distinct().select(F.monotonically_increasing_id().alias("held"), "items"), "item-sets")
    windows = distinct.join(sets, "items").select(F.monotonically_increasing_id().alias("wid"), "seq", "held")
    return stored(windows, "windows"), sets


def _blocks(table: DataFrame, key: str) -> list[DataFrame]:
    """The table in parts of about BLOCK_ROWS rows, each fit to broadcast."""
    n = table.count()
    parts = -(-n // BLOCK_ROWS) or 1
    if parts == 1:
        return [F.broadcast(table)]
    return [F.broadcast(table.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i)) for i in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rare_first(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with their (corpus count, offset, term) from the rarest on."""
    vocabulary = stored(windows.select(F.explode("seq").alias("term")).distinct(), "terms")
    every = index.filter("term IS NOT NULL").select("term")
    counts = _union([every.join(part, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for part in _blocks(vocabulary, "term")])
    counts = stored(counts, "term-counts")
    spread = windows.select("wid", F.posexplode("seq").alias("offset", "term"))
    listed = spread.join(counts, "term").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("lists"))
    return stored(windows.select("wid", "seq", "held").join(listed, "wid").filter(F.size("lists") == F.size("seq")).select("wid", "held", "lists"), "rare-first")


def _list_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The posting lists (term, uid, pos) of the terms in a broadcast table."""
    return index.filter("term IS NOT NULL").select("term", "uid", "pos").join(wanted, "term")


def _entry(k: int, name: str) -> Column:
    return F.get("lists", F.lit(k))[name]


def phrases(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Exact occurrences (uid, wid, held, start, length) of the windows."""
    found = []
    for part in _blocks(ranked, "wid"):
        first = F.broadcast(part.select(_entry(0, "term").alias("term"), _entry(0, "offset").alias("offset"), _entry(1, "term").alias("next"), _entry(1, "offset").alias("next_offset"), "wid"))
        starts = _list_of(index, first).withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0").select("uid", "wid", "start", "next", "next_offset")
        seconds = F.broadcast(part.select(_entry(1, "term").alias("term")).filter("term IS NOT NULL").distinct())
        met = _list_of(index, seconds).select(F.col("term").alias("next"), "uid", F.col("pos").alias("at"))
        both = starts.filter("next IS NOT NULL").withColumn("at", F.col("start") + F.col("next_offset")).join(met, ["next", "uid", "at"], "left_semi")
        alone = starts.filter("next IS NULL")
        near = stored(both.select("uid", "wid", "start").unionByName(alone.select("uid", "wid", "start")), "candidates")
        sized = near.join(part.select("wid", "held", "lists"), "wid").withColumn("length", F.size("lists"))
        rest = F.explode(F.slice("lists", 3, F.greatest(F.col("length") - 2, F.lit(0)))).alias("l")
        expected = stored(sized.filter("length > 2").select("uid", "wid", "start", rest).select("uid", "wid", "start", F.col("l.term").alias("term"), (F.col("start") + F.col("l.offset")).alias("pos")), "expected")
        # Of the common terms' lists only the candidates' documents matter, while these are few enough to be told to all.
        postings = _list_of(index, F.broadcast(part.select(F.explode(F.slice("lists", 3, F.greatest(F.size("lists") - 2, F.lit(0)))).alias("l")).select("l.term").distinct()))
        touched = stored(near.select("uid").distinct(), "touched")
        known = small_side(touched, MOST_TOLD, 64 << 20)
        if known is not touched:
            postings = postings.join(known, "uid", "left_semi")
        hits = postings.join(small_side(expected), ["term", "uid", "pos"]).groupBy("uid", "wid", "start").agg(F.count(F.lit(1)).alias("n"))
        whole = sized.filter("length > 2").join(hits, ["uid", "wid", "start"]).filter("n = length - 2").unionByName(sized.filter("length <= 2"), allowMissingColumns=True)
        found.append(whole.select("uid", "wid", "held", "start", "length"))
    return _union(found)


def proximity(index: DataFrame, ranked: DataFrame, span: int) -> DataFrame:
    """Places (uid, wid, held, pos of the rarest term) where all terms of a window are among ``span`` words in a row.

    Lists meet by document and by block of ``span`` positions, so a common term's
    list is met near candidates only.
    """
    block = lambda pos: F.floor(pos / span).cast("long")
    found = []
    for part in _blocks(ranked, "wid"):
        own = part.select("wid", "held", F.array_distinct(F.transform("lists", lambda x: x["term"])).alias("wanted"))
        first = F.broadcast(own.select(F.col("wanted")[0].alias("term"), "wid", "held", "wanted"))
        places = _list_of(index, first).select("uid", "wid", "held", "wanted", F.col("pos").alias("at"))

        def around(rows: DataFrame, chosen: Column) -> DataFrame:
            """Postings of the chosen terms less than a span away from the rows' places."""
            asked = rows.select("uid", "wid", "at", F.explode(chosen).alias("term"))
            asked = asked.withColumn("block", F.explode(F.array(*[block(F.col("at")) + d for d in (-1, 0, 1)])))
            terms_of = F.broadcast(own.select(F.explode("wanted").alias("term")).distinct())
            lists = _list_of(index, terms_of).withColumn("block", block(F.col("pos")))
            return asked.join(lists, ["term", "uid", "block"]).filter(F.abs(F.col("pos") - F.col("at")) < span)

        close = around(places, F.slice("wanted", 2, 1)).select("uid", "wid", "at").distinct()
        left = stored(places.filter(F.size("wanted") == 1).unionByName(places.join(close, ["uid", "wid", "at"], "left_semi")), "near")
        met = around(left, F.slice("wanted", 2, F.size("wanted"))).groupBy("uid", "wid", "at").agg(F.collect_set(F.struct("term", "pos")).alias("met"))
        firsts = F.sequence(F.greatest(F.col("at") - (span - 1), F.lit(0)), F.col("at"))
        inside = lambda s: F.array_distinct(F.transform(F.filter("met", lambda x: (x["pos"] >= s) & (x["pos"] < s + span)), lambda x: x["term"]))
        whole = F.exists(firsts, lambda s: F.size(inside(s)) == F.size("wanted") - 1)
        several = left.filter(F.size("wanted") > 1).join(met, ["uid", "wid", "at"]).filter(whole)
        found.append(several.select("uid", "wid", "held", "at").unionByName(left.filter(F.size("wanted") == 1).select("uid", "wid", "held", "at")).withColumnRenamed("at", "pos"))
    return _union(found)


def contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...], least_items: int = 1, window: int = WINDOW) -> DataFrame:
    """The kept columns of the contaminated rows, distinct, as a stored table; the index is deleted."""
    index = build_index(docs, keep=keep)
    found = stored(contamination(docs, items, least_items, window, keep, index).filter("contaminated").select(*keep).distinct(), "contaminated")
    discard(index)
    return found


def contamination(docs: DataFrame, items: DataFrame, least_items: int = 2, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), index: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: kept columns, n_words, n_hit, n_items, items_sha256, contaminated.

    ``index`` is theirs, if it is built already.
    """
    index = index if index is not None else build_index(docs, keep=keep)
    windows, sets = test_windows(items, window)
    hits = stored(phrases(index, rare_first(index, windows)), "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    # Windows that the same items hold count once for each document.
    named = hits.select("uid", "held").distinct().join(small_side(sets), "held").groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    by_doc = hits.groupBy("uid").agg(spans.alias("spans")).join(named, "uid")
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))

    def cover(state: Column, s: Column) -> Column:
        upto = F.greatest(state["upto"], s["end"])
        return F.struct((state["hit"] + upto - F.greatest(state["upto"], s["start"])).alias("hit"), upto.alias("upto"))

    hit = F.aggregate("spans", zero, cover, lambda s: s["hit"])
    listed = by_doc.select("uid", hit.cast("long").alias("hit"), F.size("items").cast("long").alias("n"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("sha"))
    none = F.sha2(F.lit(""), 256)
    n_items = F.coalesce("n", F.lit(0).cast("long"))
    return documents(index).join(listed, "uid", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words",
        F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        n_items.alias("n_items"),
        F.coalesce("sha", none).alias("items_sha256"),
        (n_items >= least_items).alias("contaminated"),
    )
