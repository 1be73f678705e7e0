"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for every term that a test item is looked up by, the postings (row, position) of the training
texts. A window (`width` consecutive words of an item) is looked up by its rarest terms, rarity being the number
of texts that hold a term. The lists are intersected after shifting each position by the term's place in the
item: postings of one item on one diagonal (text position less item position) belong to one candidate
occurrence, and only diagonals on which all looked-up terms of some window meet are read further, word by word.

Everything is a DataFrame expression. Terms travel as 64-bit hashes in the index; the words themselves are
compared where a candidate is confirmed, so a result never rests on a hash.

Nulls: a null text has no words, and rows with a null item text match nothing; a null item_id is an item like
others, reported as no id. Repeated rows are each answered in full. An item of fewer words than a window, but
not none, is one window. Empty tables give no hits. Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.store import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased: ASCII signs but digits and letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
RAREST = 2
#: Rows of two numbers that may be broadcast (some 40 MB); a larger set of terms is joined by shuffles.
BROADCAST_ROWS = 500_000


def word_array(text: Column, apart: str = APART) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none. Splitting is far cheaper than extracting."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), apart), "")


def row_name(doc_id: Column, text: Column) -> Column:
    """Names a text under its doc_id: rows that are equal in both share the name."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"), F.length(text).cast("string")]
    return F.xxhash64(F.concat_ws(":", *parts))


def small_side(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once, and marked for broadcast if its rows, now counted, are few enough."""
    once = kept(frame, name)
    return F.broadcast(once) if once.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else once


def numbered(documents: DataFrame) -> DataFrame:
    """doc_id, row, text and words."""
    return documents.select("doc_id", row_name(F.col("doc_id"), F.col("text")).alias("row"), "text", word_array(F.col("text")).alias("words"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id and words of the items that have words; equal rows once."""
    held = benchmark.select("item_id", word_array(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return held.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.concat_ws(" ", "item_words")))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, place, term) of every word of every item."""
    return items.select("item", F.posexplode("item_words").alias("place", "word")).select("item", "place", F.xxhash64("word").alias("term"))


def text_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, texts): in how many texts each of the terms stands, over all texts."""
    once = texts.select(F.explode(F.array_distinct("words")).alias("word")).select(F.xxhash64("word").alias("term"))
    return once.join(small_side(terms.select("term").distinct(), "terms"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("texts"))


def looked_up(items: DataFrame, counts: DataFrame, width: int = WIDTH, rarest: int = RAREST) -> DataFrame:
    """(item, start, place, term): for each window the places of its rarest terms, ties to the earlier place."""
    sizes = items.select("item", F.size("item_words").alias("n"))
    terms = item_terms(items).join(counts, "term", "left").join(sizes, "item")
    last = F.greatest(F.col("n") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("place") - width + 1, F.lit(0)), F.least("place", last))
    each = terms.select("item", "place", "term", F.coalesce("texts", F.lit(0)).alias("texts"), F.explode(starts).alias("start"))
    # At most `width` terms a window.
    windows = each.groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("texts", "place", "term"))).alias("terms"))
    rare = windows.select("item", "start", F.explode(F.slice("terms", 1, rarest)).alias("t"))
    return rare.select("item", "start", F.col("t.place").alias("place"), F.col("t.term").alias("term"))


def positional_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, row, position) of the given terms in all texts."""
    every = texts.select("row", F.posexplode("words").alias("position", "word")).select(F.xxhash64("word").alias("term"), "row", "position")
    return every.join(small_side(terms.select("term").distinct(), "lookups"), "term", "left_semi")


def candidate_diagonals(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(row, item, diagonal) on which all looked-up terms of at least one window of the item meet."""
    places = small_side(queries.select("item", "place", "term").distinct(), "places")
    met = index.join(places, "term").select("row", "item", (F.col("position") - F.col("place")).alias("diagonal"), "place")
    found = met.distinct().groupBy("row", "item", "diagonal").agg(F.collect_set("place").alias("places"))
    wanted = queries.groupBy("item", "start").agg(F.collect_set("place").alias("need")).groupBy("item").agg(F.collect_set("need").alias("needs"))
    whole = F.exists("needs", lambda need: F.size(F.array_except(need, F.col("places"))) == 0)
    return found.join(wanted, "item").where(whole).select("row", "item", "diagonal")


def phrase_matches(texts: DataFrame, items: DataFrame, candidates: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, item, item_id, first, last): exact occurrences of windows, first and last word in the text.

    Windows that follow one another on a diagonal are one match.
    """
    read = texts.select("row", "text").join(candidates.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    held = read.select("row", word_array(F.col("text")).alias("words"))
    lined = candidates.join(held, "row").join(items.select("item", "item_id", "item_words"), "item")
    n, at = F.size("item_words"), F.col("diagonal")
    span = F.least(F.lit(width), n)
    fits = F.filter(
        F.sequence(F.lit(0), n - span),
        lambda k: (at + k >= 0) & (at + k + span <= F.size("words")) & (F.slice("words", F.greatest(at + k + 1, F.lit(1)), span) == F.slice("item_words", k + 1, span)),
    )
    hits = lined.withColumn("fits", fits).where(F.size("fits") > 0)
    # Runs of following starts: a start less its rank is the same within a run.
    each = hits.select("row", "item", "item_id", "diagonal", span.alias("span"), F.posexplode("fits").alias("k", "start"))
    runs = each.groupBy("row", "item", "item_id", "diagonal", "span", (F.col("start") - F.col("k")).alias("run"))
    return runs.agg(F.min("start").alias("a"), F.max("start").alias("b")).select(
        "row", "item", "item_id", (F.col("diagonal") + F.col("a")).alias("first"), (F.col("diagonal") + F.col("b") + F.col("span") - 1).alias("last")
    )


def proximity_matches(index: DataFrame, queries: DataFrame, within: int = 20) -> DataFrame:
    """(row, item, start, near): windows whose looked-up terms, in any order and beside other words, stand within
    `within` words of a posting of the window's first looked-up term; near is that posting's position."""
    term = queries.select("item", "start", "place", "term").distinct()
    first = term.groupBy("item", "start").agg(F.min(F.struct("place", "term")).alias("t"), F.countDistinct("term").alias("need"))
    seeds = first.select("item", "start", "need", F.col("t.term").alias("term")).join(index, "term").select("row", "item", "start", "need", F.col("position").alias("near"))
    cell = F.floor(F.col("near") / within)
    dealt = seeds.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    others = term.select("item", "start", "term").distinct().join(index, "term").withColumn("cell", F.floor(F.col("position") / within))
    met = dealt.join(others, ["row", "item", "start", "cell"]).where(F.abs(F.col("position") - F.col("near")) <= within)
    return met.groupBy("row", "item", "start", "near", "need").agg(F.countDistinct("term").alias("n")).where("n = need").select("row", "item", "start", "near")


def contaminated_words(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, rarest: int = RAREST) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings, nulls left out) and n_items of every row."""
    texts, items = numbered(documents), items_of(benchmark)
    terms = item_terms(items)
    queries = kept(looked_up(items, text_counts(texts, terms), width, rarest), "queries")
    candidates = candidate_diagonals(positional_index(texts, queries), queries)
    matches = phrase_matches(texts, items, candidates, width)
    # Words in any match, counted once: matches in order, each from the furthest end so far.
    spans = matches.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"), F.countDistinct("item_id").alias("n_items"))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        "spans",
        start,
        lambda had, x: F.struct(
            F.greatest(had["end"], x["last"]).alias("end"),
            (had["hit"] + F.greatest(x["last"] - F.greatest(had["end"] + 1, x["first"]) + 1, F.lit(0))).alias("hit"),
        ),
        lambda had: had["hit"],
    )
    hit = spans.select("row", covered.cast("long").alias("n_hit"), "item_ids", "n_items")
    every = texts.select("doc_id", "row", F.size("words").cast("long").alias("n_words"))
    return every.join(hit, "row", "left").select(
        "doc_id",
        "row",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
