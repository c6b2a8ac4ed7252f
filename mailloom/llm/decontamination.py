"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds a posting (document, position, term) for each training word that is a
benchmark term, and one past the last word, so a document's length is a posting too. It is
stored in document order, without a shuffle. A phrase is looked for from its rarest terms:
their lists, moved by the terms' offsets, are intersected, and what is left is checked
against the lists of all its terms. Near matches ask for all terms of a phrase around its rarest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailloom.llm.common import ascii_lower, filter_before_shuffle, kept

WIDTH = 10
RAREST = 2
TERM_ROWS = 1_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = "\n"  # no word


def term_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits and of all other characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


@dataclass
class Phrases:
    """phrases: (phrase_id, size); slots: (phrase_id, offset, term); items: (phrase_id, item_id);
    terms: (word, term)."""

    phrases: DataFrame
    slots: DataFrame
    items: DataFrame
    terms: DataFrame


def phrases_of(items: DataFrame, width: int = WIDTH) -> Phrases:
    """Windows of `width` words of items (item_id, text), or the whole of shorter ones.

    Items without words, and null texts, have none. Equal windows are one phrase.
    """
    n = F.size("words")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).when(n > 0, F.array(F.lit(1))).otherwise(
        F.array().cast("array<int>"))
    found = kept(items.select("item_id", term_words(F.col("text")).alias("words")).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("phrase")), "windows")
    numbered = kept(found.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    words = numbered.select("phrase_id", F.posexplode("phrase").alias("offset", "word"))
    ends = numbered.sparkSession.range(1).select(F.lit(_END).alias("word"), F.lit(0).cast("long").alias("term"))
    terms = kept(words.select("word").distinct().withColumn(
        "term", F.monotonically_increasing_id() + 1).union(ends), "terms")
    return Phrases(
        numbered.select("phrase_id", F.size("phrase").alias("size")),
        kept(words.join(terms, "word").select("phrase_id", "offset", "term"), "slots"),
        kept(found.join(numbered, "phrase").select("phrase_id", "item_id").distinct(), "items"),
        terms)


def build_index(docs: DataFrame, terms: DataFrame, term_rows: int = TERM_ROWS) -> DataFrame:
    """Stored postings (row_key, doc_id, pos, term) of `docs` (doc_id, text); term 0 at the end.

    A row is known by the hash of doc_id and text: repeated rows share their postings.
    """
    # Keyed before words become rows: beside an explode the key would be computed for each word.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id",
                        F.concat(term_words(F.col("text")), F.array(F.lit(_END))).alias("words"))
    rows = keyed.select("row_key", "doc_id", F.posexplode("words").alias("pos", "word"))
    # A test set's vocabulary is small; its size is counted before it is sent to all tasks.
    terms = F.broadcast(terms) if terms.count() <= term_rows else terms
    return kept(rows.join(terms, "word").select("row_key", "doc_id", "pos", "term"), "postings")


def _by_rarity(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Slots of phrases whose terms all occur, with rank 1 for a phrase's rarest term."""
    seen = index.filter("term > 0").groupBy("term").agg(F.count("*").alias("lists"))
    slots = phrases.slots.join(seen, "term", "left")
    whole = Window.partitionBy("phrase_id")
    return kept(slots.withColumns({
        "missing": F.sum(F.col("lists").isNull().cast("int")).over(whole),
        "rank": F.row_number().over(whole.orderBy("lists", "offset")),
    }).filter("missing = 0").select("phrase_id", "offset", "term", "rank"), "slots")


def _of_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The postings of the rows in `rows`; a runtime filter keeps the others from the shuffle."""
    filter_before_shuffle(index.sparkSession)
    return index.join(rows.select("row_key"), "row_key", "left_semi")


def phrase_matches(index: DataFrame, phrases: Phrases, rarest: int = RAREST) -> DataFrame:
    """(row_key, phrase_id, start, size): every place where a phrase stands word for word."""
    slots = _by_rarity(index, phrases)
    probes = slots.filter(F.col("rank") <= rarest)
    whole = F.least(F.col("size"), F.lit(rarest))
    starts = kept(
        index.join(probes, "term").select("row_key", "phrase_id", (F.col("pos") - F.col("offset")).alias("start"), "rank")
        .groupBy("row_key", "phrase_id", "start").agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("met"))
        .join(phrases.phrases, "phrase_id")
        .filter(F.col("met") == F.expr(f"shiftleft(1, least(size, {rarest})) - 1"))
        .select("row_key", "phrase_id", "start", "size"), "starts")
    done = starts.filter(F.col("size") <= whole)
    more = starts.filter(F.col("size") > whole)
    asked = more.join(slots.filter(F.col("rank") > rarest), "phrase_id").select(
        "row_key", "phrase_id", "start", "size", "offset", (F.col("start") + F.col("offset")).alias("pos"), "term")
    met = asked.join(_of_rows(index, more).select("row_key", "pos", "term").distinct(), ["row_key", "pos", "term"])
    return done.union(met.groupBy("row_key", "phrase_id", "start", "size").agg(F.count("*").alias("n")).filter(
        F.col("n") == F.col("size") - rarest).select(*done.columns))


def proximity_matches(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """(row_key, phrase_id, pos): places of a phrase's rarest term that have all its terms,
    in any order, within the phrase's size and `slop` words."""
    slots = _by_rarity(index, phrases)
    near = index.join(slots.filter("rank = 1"), "term").select("row_key", "phrase_id", "pos")
    others = slots.groupBy("phrase_id").agg(F.collect_set("term").alias("terms"), (F.max("offset") + 1).alias("size"))
    asked = near.join(others, "phrase_id").select("row_key", "phrase_id", "pos", "size", F.size("terms").alias("n"),
                                                  F.explode("terms").alias("term"))
    lists = _of_rows(index, near).select("row_key", "term", F.col("pos").alias("at"))
    met = asked.join(lists, ["row_key", "term"]).filter(
        F.abs(F.col("at") - F.col("pos")) < F.col("size") + slop)
    return met.groupBy("row_key", "phrase_id", "pos", "n").agg(F.count_distinct("term").alias("found")).filter(
        "found = n").select("row_key", "phrase_id", "pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row_key, doc_id, n_words, n_hit, item_ids, contaminated) for each row of `docs`.

    A word is hit inside any occurrence of an item's window. item_ids are the items with
    occurring windows, as sorted texts. Null and empty texts have no words; no items, no
    hits; items without item_id count as no item. Repeated rows get equal results. Other
    columns of either table are not read.
    """
    phrases = phrases_of(items.select("item_id", "text"), width)
    index = build_index(docs, phrases.terms)
    hits = kept(phrase_matches(index, phrases), "hits")
    words = hits.select("row_key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
    n_hit = words.distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("row_key", "phrase_id").distinct().join(phrases.items, "phrase_id").select(
        "row_key", F.col("item_id").cast("string").alias("item")).distinct()
    item_ids = named.groupBy("row_key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = n_hit.join(item_ids, "row_key", "left")
    rows = index.filter("term = 0").select("row_key", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return rows.join(found, "row_key", "left").select(
        "row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` without a hit word, with its own columns."""
    found = kept(contamination(docs, items, width).filter("contaminated").select("row_key").distinct(), "found")
    own = docs.withColumn("__row_key", F.xxhash64("doc_id", "text"))
    return own.join(found.withColumnRenamed("row_key", "__row_key"), "__row_key", "left_anti").select(*docs.columns)
