"""The review queue over senders and their domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailloom import fixed
from mailloom.functions.text import leaf_of
from mailloom.operators.senders import senders_matching, top_senders

SORTABLE = ["scope", "label", "message_count", "hint", "status", "decision"]


def queue_items(profiles: DataFrame) -> DataFrame:
    """One item per listed sender and one per domain of the listed senders.

    Each profile is opened into its two items and grouped once, so the profiles
    are computed a single time.
    """
    addr = F.struct(
        F.lit("addr").alias("scope"), F.col("from_addr").alias("key"),
        F.col("from_domain").alias("label"), F.col("message_count").alias("n"),
        F.col("keyword_hint").alias("hint"), F.col("example_subjects").alias("subjects"),
    )
    domain = F.struct(
        F.lit("domain").alias("scope"), F.col("from_domain").alias("key"),
        F.col("from_domain").alias("label"), F.col("message_count").alias("n"),
        F.lit(None).cast("string").alias("hint"), F.array().cast("array<string>").alias("subjects"),
    )
    return (
        profiles.select(F.inline(F.array(addr, domain)))
        .filter("scope = 'addr' OR key != ''")
        .groupBy("scope", "key", "label")
        .agg(F.sum("n").alias("message_count"), F.max("hint").alias("hint"),
             F.max("subjects").alias("example_subjects"))
    )


def annotate_queue(items: DataFrame, rules: DataFrame, deferrals: DataFrame) -> DataFrame:
    """Status, current leaf and note of each item; a rule beats a deferral."""
    ruled = rules.select("scope", "key", leaf_of(F.col("tag"), F.col("subtag")).alias("current_leaf"))
    noted = deferrals.select("scope", "key", F.col("note").alias("__note"))
    decided, deferred = F.col("current_leaf").isNotNull(), F.col("__note").isNotNull()
    return (
        items.join(ruled, ["scope", "key"], "left").join(noted, ["scope", "key"], "left")
        .select(
            *items.columns,
            F.when(decided, "decided").when(deferred, "deferred").otherwise("undecided")
            .alias("status"),
            "current_leaf",
            F.coalesce("__note", F.lit("")).alias("note"),
        )
    )


def queue_sort(queue: DataFrame) -> DataFrame:
    """Undecided, deferred, decided; then by count; domains before addresses."""
    rank = F.when(F.col("status") == "decided", 2).when(F.col("status") == "deferred", 1).otherwise(0)
    return queue.orderBy(rank, F.desc("message_count"), F.desc("scope"), "key")


def queue_search(queue: DataFrame, text: str) -> DataFrame:
    s = F.lit(text.lower())
    return queue.filter(F.contains(F.lower("label"), s) | F.contains(F.lower("key"), s))


def queue_sort_by(queue: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Order by any of the six shown columns."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column!r}")
    sort_key = {
        "label": F.lower("label"),
        "hint": F.coalesce("hint", F.lit("")),
        "decision": F.coalesce(F.nullif("current_leaf", F.lit("")), "note", F.lit("")),
    }.get(column, F.col(column))
    return queue.orderBy(sort_key.desc() if descending else sort_key.asc(), "scope", "key")


def review_queue(messages: DataFrame, rules: DataFrame, deferrals: DataFrame,
                 n: int = fixed.TOP_SENDERS, sender: str | None = None) -> DataFrame:
    """Queue of the top n senders, or of the senders that match a text at any rank."""
    profiles = senders_matching(messages, sender) if sender else top_senders(messages, n)
    return queue_sort(annotate_queue(queue_items(profiles), rules, deferrals))
