"""Sender profiles: counts, dominant hint, first subjects, spans, top and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from mailloom import fixed
from mailloom.session import BROADCAST_ROWS

EXAMPLES = 3
PROFILE = ["from_addr", "from_domain", "message_count", "first_seen", "last_seen", "keyword_hint"]


def by_rank() -> list[Column]:
    return [F.desc("message_count"), F.asc("from_addr")]


def sender_stats(messages: DataFrame) -> DataFrame:
    """One row per sender, without subjects.

    Counts go per (sender, hint) first: all buffers are fixed width, so map tasks
    combine in a hash map and a hot sender leaves each task as a few rows.
    """
    return _per_sender(messages.groupBy("from_addr", "from_domain", "keyword_hint").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    ))


def _per_sender(per_hint: DataFrame) -> DataFrame:
    hint = F.nullif("keyword_hint", F.lit(""))
    # Most frequent hint; of equals the smallest.
    best = F.min(F.when(hint.isNotNull(), F.struct((-F.col("n")).alias("n"), hint.alias("hint"))))
    return per_hint.groupBy("from_addr").agg(
        F.min("from_domain").alias("from_domain"),
        F.sum("n").alias("message_count"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        best["hint"].alias("keyword_hint"),
    )


def first_subject_rows(messages: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """First k rows of each sender by (folder, uid), cut in the map tasks already."""
    w = Window.partitionBy("from_addr").orderBy("folder", "uidvalidity", "uid")
    return messages.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def _collect_subjects() -> Column:
    """Of at most EXAMPLES rows per group; empty subjects go after the cut."""
    ordered = F.array_sort(F.collect_list(F.struct("rn", "subject")))
    return F.filter(F.transform(ordered, lambda s: s["subject"]), lambda s: s != "")


def example_subjects(messages: DataFrame, k: int = EXAMPLES) -> DataFrame:
    narrow = messages.select("from_addr", "folder", "uidvalidity", "uid", "subject")
    return first_subject_rows(narrow, k).groupBy("from_addr").agg(
        _collect_subjects().alias("example_subjects")
    )


def sender_profiles(messages: DataFrame) -> DataFrame:
    """All senders. Both sides end partitioned by sender, so the join adds no shuffle."""
    return sender_stats(messages).join(example_subjects(messages), "from_addr").select(
        *PROFILE, "example_subjects"
    )


def dominant_hint(messages: DataFrame) -> DataFrame:
    return sender_stats(messages).select("from_addr", "keyword_hint")


def sender_span(messages: DataFrame) -> DataFrame:
    return messages.groupBy("from_addr").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


def top_senders(messages: DataFrame, n: int = fixed.TOP_SENDERS) -> DataFrame:
    """The n most frequent senders; subjects are fetched for these only."""
    top = sender_stats(messages).orderBy(*by_rank()).limit(n)
    side = F.broadcast(top) if n <= BROADCAST_ROWS else top
    rows = messages.select("from_addr", "folder", "uidvalidity", "uid", "subject").join(
        side, "from_addr"
    )
    return (
        first_subject_rows(rows)
        .groupBy(*PROFILE).agg(_collect_subjects().alias("example_subjects"))
        .orderBy(*by_rank())
    )


def senders_matching(messages: DataFrame, text: str) -> DataFrame:
    """Profiles of any rank whose address or domain contains the text."""
    s = F.lit(text.lower())
    hit = F.contains(F.lower("from_addr"), s) | F.contains(F.lower("from_domain"), s)
    return sender_profiles(messages.filter(hit))


def domain_rollup(profiles: DataFrame) -> DataFrame:
    """Message counts per domain over the listed senders only."""
    return profiles.filter("from_domain != ''").groupBy("from_domain").agg(
        F.sum("message_count").alias("message_count")
    )


# --- partial profiles: made by run or by folder, merged on read ---------------------------

_GROUP = ["folder", "from_addr", "from_domain", "hint"]
PARTIAL = StructType([
    *[StructField(c, StringType()) for c in _GROUP], StructField("n", LongType()),
    StructField("lo", TimestampNTZType()), StructField("hi", TimestampNTZType()),
    StructField("firsts", ArrayType(StructType([
        StructField("uidvalidity", LongType()), StructField("uid", LongType()),
        StructField("subject", StringType()),
    ]))),
])


def profile_partials(messages: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """Count, span and first k subjects by folder, sender and hint.

    Partials of disjoint messages merge into the profiles of all of them. Both sides are
    cut in the map tasks and end partitioned alike, so the join adds no shuffle.
    """
    rows = messages.withColumn("hint", F.coalesce("keyword_hint", F.lit("")))
    counts = rows.groupBy(*_GROUP).agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    w = Window.partitionBy(*_GROUP).orderBy("uidvalidity", "uid")
    firsts = (
        rows.select(*_GROUP, "uidvalidity", "uid", "subject")
        .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
        .groupBy(*_GROUP).agg(F.array_sort(F.collect_list(
            F.struct("uidvalidity", "uid", "subject"))).alias("firsts"))
    )
    return counts.join(firsts, _GROUP).select(*PARTIAL.names)


def merged_stats(partials: DataFrame) -> DataFrame:
    """As sender_stats, from partials."""
    return _per_sender(partials.groupBy("from_addr", "from_domain", "hint").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).withColumnRenamed("hint", "keyword_hint"))


def _first_of_partials(partials: DataFrame) -> DataFrame:
    return first_subject_rows(partials.select("from_addr", "folder", F.inline("firsts")))


def merged_profiles(partials: DataFrame) -> DataFrame:
    """As sender_profiles, from partials: none of the messages is read."""
    subjects = _first_of_partials(partials).groupBy("from_addr").agg(
        _collect_subjects().alias("example_subjects"))
    return merged_stats(partials).join(subjects, "from_addr").select(*PROFILE, "example_subjects")


def merged_top_senders(partials: DataFrame, n: int = fixed.TOP_SENDERS) -> DataFrame:
    """As top_senders, from partials."""
    top = merged_stats(partials).orderBy(*by_rank()).limit(n)
    side = F.broadcast(top) if n <= BROADCAST_ROWS else top
    own = partials.select("from_addr", "folder", "firsts").join(side, "from_addr")
    return (
        first_subject_rows(own.select(*PROFILE, "folder", F.inline("firsts")))
        .groupBy(*PROFILE).agg(_collect_subjects().alias("example_subjects"))
        .orderBy(*by_rank())
    )
