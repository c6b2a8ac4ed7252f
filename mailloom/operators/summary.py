"""Distributions, coverage and status over manifest, messages and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailloom import fixed
from mailloom.operators.audit import open_findings
from mailloom.operators.classify import classified_count
from mailloom.operators.intake import distinct_message_count


def tag_method_sender(manifest: DataFrame) -> DataFrame:
    """Counts per (tag, method, sender): one pass that feeds all distributions."""
    return manifest.groupBy("tag", "method", "from_addr").agg(F.count("*").alias("n"))


def tag_distribution(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag")


def method_breakdown(counts: DataFrame) -> DataFrame:
    """n and share (percent) per method; the window runs over one row per method."""
    per_method = counts.groupBy("method").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per_method.withColumn("share", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "method")


def top_senders_per_tag(counts: DataFrame, k: int = fixed.TOP_SENDERS_PER_TAG) -> DataFrame:
    """k most frequent senders of each tag; each task keeps k before the shuffle."""
    per_sender = counts.groupBy("tag", "from_addr").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("tag").orderBy(F.desc("n"), "from_addr")
    return per_sender.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lowest_confidence(manifest: DataFrame, k: int = fixed.LOWEST_CONFIDENCE) -> DataFrame:
    return (
        manifest.filter("method = 'llm'")
        .orderBy("confidence", "folder", "uid")
        .limit(k)
        .select("folder", "uid", "from_addr", F.coalesce("subject", F.lit("")).alias("subject"),
                "tag", "confidence")
    )


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One-row aggregates of one number each as the columns of one row, without a join."""
    names = [name for part in parts for name in part.columns]
    shapes = [part.select(*[
        (F.col(n) if n in part.columns else F.lit(None)).cast("bigint").alias(n) for n in names
    ]) for part in parts]
    return reduce(DataFrame.unionByName, shapes).agg(*[F.max(n).alias(n) for n in names])


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0)).alias("percent")


def summary_coverage(messages: DataFrame, counts: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct ids, classified rows of this taxonomy, rest, percent, open findings.

    "unclassified" means without a record here, not the tag of that name.
    """
    classified = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("classified"))
    one_row = side_by_side(distinct_message_count(messages), classified, open_findings(findings))
    return one_row.select(
        "distinct_messages", "classified",
        F.greatest(F.col("distinct_messages") - F.col("classified"), F.lit(0))
        .alias("unclassified"),
        _share("classified", "distinct_messages"), "open_findings",
    )


def status_coverage(messages: DataFrame, log: DataFrame) -> DataFrame:
    """Totals over all taxonomies; the percentage can pass 100. One pass over the ids."""
    ids = messages.agg(F.count("*").alias("messages"), F.count_distinct("message_id").alias("distinct_messages"))
    return side_by_side(ids, classified_count(log)).select(
        "messages", "distinct_messages", "classified", _share("classified", "distinct_messages"))


# Which columns a row of summary_facts is grouped by.
BY_TAG, BY_METHOD, BY_SENDER = "tag", "method", "sender"


def summary_facts(counts: DataFrame, k: int = fixed.TOP_SENDERS_PER_TAG) -> DataFrame:
    """(kind, tag, method, from_addr, n, rank): counts by tag, by method, and of the k most frequent
    senders of each tag, from one pass over tag_method_sender by grouping sets.

    `rank` counts within a tag's senders; the filter on it reaches the map tasks.
    """
    tag, method, sender = F.col("tag"), F.col("method"), F.col("from_addr")
    sets = counts.groupingSets([[tag], [method], [tag, sender]], tag, method, sender).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # Bits from the left: tag, method, sender; a set bit is a column left out.
    kind = F.when(F.col("gid") == 0b011, BY_TAG).when(F.col("gid") == 0b101, BY_METHOD).otherwise(BY_SENDER)
    w = Window.partitionBy("gid", "tag", "method").orderBy(F.desc("n"), "from_addr")
    return sets.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        kind.alias("kind"), "tag", "method", "from_addr", "n", "rank")


def folder_status(folders: DataFrame, cursor: DataFrame) -> DataFrame:
    """State of each configured folder."""
    state = F.when(F.col("uidvalidity").isNull(), "not synced").when(
        F.col("complete"), "complete"
    ).otherwise("incomplete")
    return folders.join(cursor, "folder", "left").select(
        "folder", state.alias("state"), "uidvalidity", "last_uid"
    )
