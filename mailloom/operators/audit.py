"""Contradictions between assigned tags and keyword signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailloom.functions.keywords import first_contradiction, has_signal, with_signals
from mailloom.operators.classify import latest_classification
from mailloom.schemas import KEY
from mailloom.taxonomy import Taxonomy


def audit(messages: DataFrame, log: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """At most one open finding per classified message.

    The texts are read where they lie: only messages with a signal go on, and with
    their keywords instead of their text.
    """
    latest = latest_classification(log, taxonomy.content_hash).select(
        *KEY, F.col("tag").alias("assigned_tag")
    )
    hits = messages.select(*KEY, "subject", "snippet").filter(has_signal(taxonomy))
    signalled = with_signals(hits, taxonomy).select(*KEY, "signals")
    return (
        signalled.join(latest, KEY)
        .withColumn("hit", first_contradiction("assigned_tag"))
        .filter("hit IS NOT NULL")
        .select(*KEY, "assigned_tag", "hit.suspected_tag", "hit.trigger_keywords",
                F.lit(False).alias("resolved"))
    )


def open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter("NOT resolved").agg(F.count("*").alias("open_findings"))
