"""Sender rules and keyword rules over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailloom import fixed
from mailloom.functions.keywords import with_keyword_hint
from mailloom.functions.text import leaf_of
from mailloom.session import BROADCAST_ROWS, fits_broadcast, lookup_join, skew_join
from mailloom.taxonomy import Taxonomy

RESOLVED = ["resolved_tag", "resolved_subtag", "method", "confidence"]


def with_leaf(rules: DataFrame) -> DataFrame:
    return rules.withColumn("leaf", leaf_of(F.col("tag"), F.col("subtag")))


def is_leaf(leaf: Column, taxonomy: Taxonomy) -> Column:
    """The leaves of one taxonomy are few, so they are a literal of the plan."""
    return leaf.isin(taxonomy.leaves)


def mark_stale_rules(rules: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Add `stale`: the leaf of the rule is gone. Computed on read, never stored."""
    return with_leaf(rules).withColumn("stale", ~is_leaf(F.col("leaf"), taxonomy))


def invalid_rules(rules: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return mark_stale_rules(rules, taxonomy).filter("stale").drop("stale")


def valid_rules(rules: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return mark_stale_rules(rules, taxonomy).filter("NOT stale").drop("stale")


def stale_rules(rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rules of many versions against a table (version, leaf).

    The leaves grow with the versions, and Spark takes those made from few bytes for few rows:
    a merge join, so that they never meet in the driver.
    """
    return with_leaf(rules).join(leaves.hint("merge"), ["version", "leaf"], "left_anti")


def _by_scope(rules: DataFrame, scope: str, column: str, out: str) -> DataFrame:
    return rules.filter(F.col("scope") == scope).select(
        F.col("key").alias(column), F.struct("tag", "subtag").alias(out)
    )


def attach_sender_rules(messages: DataFrame, rules: DataFrame,
                        max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add `rule`: struct(tag, subtag) of the address rule, else of the domain rule.

    Few rules are broadcast and the messages do not move. Many rules meet the
    distinct senders first; the messages then take one join by sender. Both joins
    split a domain or sender that is heavy.
    """
    by_addr = _by_scope(rules, "addr", "from_addr", "addr_rule")
    by_domain = _by_scope(rules, "domain", "from_domain", "domain_rule")
    rule = F.coalesce("addr_rule", "domain_rule").alias("rule")
    if fits_broadcast(rules, max_rows):
        joined = messages.join(F.broadcast(by_addr), "from_addr", "left").join(
            F.broadcast(by_domain), "from_domain", "left"
        )
        return joined.select(*messages.columns, rule)
    senders = messages.select("from_addr", "from_domain").distinct()
    found = (
        skew_join(senders.join(by_addr, "from_addr", "left"), by_domain, ["from_domain"], "left",
                  F.col("from_addr"))
        .select("from_addr", "from_domain", rule)
        .filter("rule IS NOT NULL")
    )
    spread = F.struct("folder", "uidvalidity", "uid")
    return lookup_join(messages, found, ["from_addr", "from_domain"], "left", spread, max_rows) \
        .select(*messages.columns, "rule")


def resolve_rules(messages: DataFrame, rules: DataFrame, taxonomy: Taxonomy,
                  keyword_authoritative: bool = True,
                  max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add resolved_tag, resolved_subtag, method, confidence (null when unresolved).

    Address rule, then domain rule, then keyword rule if that is authoritative.
    Rules with an unknown leaf do not take part. Keyword rules are those of `taxonomy`.
    """
    # The stored hint is that of the taxonomy at ingest time.
    hinted = with_keyword_hint(messages, taxonomy, "__hint")
    joined = attach_sender_rules(hinted, valid_rules(rules, taxonomy), max_rows)
    by_rule = F.col("rule").isNotNull()
    hint = F.col("__hint") if keyword_authoritative else F.lit(None).cast("string")
    covered = by_rule | hint.isNotNull()
    return joined.withColumns({
        "resolved_tag": F.when(by_rule, F.col("rule.tag")).otherwise(hint),
        "resolved_subtag": F.when(by_rule, F.nullif(F.col("rule.subtag"), F.lit(""))),
        "method": F.when(by_rule, "sender_rule").when(hint.isNotNull(), "keyword_rule"),
        "confidence": F.when(covered, F.lit(1.0)),
    }).drop("rule", "__hint")


def coverage(messages: DataFrame, rules: DataFrame, taxonomy: Taxonomy,
             keyword_authoritative: bool = True,
             target: float = fixed.COVERAGE_TARGET) -> DataFrame:
    """total, covered, fraction, below_target."""
    resolved = resolve_rules(messages, rules, taxonomy, keyword_authoritative)
    return resolved.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("resolved_tag").isNotNull()).alias("covered"),
    ).withColumn(
        "fraction", F.coalesce(F.try_divide("covered", "total"), F.lit(0.0))
    ).withColumn("below_target", F.col("fraction") < target)
