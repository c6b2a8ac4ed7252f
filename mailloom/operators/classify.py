"""The classification log: latest view, rules pass, residue, manifest, counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from mailloom.functions.text import iso_text
from mailloom.operators.rules import RESOLVED, resolve_rules
from mailloom.schemas import CLASSIFICATION, KEY, MANIFEST_COLUMNS
from mailloom.taxonomy import Taxonomy


def latest_classification(log: DataFrame, taxonomy_hash: str) -> DataFrame:
    """Newest record of each message under one taxonomy; always one row."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("run_seq"))
    return (
        log.filter(F.col("taxonomy_hash") == taxonomy_hash)
        .withColumn("__rn", F.row_number().over(w))
        .filter("__rn = 1")
        .drop("__rn")
    )


def latest_tag(messages: DataFrame, log: DataFrame, taxonomy_hash: str) -> DataFrame:
    """Add `latest_tag` (null without a record), as one join for all messages."""
    latest = latest_classification(log, taxonomy_hash).select(
        *KEY, F.col("tag").alias("latest_tag")
    )
    return messages.join(latest, KEY, "left")


def classified_count(log: DataFrame) -> DataFrame:
    """Distinct messages with a record under any taxonomy."""
    return log.agg(F.count_distinct(F.struct("folder", "uid")).alias("classified"))


def _subtags(subtag: Column) -> Column:
    return F.when(F.nullif(subtag, F.lit("")).isNotNull(), F.array(subtag)).otherwise(
        F.array().cast("array<string>")
    )


def as_records(decided: DataFrame, taxonomy: Taxonomy, run_ts: Column, run_seq: int,
               tag: str, subtag: str) -> DataFrame:
    """Classification rows; provenance columns the input lacks are null."""
    have = set(decided.columns)

    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    null_text = F.lit(None).cast("string")
    values = {
        "tag": F.col(tag),
        "subtags": _subtags(F.col(subtag)),
        "taxonomy_version": F.lit(taxonomy.version),
        "taxonomy_hash": F.lit(taxonomy.content_hash),
        "model_id": optional("model_id", null_text),
        "prompt_version": optional("prompt_version", null_text),
        "rationale": optional("rationale", null_text),
        "truncated": optional("truncated", F.lit(False)),
        "created_at": run_ts,
        "run_seq": F.lit(run_seq).cast("bigint"),
    }
    return decided.select(*[values.get(c, F.col(c)).alias(c) for c in CLASSIFICATION.names])


@dataclass
class RulesCount:
    """Counts of a rules pass, observed on the rows it writes: no pass of their own."""

    resolved: Observation = field(default_factory=Observation)
    decided: Observation = field(default_factory=Observation)

    def values(self) -> dict[str, int]:
        """scanned, written, unchanged, uncovered, once the records are written."""
        scanned, covered = (self.resolved.get.get(k) or 0 for k in ("scanned", "covered"))
        unchanged = self.decided.get.get("unchanged") or 0
        return {"scanned": scanned, "written": covered - unchanged, "unchanged": unchanged,
                "uncovered": scanned - covered}


def rules_pass(messages: DataFrame, rules: DataFrame, log: DataFrame, taxonomy: Taxonomy,
               keyword_authoritative: bool = True, count: RulesCount | None = None) -> DataFrame:
    """Covered messages with what the rules say and the latest tag of each.

    Uncovered ones are left out before the join, so they are never shuffled.
    """
    resolved = resolve_rules(messages, rules, taxonomy, keyword_authoritative).select(*KEY, *RESOLVED)
    if count:
        resolved = resolved.observe(count.resolved, F.count(F.lit(1)).alias("scanned"),
                                    F.count("resolved_tag").alias("covered"))
    decided = latest_tag(resolved.filter("resolved_tag IS NOT NULL"), log, taxonomy.content_hash)
    if count:
        same = F.col("resolved_tag").eqNullSafe(F.col("latest_tag"))
        decided = decided.observe(count.decided, F.count_if(same).alias("unchanged"))
    return decided


def classify_rules(messages: DataFrame, rules: DataFrame, log: DataFrame, taxonomy: Taxonomy,
                   run_ts: Column, run_seq: int, keyword_authoritative: bool = True,
                   count: RulesCount | None = None) -> DataFrame:
    """Records to append: covered messages whose tag differs from their latest."""
    decided = rules_pass(messages, rules, log, taxonomy, keyword_authoritative, count)
    changed = decided.filter(~F.col("resolved_tag").eqNullSafe(F.col("latest_tag")))
    return as_records(changed, taxonomy, run_ts, run_seq, "resolved_tag", "resolved_subtag")


def classify_metrics(messages: DataFrame, rules: DataFrame, log: DataFrame, taxonomy: Taxonomy,
                     keyword_authoritative: bool = True) -> DataFrame:
    """scanned, written, unchanged, uncovered of a rules pass, in one pass.

    A job that writes the records has them from RulesCount.
    """
    resolved = resolve_rules(messages, rules, taxonomy, keyword_authoritative).select(*KEY, "resolved_tag")
    same = F.col("resolved_tag").eqNullSafe(F.col("latest_tag"))
    return latest_tag(resolved, log, taxonomy.content_hash).agg(
        F.count("*").alias("scanned"), F.count("resolved_tag").alias("covered"),
        F.count_if(F.col("resolved_tag").isNotNull() & same).alias("unchanged"),
    ).select("scanned", (F.col("covered") - F.col("unchanged")).alias("written"), "unchanged",
             (F.col("scanned") - F.col("covered")).alias("uncovered"))


def llm_residue(messages: DataFrame, rules: DataFrame, log: DataFrame, taxonomy: Taxonomy,
                keyword_authoritative: bool = True) -> DataFrame:
    """Messages that no rule covers and that have no record under this taxonomy."""
    open_ = resolve_rules(messages, rules, taxonomy, keyword_authoritative).filter(
        "resolved_tag IS NULL"
    ).select(*messages.columns)
    return without_record(open_, log, taxonomy.content_hash)


def without_record(messages: DataFrame, log: DataFrame, taxonomy_hash: str) -> DataFrame:
    done = log.filter(F.col("taxonomy_hash") == taxonomy_hash).select(*KEY)
    return messages.join(done, KEY, "left_anti")


def llm_limit(residue: DataFrame, n: int | None) -> DataFrame:
    """At most n messages per run, in (folder, uid) order; None takes all."""
    return residue if n is None else residue.orderBy("folder", "uid", "uidvalidity").limit(n)


def manifest(messages: DataFrame, log: DataFrame, taxonomy_hash: str) -> DataFrame:
    """Latest classification of each message joined to the message, 17 columns."""
    latest = latest_classification(log, taxonomy_hash)
    return messages.join(latest, KEY).select(*MANIFEST_COLUMNS)


def flat_manifest(rows: DataFrame) -> DataFrame:
    """The manifest with lists and times as text, as its CSV twin needs them."""
    return rows.withColumns({
        "subtags": F.array_join("subtags", ","),
        "date": iso_text(F.col("date")),
        "created_at": iso_text(F.col("created_at")),
    })
