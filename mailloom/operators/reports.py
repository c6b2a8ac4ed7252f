"""Reports and exports as lines with a total order, ready for a text sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailloom import fixed
from mailloom.functions.text import leaf_of
from mailloom.operators.senders import by_rank
from mailloom.operators.summary import (
    BY_METHOD, BY_TAG, lowest_confidence, summary_coverage, summary_facts,
)
from mailloom.taxonomy import Taxonomy

LINE_ORDER = ["section", "k1", "k2"]


def _fixed_lines(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    """Literal lines of a page; order keys as text of equal width."""
    rows = [(section, f"{i:04d}", 0, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "section INT, k1 STRING, k2 BIGINT, line STRING")


def _rows(df: DataFrame, section: int, k1: Column, k2: Column, line: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), k1.alias("k1"), k2.cast("bigint").alias("k2"),
        line.alias("line"),
    )


# --- rules ---------------------------------------------------------------------


def rules_tsv(rules: DataFrame) -> DataFrame:
    """scope, key, leaf separated by tabs, by scope and key, after a header."""
    spark = rules.sparkSession
    leaf = leaf_of(F.col("tag"), F.col("subtag"))
    body = _rows(rules, 1, F.concat_ws("\t", "scope", "key"), F.lit(0),
                 F.concat_ws("\t", F.col("scope"), F.col("key"), leaf))
    return _fixed_lines(spark, 0, ["scope\tkey\tleaf"]).unionByName(body)


def rules_sieve(rules: DataFrame) -> DataFrame:
    """Sieve fileinto rules in the same order."""
    spark = rules.sparkSession
    leaf = leaf_of(F.col("tag"), F.col("subtag"))
    test = F.when(F.col("scope") == "domain", F.lit("address :domain :is")).otherwise(
        F.lit("address :is")
    )
    line = F.concat(F.lit("if "), test, F.lit(' "from" "'), F.col("key"),
                    F.lit('" { fileinto "'), leaf, F.lit('"; }'))
    body = _rows(rules, 1, F.concat_ws("\t", "scope", "key"), F.lit(0), line)
    return _fixed_lines(spark, 0, ['require ["fileinto"];', ""]).unionByName(body)


# --- senders and findings --------------------------------------------------------


def sender_report_lines(profiles: DataFrame, version: str, n: int) -> DataFrame:
    """Markdown table of the n top senders (n rows, ranked in one window)."""
    head = [
        f"# Top {n} senders", "", f"_Taxonomy version: {version}_", "",
        "| # | Sender | Domain | Count | Hint | Example subjects |",
        "|---|--------|--------|-------|------|------------------|",
    ]
    ranked = profiles.orderBy(*by_rank()).limit(n).withColumn(
        "rank", F.row_number().over(Window.orderBy(*by_rank()))
    )
    subjects = F.array_join(
        F.transform("example_subjects", lambda s: F.replace(s, F.lit("|"), F.lit("\\|"))), " · "
    )
    hint = F.coalesce(F.nullif("keyword_hint", F.lit("")), F.lit("—"))
    cells = [F.col("rank").cast("string"), F.col("from_addr"), F.col("from_domain"),
             F.col("message_count").cast("string"), hint, subjects]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = _rows(ranked, 1, F.lit(""), F.col("rank"), line)
    return _fixed_lines(profiles.sparkSession, 0, head).unionByName(body)


def audit_report_lines(findings: DataFrame) -> DataFrame:
    """Markdown table of all findings, by folder and uid."""
    spark = findings.sparkSession
    count = findings.agg(F.count("*").alias("n"))
    note = F.concat(
        F.lit("_"), F.col("n").cast("string"),
        F.lit(" contradiction(s) between assigned tag and keyword signals_"),
    )
    line = F.concat(
        F.lit("| "), F.col("folder"), F.lit(":"), F.col("uid").cast("string"), F.lit(" | "),
        F.col("assigned_tag"), F.lit(" | "), F.col("suspected_tag"), F.lit(" | "),
        F.array_join("trigger_keywords", ", "), F.lit(" |"),
    )
    table_head = [
        "", "| Folder:UID | Assigned | Suspected | Trigger keywords |",
        "|------------|----------|-----------|------------------|",
    ]
    return (
        _fixed_lines(spark, 0, ["# Audit findings", ""])
        .unionByName(_rows(count, 1, F.lit(""), F.lit(0), note))
        .unionByName(_fixed_lines(spark, 2, table_head))
        .unionByName(_rows(findings, 3, F.col("folder"), F.col("uid"), line))
    )


# --- summary page -------------------------------------------------------------------


def _percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f", F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)))


# What the page reads of the manifest.
PAGE_COLUMNS = ["folder", "uid", "from_addr", "subject", "tag", "method", "confidence"]


def summary_lines(messages: DataFrame, manifest: DataFrame, counts: DataFrame,
                  findings: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """The overview page.

    `manifest` has PAGE_COLUMNS, `counts` is tag_method_sender of it; both are best settled.
    Each of the tables is read twice at most, whatever the number of sections.
    """
    spark = messages.sparkSession
    cover = summary_coverage(messages, counts, findings)
    n = F.col("n").cast("string")

    def at(section: int, k1: Column, k2: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), k1.alias("k1"),
                        k2.cast("bigint").alias("k2"), text.alias("line"))

    def cover_line(section: int, pos: int, text: Column) -> Column:
        return at(section, F.lit(""), F.lit(pos), text)

    rest = F.when(F.col("unclassified") > 0, F.concat(
        F.lit("- …plus "), F.col("unclassified").cast("string"),
        F.lit(" unclassified message(s) to triage"),
    ))
    cover_rows = cover.select(F.inline(F.array(
        cover_line(1, 0, F.concat(F.lit("- Distinct messages: "),
                                  F.col("distinct_messages").cast("string"))),
        cover_line(1, 1, F.concat(
            F.lit("- Classified: "), F.col("classified").cast("string"), F.lit(" ("),
            _percent(F.col("classified"), F.col("distinct_messages")), F.lit("%)"))),
        cover_line(1, 2, F.concat(F.lit("- Unclassified: "), F.col("unclassified").cast("string"))),
        cover_line(1, 3, F.concat(F.lit("- Open audit findings: "),
                                  F.col("open_findings").cast("string"))),
        cover_line(10, 0, rest),
    ))).filter("line IS NOT NULL")

    # Few rows are left behind the ranks; the total of all methods is that of the page.
    facts = summary_facts(counts).withColumn("total", F.sum("n").over(Window.partitionBy("kind")))
    by_tag = F.array(
        at(3, F.lit(""), -F.col("n"), F.concat(F.lit("- "), F.col("tag"), F.lit(": "), n)),
        at(7, F.col("tag"), F.lit(0), F.concat(F.lit("### "), F.col("tag"))))
    by_method = F.array(at(5, F.lit(""), -F.col("n"), F.concat(
        F.lit("- "), F.col("method"), F.lit(": "), n, F.lit(" ("),
        _percent(F.col("n"), F.col("total")), F.lit("%)"))))
    by_sender = F.array(at(7, F.col("tag"), F.col("rank"), F.concat(
        F.lit("- "), F.col("from_addr"), F.lit(": "), n)))
    fact_rows = facts.select(F.inline(
        F.when(F.col("kind") == BY_TAG, by_tag).when(F.col("kind") == BY_METHOD, by_method).otherwise(by_sender)))

    low = lowest_confidence(manifest).withColumn(
        "pos", F.row_number().over(Window.orderBy("confidence", "folder", "uid"))
    )
    low_line = F.concat(
        F.lit("- ["), F.format_string("%.2f", "confidence"), F.lit("] "), F.col("tag"),
        F.lit(" — "), F.col("from_addr"), F.lit(": "), F.left("subject", F.lit(60)),
    )
    heads = [
        (0, ["# Inbox summary", "", f"_Taxonomy {taxonomy.version} ({taxonomy.content_hash})_",
             "", "## Coverage"]),
        (2, ["", "## Tag distribution"]), (4, ["", "## Method breakdown (rule leverage)"]),
        (6, ["", "## Top senders per tag"]), (8, ["", "## Needs review (lowest-confidence LLM calls)"]),
    ]
    parts = [_fixed_lines(spark, section, lines) for section, lines in heads]
    return reduce(DataFrame.unionByName, [
        *parts, cover_rows, fact_rows, _rows(low, 9, F.lit(""), F.col("pos"), low_line)])
