"""The jobs a user runs, over a State folder on shared storage.

Each job plans with the operators and writes once; drivers see counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mailloom import fixed
from mailloom.operators import audit as audits
from mailloom.operators import classify as classes
from mailloom.operators import intake, model, reports, review, rules as ruling, senders, summary
from mailloom.operators.decisions import accept_hints, judge_decisions
from mailloom.schemas import CURSOR, KEY, MESSAGE
from mailloom.session import fresh_path, observed, settled
from mailloom.sources import sinks, state as tables
from mailloom.sources.state import State
from mailloom.taxonomy import Taxonomy


# What a payload is made of.
PAYLOAD = ["from_addr", "subject", "date", "snippet"]


def _stamp(at: datetime):
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


# --- ingest ---------------------------------------------------------------------------


def ingest(spark: SparkSession, state: State, raw: DataFrame, taxonomy: Taxonomy,
           run_ts: datetime, folders: list[str] | None = None, full: bool = False,
           refresh: bool = False) -> DataFrame:
    """Index new raw messages; returns fetched, inserted, deduped, resynced per folder.

    Resumes behind the cursor of each folder. `full` reads from the start and
    rewrites the folders of the run; with `refresh` known messages take the new
    subject, snippet and hint.
    """
    rows = intake.index_messages(raw, taxonomy, ("fetched_at",))
    return ingest_indexed(spark, state, rows, run_ts, folders, full, refresh)


def ingest_indexed(spark: SparkSession, state: State, rows: DataFrame, run_ts: datetime,
                   folders: list[str] | None = None, full: bool = False, refresh: bool = False,
                   streamed: bool = False) -> DataFrame:
    """Ingest of rows that are indexed already (message columns and fetched_at).

    A stream resumes by its own checkpoint, so it skips known keys instead of low
    uids, which may arrive late.
    """
    rows = rows.filter("uid > 0")  # batch and stream alike; no mail has uid 0
    if folders:
        rows = rows.filter(F.col("folder").isin(folders))
    now = _stamp(run_ts)
    head = tables.read_head(spark, state)
    run = head.batch + 1
    cursor = tables.read_cursor(spark, state, head)
    # Tables of one row per folder, written so that their true size is known: the
    # joins by folder then broadcast them and a hot folder is never shuffled.
    span = Observation()
    marked = rows.observe(span, F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    generations, seen = observed(intake.generation_state(marked, cursor, now),
                                 F.count_if("rolled").alias("rolled"))
    rolled = generations.filter("rolled").select("folder")
    current = rows.join(generations, ["folder", "uidvalidity"], "left_semi")
    if streamed:
        # Keys of a dropped folder are of another generation, so none of them is met. What is
        # new of a micro-batch is written once, so that later steps repeat no join.
        known = tables.stored_keys(spark, state, span.get.get("lo"), span.get.get("hi"), head)
        fetched, sums = observed(current.join(known, KEY, "left_anti").select(*MESSAGE.names),
                                 F.count(F.lit(1)).alias("fetched"))
        stats = intake.fetch_stats(fetched)
    else:
        fetched = intake.incremental_scan(current, cursor, full)
        stats, sums = observed(intake.fetch_stats(fetched), F.sum("fetched").alias("fetched"))
    n = sums.get("fetched") or 0
    batch = fetched.select(*MESSAGE.names)
    if full:
        kept = intake.drop_folders(tables.read_messages(spark, state, head), rolled)
    if full and refresh:
        fresh = intake.dedup_refresh(batch, kept.select(*KEY, "message_id"), folders)
    else:
        # What is stored under the ids of this batch; a small batch reads little of it.
        met = tables.stored_ids(spark, state, batch, n, head)
        released = None
        if seen.get("rolled"):
            released = met.join(rolled, "folder", "left_semi")
            met = intake.drop_folders(met, rolled)
        fresh = intake.dedup_messages(batch, met, folders, released)
    fresh = fresh.select(*MESSAGE.names)
    if full:
        fresh = settled(fresh)
        own = kept.join(generations.select("folder"), "folder", "left_semi")
        tables.write_batch(intake.upsert_messages(own, fresh), state, "messages", run)
    else:
        tables.write_batch(fresh, state, "messages", run)
        fresh = spark.read.schema(MESSAGE).parquet(state.path("messages", f"batch_id={run}"))
    ledger = settled(intake.run_ledger(stats, fresh, generations, cursor))
    tables.write_batch(intake.metrics_of(ledger), state, "metrics", run)
    tables.commit_cursor(intake.cursor_of(ledger, now, full, run), state, run)
    return tables.read_metrics(spark, state).filter(F.col("batch_id") == run).drop("batch_id")


# --- review ------------------------------------------------------------------------------


def sender_report(spark: SparkSession, state: State, taxonomy: Taxonomy, path: str,
                  n: int = fixed.TOP_SENDERS) -> None:
    top = senders.merged_top_senders(tables.read_profile_partials(spark, state), n)
    sinks.write_lines(reports.sender_report_lines(top, taxonomy.version, n), path)


def review_queue(spark: SparkSession, state: State, n: int = fixed.TOP_SENDERS,
                 sender: str | None = None) -> DataFrame:
    return review.review_queue(
        tables.read_messages(spark, state), tables.read_rules(spark, state),
        tables.read_deferrals(spark, state), n, sender,
    )


def apply_decisions(spark: SparkSession, state: State, decisions: DataFrame,
                    taxonomy: Taxonomy) -> DataFrame:
    """Append decisions to the log; returns those of this run that were rejected."""
    queue = accept_hints(tables.read_messages(spark, state), decisions)
    run = tables.next_run(spark, state, "decisions")
    tables.append_decisions(judge_decisions(decisions, queue, taxonomy), state, run)
    written = spark.read.parquet(state.path("decisions", f"run_seq={run}"))
    return written.filter("rejected IS NOT NULL")


def coverage(spark: SparkSession, state: State, taxonomy: Taxonomy,
             keyword_authoritative: bool = True) -> DataFrame:
    rules = settled(tables.read_rules(spark, state))
    return ruling.coverage(tables.read_messages(spark, state), rules, taxonomy,
                           keyword_authoritative)


# --- classify -----------------------------------------------------------------------------


def classify_rules(spark: SparkSession, state: State, taxonomy: Taxonomy, run_ts: datetime,
                   keyword_authoritative: bool = True) -> DataFrame:
    """Append what the rules decide; returns scanned, written, unchanged, uncovered."""
    messages = tables.read_messages(spark, state)
    rules = settled(tables.read_rules(spark, state))
    log = tables.read_classifications(spark, state)
    run = tables.next_run(spark, state)
    count = classes.RulesCount()
    records = classes.classify_rules(messages, rules, log, taxonomy, _stamp(run_ts), run,
                                     keyword_authoritative, count)
    tables.append_classification(records, state, taxonomy.content_hash, run)
    names = ["scanned", "written", "unchanged", "uncovered"]
    values = count.values()
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} BIGINT" for n in names))


def _in_chunks(residue: DataFrame, rows: int, chunk_rows: int) -> tuple[DataFrame, int]:
    """The residue in the shared folder, one partition folder for each chunk of about
    `chunk_rows` messages, so that a chunk reads its own rows only."""
    spark = residue.sparkSession
    chunks = -(-rows // chunk_rows)
    path = fresh_path(spark, "residue")
    dealt = residue.withColumn("chunk", F.pmod(F.xxhash64(*KEY), F.lit(max(chunks, 1))).cast("int"))
    dealt.repartition("chunk").write.partitionBy("chunk").parquet(path)
    schema = StructType([*residue.schema.fields, StructField("chunk", IntegerType())])
    return spark.read.schema(schema).parquet(path), chunks


def classify_llm_batch(spark: SparkSession, state: State, taxonomy: Taxonomy, model_id: str,
                       run_ts: datetime, factory: model.CompleterFactory | None = None,
                       replies: DataFrame | None = None, limit: int | None = None,
                       keyword_authoritative: bool = True,
                       threshold: float = fixed.CONFIDENCE_THRESHOLD,
                       partitions: int | None = None, chunk_rows: int = 50_000, listed: int = 0,
                       budget: int = fixed.PAYLOAD_TOKEN_BUDGET,
                       on_chunk: Callable[[int, int], None] | None = None) -> DataFrame:
    """Send the residue to the model once and append; returns called, unclassified.

    The residue goes in chunks of about `chunk_rows`, each committed as a run of its own:
    a job that is killed keeps its chunks, and the next one does not call them again.
    Between chunks the residue is taken anew, so what another writer has classified is not
    sent. `partitions` sets over how many tasks the calls of a chunk are spread, `listed`
    how many payloads a list completer gets at once. `on_chunk(called, total)` tells progress.
    """
    messages = tables.read_messages(spark, state)
    rules = settled(tables.read_rules(spark, state))
    head = tables.read_head(spark, state)
    log = tables.read_classifications(spark, state, head)
    residue = classes.llm_limit(
        classes.llm_residue(messages, rules, log, taxonomy, keyword_authoritative), limit
    ).select(*KEY, *PAYLOAD)
    waiting, sums = observed(residue, F.count(F.lit(1)).alias("n"))
    total = sums.get("n") or 0
    dealt, chunks = _in_chunks(waiting, total, chunk_rows) if total > chunk_rows else (
        waiting.withColumn("chunk", F.lit(0)), min(total, 1))
    called = unclassified = 0
    for chunk in range(chunks):
        since = tables.read_classifications(spark, state).filter(F.col("run_seq") > head.classifications)
        open_ = classes.without_record(dealt.filter(F.col("chunk") == chunk).drop("chunk"), since,
                                       taxonomy.content_hash)
        open_ = open_.repartition(partitions or spark.sparkContext.defaultParallelism)
        run = tables.next_run(spark, state)
        records = model.classify_llm_batch(open_, taxonomy, model_id, _stamp(run_ts), run, factory,
                                           replies, threshold, budget, listed)
        count = Observation()
        tables.append_classification(records.observe(count, *model.llm_counts()), state,
                                     taxonomy.content_hash, run)
        called += count.get.get("called") or 0
        unclassified += count.get.get("unclassified") or 0
        if on_chunk:
            on_chunk(called, total)
    return spark.createDataFrame([(called, unclassified)], "called BIGINT, unclassified BIGINT")


# --- exports, audit, summary ------------------------------------------------------------------


def manifest(spark: SparkSession, state: State, taxonomy: Taxonomy) -> DataFrame:
    return classes.manifest(tables.read_messages(spark, state),
                            tables.read_classifications(spark, state), taxonomy.content_hash)


def export_manifest(spark: SparkSession, state: State, taxonomy: Taxonomy, path: str) -> None:
    """manifest.parquet and manifest.csv; the twin is made from the parquet files."""
    sinks.write_manifest_parquet(manifest(spark, state, taxonomy), f"{path}/manifest.parquet")
    rows = spark.read.parquet(f"{path}/manifest.parquet")
    sinks.write_manifest_csv(rows, f"{path}/manifest.csv")


def export_rules(spark: SparkSession, state: State, path: str, fmt: str = "text") -> None:
    rules = tables.read_rules(spark, state)
    lines = reports.rules_sieve(rules) if fmt == "sieve" else reports.rules_tsv(rules)
    sinks.write_lines(lines, f"{path}/rules.sieve" if fmt == "sieve" else f"{path}/rules.tsv")


def audit(spark: SparkSession, state: State, taxonomy: Taxonomy, path: str | None = None) -> DataFrame:
    """Replace the findings; write their report where a path is given."""
    found = audits.audit(tables.read_messages(spark, state),
                         tables.read_classifications(spark, state), taxonomy)
    tables.replace_findings(found, state)
    findings = tables.read_findings(spark, state)
    if path:
        sinks.write_lines(reports.audit_report_lines(findings), path)
    return findings


def write_summary(spark: SparkSession, state: State, taxonomy: Taxonomy, path: str) -> None:
    # The manifest is evaluated once, in the columns that the page reads.
    rows = settled(manifest(spark, state, taxonomy).select(*reports.PAGE_COLUMNS))
    counts = settled(summary.tag_method_sender(rows))
    lines = reports.summary_lines(tables.read_messages(spark, state), rows, counts,
                                  tables.read_findings(spark, state), taxonomy)
    sinks.write_lines(lines, path)


def status(spark: SparkSession, state: State, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coverage over all taxonomies, and the state of each configured folder."""
    names = spark.createDataFrame([(f,) for f in folders], "folder STRING")
    head = tables.read_head(spark, state)
    return (
        summary.status_coverage(tables.read_messages(spark, state, head),
                                tables.read_classifications(spark, state, head)),
        summary.folder_status(names, tables.read_cursor(spark, state, head)),
    )


def taxonomy_status(spark: SparkSession, state: State, taxonomy: Taxonomy) -> DataFrame:
    """Version and hash of the taxonomy in use, and how many messages have a record under it."""
    log = tables.read_classifications(spark, state).filter(F.col("taxonomy_hash") == taxonomy.content_hash)
    return classes.classified_count(log).select(
        F.lit(taxonomy.version).alias("taxonomy_version"),
        F.lit(taxonomy.content_hash).alias("taxonomy_hash"), "classified")


# --- upkeep -------------------------------------------------------------------------------------


def compact(spark: SparkSession, state: State, vacuum: bool = False) -> tables.Head:
    """Merge committed runs; with `vacuum` delete what no reader of the new head opens."""
    head = tables.compact(spark, state)
    if vacuum:
        tables.vacuum(spark, state)
    return head


def sender_profiles(spark: SparkSession, state: State) -> DataFrame:
    """All sender profiles, from stored partials and the runs since; no message of the base is read."""
    return senders.merged_profiles(tables.read_profile_partials(spark, state))


def distinct_messages(spark: SparkSession, state: State, approximate: bool = False) -> DataFrame:
    """Distinct Message-IDs: exact, or by sketches without reading the messages of the base."""
    if approximate:
        return intake.distinct_message_estimate(tables.read_id_sketches(spark, state))
    return intake.distinct_message_count(tables.read_messages(spark, state))
