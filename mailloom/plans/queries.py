"""Registered queries: every operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailloom import taxonomy as tx
from mailloom.functions import reply as replying
from mailloom.functions import text as texts
from mailloom.functions.keywords import with_signals
from mailloom.functions.text import comma_text, iso_text, leaf_of
from mailloom.operators import audit as audits
from mailloom.operators import classify as classes
from mailloom.operators import decisions as deciding
from mailloom.operators import intake, model, reports, review, rules as ruling, senders, summary
from mailloom.plans import fixtures as fx, jobs
from mailloom.schemas import KEY
from mailloom.session import fresh_path, settled
from mailloom.sources import sinks, state as tables
from mailloom.sources.landing import read_raw, stream_raw
from mailloom.streaming.ingest import bounded_dedup as deduped_stream, start_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TAX = fx.TAXONOMY


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: iso_text(F.col(f.name)) for f in df.schema.fields
        if f.dataType.typeName() == "timestamp_ntz"
    })


def _text_lists(df: DataFrame, sep: str = ",") -> DataFrame:
    return df.withColumns({
        f.name: F.array_join(f.name, sep) for f in df.schema.fields
        if f.dataType.typeName() == "array"
    })


def _plain(df: DataFrame) -> DataFrame:
    return _text_lists(_text_dates(df))


SENDER_COLUMNS = [*KEY, "from_addr", "from_domain", "subject", "date", "keyword_hint"]


def _for_senders(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the message table that sender queries read, in two passes."""
    return settled(fx.messages(spark, sf).select(*SENDER_COLUMNS))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return fx.classifications(spark, sf)


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return classes.manifest(fx.messages(spark, sf), _log(spark, sf), TAX.content_hash)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.tag_method_sender(_manifest(spark, sf))


# --- sources, intake -------------------------------------------------------------------


@query
def scan_raw(spark, sf):
    """Raw mail landed as files and read back by its schema."""
    path = fresh_path(spark, "landing")
    fx.mail(spark, sf).write.parquet(path)
    return _plain(read_raw(spark, path).select("folder", "uid", "from_addr", "subject", "date", "size"))


@query
def clean_raw(spark, sf):
    return _plain(intake.clean_raw(fx.landed(spark, sf)))


@query
def normalize_messages(spark, sf):
    return _plain(intake.normalize_messages(fx.mail(spark, sf)))


@query
def keyword_hint(spark, sf):
    return fx.indexed(spark, sf).select("folder", "uid", "keyword_hint")


@query
def scan_messages(spark, sf):
    return _plain(fx.messages(spark, sf).drop("keyword_hint"))


@query
def incremental_scan(spark, sf):
    raw = fx.mail(spark, sf).select(*KEY, "subject")
    return intake.incremental_scan(raw, fx.cursor(spark, sf))


@query
def dedup_messages(spark, sf):
    return fx.messages(spark, sf).select(*KEY, "message_id", "subject")


@query
def first_seen_dedup(spark, sf):
    raw = fx.mail(spark, sf).select(*KEY, "message_id")
    return intake.first_seen(raw, fx.FOLDERS).groupBy("folder").agg(
        F.count("*").alias("kept"), F.sum("uid").alias("uid_sum"))


@query
def new_ids(spark, sf):
    raw = fx.mail(spark, sf)
    return intake.new_ids(raw, raw.filter("folder = 'INBOX'"))


@query
def upsert_messages(spark, sf):
    """All mail read again with new subjects and senders, over the deduped store."""
    again = fx.indexed(spark, sf).withColumns({
        "subject": F.concat(F.lit("Re: "), F.col("subject")), "from_addr": F.lit("new@new.org"),
        "size": F.lit(-1).cast("bigint"),
    })
    return _plain(intake.upsert_messages(fx.messages(spark, sf), again))


@query
def drop_folder(spark, sf):
    raw = fx.mail(spark, sf).select(*KEY, "fetched_at")
    rolled = settled(intake.rolled_over(intake.current_generations(raw), fx.cursor(spark, sf)))
    return intake.drop_folders(fx.messages(spark, sf), rolled).select(*KEY, "message_id")


@query
def advance_cursor(spark, sf):
    raw, cursor = fx.mail(spark, sf), fx.cursor(spark, sf)
    generations = intake.current_generations(raw.select(*KEY, "fetched_at"))
    stats = intake.fetch_stats(intake.incremental_scan(raw.select(*KEY), cursor))
    return _plain(intake.advance_cursor(stats, generations, cursor, fx.ntz(fx.RUN_TS)))


@query
def rollover(spark, sf):
    """A run after one folder changed its generation, over a store of all mail."""
    raw, cursor = fx.mail(spark, sf), fx.cursor(spark, sf)
    stored = fx.messages(spark, sf).withColumn(
        "uidvalidity",
        F.when(F.col("folder") == "Archive", F.lit(19).cast("bigint")).otherwise(F.col("uidvalidity")),
    )
    rolled = settled(intake.rolled_over(intake.current_generations(raw), cursor))
    kept = intake.drop_folders(stored, rolled)
    released = stored.join(rolled, "folder", "left_semi").select("folder", "message_id")
    batch = intake.index_messages(intake.incremental_scan(raw, cursor), TAX)
    fresh = intake.dedup_messages(batch, kept, fx.FOLDERS, released)
    return intake.upsert_messages(kept, fresh).select(*KEY, "message_id", "subject")


@query
def sync_metrics(spark, sf):
    raw, cursor = fx.mail(spark, sf), fx.cursor(spark, sf)
    fetched = intake.incremental_scan(raw, cursor)
    rolled = settled(intake.rolled_over(intake.current_generations(raw), cursor))
    fresh = intake.dedup_messages(fetched, None, fx.FOLDERS)
    return intake.sync_metrics(intake.fetch_stats(fetched), fresh, rolled)


@query
def message_count(spark, sf):
    return intake.message_count(fx.messages(spark, sf))


@query
def distinct_message_count(spark, sf):
    return intake.distinct_message_count(fx.messages(spark, sf))


@query
def flag_commands(spark, sf):
    return intake.flag_commands(fx.commands(spark, sf))


# --- streams ------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf: str) -> tables.State:
    """The stream run twice on one checkpoint; the second run finds nothing new."""
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    checkpoint = fresh_path(spark, "stream")
    for _ in range(2):
        docs = stream_raw(spark, f"{sf}/documents.parquet*", schema=fx.DOCUMENTS)
        start_ingest(fx.mail_of(docs), state, TAX, checkpoint, fx.FOLDERS,
                     lambda: datetime.fromisoformat(fx.RUN_TS)).awaitTermination()
    return state


@query
def stream_ingest(spark, sf):
    return _plain(tables.read_messages(spark, _streamed(spark, sf)))


@query
def stream_dedup(spark, sf):
    stored = tables.read_messages(spark, _streamed(spark, sf))
    return stored.groupBy("message_id").agg(F.count("*").alias("n"), F.min("uid").alias("first_uid"))


@query
def stream_metrics(spark, sf):
    return tables.read_metrics(spark, _streamed(spark, sf)).select(
        "folder", "fetched", "inserted", "deduped", "resynced")


# --- stored history ------------------------------------------------------------------------


def _history(spark: SparkSession, sf: str, compacted: bool = True) -> tables.State:
    """All mail in three runs, by uid modulo 3, with a compaction after the second."""
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    rows = settled(intake.index_messages(fx.mail(spark, sf), TAX, ("fetched_at",)))
    for i in range(3):
        jobs.ingest_indexed(spark, state, rows.filter(F.col("uid") % 3 == i),
                            datetime.fromisoformat(fx.RUN_TS), fx.FOLDERS, streamed=True)
        if i == 1 and compacted:
            jobs.compact(spark, state, vacuum=True)
    return state


@query
def compacted_messages(spark, sf):
    return _plain(tables.read_messages(spark, _history(spark, sf)))


@query
def compacted_ids(spark, sf):
    """Stored ids that a batch meets, here the mail of one folder."""
    ids = tables.read_ids(spark, _history(spark, sf))
    batch = fx.mail(spark, sf).filter("folder = 'Lists'").select("message_id").distinct()
    return ids.join(batch, "message_id", "left_semi").select("folder", "message_id")


@query
def maintained_profiles(spark, sf):
    return _subjects(jobs.sender_profiles(spark, _history(spark, sf)))


@query
def distinct_by_sketch(spark, sf):
    """The exact number of ids, and whether merged sketches come within three percent of it."""
    state = _history(spark, sf)
    estimate = jobs.distinct_messages(spark, state, approximate=True).select(
        F.col("distinct_messages").alias("estimate"))
    exact = jobs.distinct_messages(spark, state)
    off = F.abs(F.col("estimate") - F.col("distinct_messages"))
    return summary.side_by_side(exact, estimate).select(
        "distinct_messages", (off <= F.col("distinct_messages") * 0.03).alias("close"))


@query
def run_metrics(spark, sf):
    return tables.read_metrics(spark, _history(spark, sf)).drop("resynced")


@query
def batch_ingest(spark, sf):
    """Raw mail landed as files, read back by its schema and ingested in one run."""
    path = fresh_path(spark, "landing")
    fx.mail(spark, sf).write.parquet(path)
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    jobs.ingest(spark, state, read_raw(spark, path), TAX, datetime.fromisoformat(fx.RUN_TS), fx.FOLDERS)
    return tables.read_messages(spark, state).select(*KEY, "message_id", "keyword_hint")


@query
def bounded_dedup(spark, sf):
    """Mail as a stream, one row for each id within a watermark that spans all of it."""
    source, out = fresh_path(spark, "landing"), fresh_path(spark, "deduped")
    fx.mail(spark, sf).select("folder", "uidvalidity", "uid", "message_id", "fetched_at").write.parquet(source)
    schema = spark.read.parquet(source).schema
    rows = deduped_stream(stream_raw(spark, source, schema=schema), "3650 days")
    rows.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).groupBy("message_id").agg(F.count("*").alias("n"))


# --- taxonomies ------------------------------------------------------------------------------


@query
def taxonomy_frames(spark, sf):
    return tx.exploded_keywords(fx.taxonomy_rules(spark, sf))


@query
def valid_leaves(spark, sf):
    return tx.valid_leaves(fx.taxonomy_tags(spark, sf))


@query
def taxonomy_prompt(spark, sf):
    return tx.taxonomy_prompt(fx.taxonomy_tags(spark, sf))


@query
def taxonomy_budget(spark, sf):
    return tx.prompt_size(fx.taxonomy_tags(spark, sf), 150)


@query
def taxonomy_hash(spark, sf):
    return tx.taxonomy_hash(fx.taxonomy_tags(spark, sf), fx.taxonomy_rules(spark, sf))


# --- senders ------------------------------------------------------------------------------


def _subjects(df: DataFrame) -> DataFrame:
    return _text_dates(_text_lists(df, " ; "))


@query
def sender_profiles(spark, sf):
    return _subjects(senders.sender_profiles(_for_senders(spark, sf)))


@query
def dominant_hint(spark, sf):
    return senders.dominant_hint(fx.messages(spark, sf))


@query
def example_subjects(spark, sf):
    return _subjects(senders.example_subjects(fx.messages(spark, sf)))


@query
def sender_span(spark, sf):
    return _plain(senders.sender_span(fx.messages(spark, sf)))


@query
def top_senders(spark, sf):
    return _subjects(senders.top_senders(_for_senders(spark, sf)))


@query
def senders_matching(spark, sf):
    return _subjects(senders.senders_matching(_for_senders(spark, sf), "U3@SRC1"))


@query
def domain_rollup(spark, sf):
    return senders.domain_rollup(senders.top_senders(_for_senders(spark, sf), 50))


@query
def sender_report_lines(spark, sf):
    top = senders.top_senders(_for_senders(spark, sf), 20)
    return reports.sender_report_lines(top, TAX.version, 20)


# --- review, decisions -------------------------------------------------------------------------


def _queue(spark: SparkSession, sf: str, sender: str | None = None) -> DataFrame:
    queue = review.review_queue(_for_senders(spark, sf), fx.rules(spark, sf),
                                fx.deferrals(spark, sf), sender=sender)
    return _text_lists(queue, " ; ")


@query
def review_queue(spark, sf):
    return _queue(spark, sf)


@query
def review_queue_matching(spark, sf):
    return _queue(spark, sf, "src2")


@query
def queue_search(spark, sf):
    return review.queue_search(_queue(spark, sf), "SRC7")


def _numbered(ordered: DataFrame, *order) -> DataFrame:
    """Number the rows of a queue, which holds at most two per listed sender."""
    return ordered.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


@query
def queue_sort(spark, sf):
    rank = F.expr("CASE status WHEN 'decided' THEN 2 WHEN 'deferred' THEN 1 ELSE 0 END")
    return _numbered(_queue(spark, sf), rank, F.desc("message_count"), F.desc("scope"), "key").select(
        "pos", "scope", "key", "status", "message_count")


@query
def queue_sort_by(spark, sf):
    queue = review.queue_sort_by(_queue(spark, sf), "decision", descending=True)
    shown = F.coalesce(F.nullif("current_leaf", F.lit("")), "note")
    return _numbered(queue, shown.desc(), "scope", "key").select("pos", "scope", "key")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    hints = deciding.accept_hints(fx.messages(spark, sf), fx.decisions(spark, sf))
    return deciding.judge_decisions(fx.decisions(spark, sf), hints, TAX)


@query
def apply_decisions(spark, sf):
    """The log's rules, deferrals and rejected rows in one shape."""
    log = settled(_judged(spark, sf))
    null = F.lit(None).cast("string")
    parts = [
        deciding.rules_view(log).select(
            F.lit("rule").alias("kind"), "scope", "key",
            leaf_of(F.col("tag"), F.col("subtag")).alias("leaf"), null.alias("note"),
            F.col("confirmed_at").alias("at")),
        deciding.deferrals_view(log).select(
            F.lit("deferral").alias("kind"), "scope", "key", null.alias("leaf"), "note",
            F.col("created_at").alias("at")),
        log.filter("rejected IS NOT NULL").select(
            F.lit("rejected").alias("kind"), "scope", "key", "leaf",
            F.col("rejected").alias("note"), F.col("decided_at").alias("at")),
    ]
    return _text_dates(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def parse_leaf(spark, sf):
    given = fx.decisions(spark, sf).filter("leaf IS NOT NULL").select("seq", "leaf")
    return deciding.parse_leaf(given, TAX)


# --- rules -----------------------------------------------------------------------------------


@query
def rule_leaf(spark, sf):
    return ruling.with_leaf(fx.rules(spark, sf)).select("scope", "key", "leaf")


@query
def invalid_rules(spark, sf):
    return ruling.invalid_rules(fx.rules(spark, sf), TAX).select("scope", "key", "leaf")


@query
def mark_stale_rules(spark, sf):
    return ruling.mark_stale_rules(fx.rules(spark, sf), TAX).select("scope", "key", "stale")


@query
def stale_rules(spark, sf):
    """Keyword-rule tags of all versions as rules, with every leaf but 'junk'."""
    rules = fx.taxonomy_rules(spark, sf).select("version", "tag", F.lit("").alias("subtag"))
    leaves = tx.valid_leaves(fx.taxonomy_tags(spark, sf)).filter("leaf != 'junk'")
    return ruling.stale_rules(rules, leaves).select("version", "leaf")


def _resolved(spark: SparkSession, sf: str, authoritative: bool) -> DataFrame:
    return ruling.resolve_rules(fx.messages(spark, sf), fx.rules(spark, sf), TAX, authoritative)


@query
def resolve_rules(spark, sf):
    return _resolved(spark, sf, True).select(
        *KEY, F.col("resolved_tag").alias("tag"), F.col("resolved_subtag").alias("subtag"),
        "method", "confidence")


@query
def resolve_rules_advisory(spark, sf):
    return _resolved(spark, sf, False).select(
        *KEY, F.col("resolved_tag").alias("tag"), "method", "confidence")


@query
def resolve_many_rules(spark, sf):
    """As resolve_rules, by the joins that a rule table beyond a broadcast takes."""
    return ruling.resolve_rules(fx.messages(spark, sf), fx.rules(spark, sf), TAX, max_rows=0).select(
        *KEY, F.col("resolved_tag").alias("tag"), F.col("resolved_subtag").alias("subtag"),
        "method", "confidence")


@query
def first_rule(spark, sf):
    """The first rule that the audit sees in subject and snippet, with its keywords."""
    texts_ = fx.indexed(spark, sf).select(*KEY, "subject", "snippet")
    first = F.get("signals", F.lit(0))
    return with_signals(texts_, TAX).filter(first.isNotNull()).select(
        *KEY, first["suspected_tag"].alias("suspected_tag"),
        F.array_join(first["trigger_keywords"], ",").alias("trigger_keywords"))


@query
def coverage(spark, sf):
    out = ruling.coverage(fx.messages(spark, sf), fx.rules(spark, sf), TAX)
    return out.withColumn("fraction", F.round("fraction", 6))


@query
def rules_tsv(spark, sf):
    return reports.rules_tsv(fx.rules(spark, sf))


@query
def rules_sieve(spark, sf):
    return reports.rules_sieve(fx.rules(spark, sf))


# --- classification log --------------------------------------------------------------------------


@query
def append_classification(spark, sf):
    """Two runs appended to a state folder, the second one twice, then read back."""
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    log = _log(spark, sf).filter(F.col("taxonomy_hash") == TAX.content_hash)
    for run in (1, 2, 2):
        tables.append_classification(log.filter(F.col("run_seq") == run), state,
                                     TAX.content_hash, run)
    return _plain(tables.read_classifications(spark, state))


@query
def latest_classification(spark, sf):
    return _plain(classes.latest_classification(_log(spark, sf), TAX.content_hash))


@query
def latest_tag(spark, sf):
    return classes.latest_tag(fx.messages(spark, sf).select(*KEY), _log(spark, sf),
                              TAX.content_hash)


@query
def classified_count(spark, sf):
    return classes.classified_count(_log(spark, sf))


@query
def classify_rules(spark, sf):
    return _plain(classes.classify_rules(
        fx.messages(spark, sf), fx.rules(spark, sf), _log(spark, sf), TAX, fx.ntz(fx.RUN_TS), 9))


@query
def classify_metrics(spark, sf):
    return classes.classify_metrics(settled(fx.messages(spark, sf)), fx.rules(spark, sf), _log(spark, sf), TAX)


@query
def manifest(spark, sf):
    return classes.flat_manifest(_manifest(spark, sf))


@query
def manifest_parquet(spark, sf):
    path = fresh_path(spark, "manifest")
    sinks.write_manifest_parquet(_manifest(spark, sf), path)
    return classes.flat_manifest(spark.read.parquet(path))


@query
def manifest_csv(spark, sf):
    path = fresh_path(spark, "manifest")
    rows = _manifest(spark, sf)
    sinks.write_manifest_csv(rows, path)
    return sinks.read_manifest_csv(spark, path, classes.flat_manifest(rows).schema)


# --- audit, summary ------------------------------------------------------------------------------


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit(fx.messages(spark, sf), _log(spark, sf), TAX)


@query
def audit(spark, sf):
    return _plain(_findings(spark, sf))


@query
def open_findings(spark, sf):
    return audits.open_findings(_findings(spark, sf))


@query
def replace_findings(spark, sf):
    """The audit run twice on a state folder leaves one set of findings."""
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    for _ in range(2):
        tables.replace_findings(_findings(spark, sf), state)
    return _plain(tables.read_findings(spark, state))


@query
def audit_report_lines(spark, sf):
    return reports.audit_report_lines(settled(_findings(spark, sf)))


@query
def tag_distribution(spark, sf):
    return summary.tag_distribution(_counts(spark, sf))


@query
def method_breakdown(spark, sf):
    return summary.method_breakdown(_counts(spark, sf)).withColumn("share", F.round("share", 6))


@query
def top_senders_per_tag(spark, sf):
    return summary.top_senders_per_tag(_counts(spark, sf))


@query
def lowest_confidence(spark, sf):
    return summary.lowest_confidence(_manifest(spark, sf))


@query
def summary_facts(spark, sf):
    return summary.summary_facts(_counts(spark, sf))


@query
def summary_coverage(spark, sf):
    messages, log = settled(fx.messages(spark, sf)), settled(_log(spark, sf))
    counts = summary.tag_method_sender(classes.manifest(messages, log, TAX.content_hash))
    return summary.summary_coverage(
        messages, counts, audits.audit(messages, log, TAX)
    ).withColumn("percent", F.round("percent", 6))


@query
def status_coverage(spark, sf):
    ids = settled(fx.messages(spark, sf).select("message_id"))
    return summary.status_coverage(ids, _log(spark, sf)).withColumn(
        "percent", F.round("percent", 6))


@query
def folder_status(spark, sf):
    folders = fx.mail(spark, sf).select("folder").distinct()
    return summary.folder_status(folders, fx.cursor(spark, sf))


@query
def summary_lines(spark, sf):
    messages, log = settled(fx.messages(spark, sf)), settled(_log(spark, sf))
    rows = settled(classes.manifest(messages, log, TAX.content_hash).select(*reports.PAGE_COLUMNS))
    counts = settled(summary.tag_method_sender(rows))
    return reports.summary_lines(messages, rows, counts, audits.audit(messages, log, TAX), TAX)


# --- model path -----------------------------------------------------------------------------------


@query
def token_estimate(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", texts.token_estimate(F.col("text")).alias("tokens"))


@query
def build_payload(spark, sf):
    return model.build_payload(fx.messages(spark, sf), TAX, fx.PAYLOAD_BUDGET, KEY)


@query
def prompt_budget(spark, sf):
    payloads = model.build_payload(fx.messages(spark, sf), TAX, keep=KEY)
    return model.prompt_budget(payloads, TAX, 400)


@query
def reply_json(spark, sf):
    return fx.replies(spark, sf).select(
        *KEY, "attempt", replying.reply_json(F.col("raw")).alias("json"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return replying.with_parsed_reply(fx.replies(spark, sf), "raw")


@query
def parse_reply(spark, sf):
    return _parsed(spark, sf).select(
        *KEY, "attempt", F.col("reply").isNotNull().alias("valid"), "reply.tag",
        comma_text(F.col("reply.subtags")).alias("subtags"), "reply.confidence", "reply.rationale")


@query
def reply_outcome(spark, sf):
    return replying.with_outcome(_parsed(spark, sf), TAX).select(
        *KEY, "attempt", "tag", "subtag", "confidence", "rationale")


@query
def abstain(spark, sf):
    return replying.abstain(replying.with_outcome(_parsed(spark, sf), TAX)).select(
        *KEY, "attempt", "tag", "subtag", "confidence", "rationale")


@query
def complete(spark, sf):
    payloads = model.build_payload(fx.messages(spark, sf), TAX, keep=KEY)
    return model.replay(payloads, fx.replies(spark, sf), 1, "raw").select(*KEY, "truncated", "raw")


@query
def complete_map(spark, sf):
    """Replies of a list completer, called in tasks over Arrow batches."""
    payloads = model.build_payload(fx.messages(spark, sf), TAX, keep=KEY)
    return model.complete(payloads, fx.answer_by_length, TAX.system_prompt(), "raw", listed=16).select(
        *KEY, "truncated", "raw")


@query
def model_run(spark, sf):
    """A chunked model run over a stored state: what it appends to the log."""
    state = tables.init_state(spark, tables.State(fresh_path(spark, "state")))
    jobs.ingest_indexed(spark, state, settled(intake.index_messages(fx.mail(spark, sf), TAX, ("fetched_at",))),
                        datetime.fromisoformat(fx.RUN_TS), fx.FOLDERS)
    jobs.classify_llm_batch(spark, state, TAX, fx.MODEL_ID, datetime.fromisoformat(fx.RUN_TS), fx.answer_by_length,
                            chunk_rows=max(1, tables.read_messages(spark, state).count() // 5), listed=16)
    return _plain(tables.read_classifications(spark, state).drop("run_seq"))


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    return classes.llm_residue(fx.messages(spark, sf), fx.rules(spark, sf), _log(spark, sf), TAX,
                               keyword_authoritative=False)


@query
def llm_residue(spark, sf):
    return _residue(spark, sf).select(*KEY, "keyword_hint")


@query
def llm_limit(spark, sf):
    return classes.llm_limit(_residue(spark, sf), 40).select(*KEY)


@query
def classify_llm(spark, sf):
    payloads = model.build_payload(fx.messages(spark, sf), TAX, fx.PAYLOAD_BUDGET, KEY)
    return model.classify_llm(payloads, TAX, fx.MODEL_ID, replies=fx.replies(spark, sf))


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return model.classify_llm_batch(
        _residue(spark, sf), TAX, fx.MODEL_ID, fx.ntz(fx.RUN_TS), 9,
        replies=fx.replies(spark, sf), budget=fx.PAYLOAD_BUDGET)


@query
def classify_llm_batch(spark, sf):
    return _plain(_batch(spark, sf))


@query
def llm_metrics(spark, sf):
    return model.llm_metrics(_batch(spark, sf))
