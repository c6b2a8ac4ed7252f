from __future__ import annotations

import glob
from datetime import datetime, timedelta

from conftest import DAY, rows_of

from mailloom.plans import jobs
from mailloom.schemas import DECISION
from mailloom.sources import landing, state as tables
from mailloom.streaming.ingest import bounded_dedup, start_ingest

T0 = datetime(2026, 2, 1)
ORDER = ["INBOX", "Archive"]


def page(path):
    return [line.rstrip("\n") for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f)]


def ingest(spark, state, tax, raw, **kw):
    out = jobs.ingest(spark, state, raw, tax, kw.pop("at", T0), kw.pop("folders", ORDER), **kw)
    return {r.folder: tuple(r)[1:] for r in out.collect()}


def live(spark, state, *columns):
    return rows_of(tables.read_messages(spark, state), *columns)


def test_resume(spark, state, make, tax):
    rows = [("INBOX", 10, 1, "a"), ("INBOX", 10, 2, "b")]
    assert ingest(spark, state, tax, make.raw(rows)) == {"INBOX": (2, 2, 0, False)}
    more = [*rows, ("INBOX", 10, 3, "c")]
    assert ingest(spark, state, tax, make.raw(more)) == {"INBOX": (1, 1, 0, False)}
    assert ingest(spark, state, tax, make.raw(more)) == {}
    assert live(spark, state, "uid") == [(1,), (2,), (3,)]
    assert rows_of(tables.read_cursor(spark, state), "folder", "last_uid") == [("INBOX", 3)]


def test_dedup_over_runs_and_cursor_passes_duplicates(spark, state, make, tax):
    ingest(spark, state, tax, make.raw([("INBOX", 10, 1, "shared")]))
    got = ingest(spark, state, tax, make.raw([("Archive", 20, 1, "unique"), ("Archive", 20, 2, "shared")]))
    assert got == {"Archive": (2, 1, 1, False)}
    assert rows_of(tables.read_cursor(spark, state), "folder", "last_uid") == [
        ("Archive", 2), ("INBOX", 1)]


def test_rollover_and_back(spark, state, make, tax):
    def raw(validity, ids, day):
        return make.raw([("INBOX", validity, i, m, "", "a@x.com", "", DAY + timedelta(day))
                         for i, m in enumerate(ids, 1)])

    ingest(spark, state, tax, raw(10, "ab", 0))
    assert ingest(spark, state, tax, raw(99, "xy", 1)) == {"INBOX": (2, 2, 0, True)}
    assert live(spark, state, "uidvalidity", "message_id") == [(99, "x"), (99, "y")]
    # A lower number is a new generation as well; the first one stays dead.
    assert ingest(spark, state, tax, raw(10, "p", 2)) == {"INBOX": (1, 1, 0, True)}
    assert live(spark, state, "uidvalidity", "message_id") == [(10, "p")]
    # Late rows of an older generation change nothing.
    ingest(spark, state, tax, raw(99, "xyz", 1))
    assert live(spark, state, "uidvalidity", "message_id") == [(10, "p")]


def test_rolled_ids_are_free_again(spark, state, make, tax):
    ingest(spark, state, tax, make.raw([("Archive", 1, 1, "x")]))
    later = DAY + timedelta(1)
    got = ingest(spark, state, tax, make.raw([
        ("INBOX", 1, 1, "x", "", "a@x.com", "", later), ("Archive", 2, 1, "x", "", "a@x.com", "", later)]))
    # INBOX is taken before Archive is dropped, so the id is still known there.
    assert got == {"INBOX": (1, 0, 1, False), "Archive": (1, 1, 0, True)}


def test_full_run(spark, state, make, tax):
    first = [("INBOX", 1, 1, "a", "old"), ("INBOX", 1, 2, "", "old")]
    ingest(spark, state, tax, make.raw([*first, ("Archive", 1, 1, "z", "old")]))
    again = make.raw([("INBOX", 1, 1, "a", "new"), ("INBOX", 1, 2, "", "new"), ("INBOX", 1, 3, "c", "new")])
    assert ingest(spark, state, tax, again, full=True) == {"INBOX": (3, 2, 1, False)}
    assert live(spark, state, "folder", "uid", "subject") == [
        ("Archive", 1, "old"), ("INBOX", 1, "old"), ("INBOX", 2, "new"), ("INBOX", 3, "new")]
    assert ingest(spark, state, tax, again, full=True, refresh=True) == {"INBOX": (3, 3, 0, False)}
    assert live(spark, state, "folder", "uid", "subject")[1] == ("INBOX", 1, "new")


def test_half_written_run_is_invisible(spark, state, make, tax):
    ingest(spark, state, tax, make.raw([("INBOX", 1, 1, "a")]))
    lost = tables.read_messages(spark, state)
    tables.write_batch(lost, state, "messages", 2)  # no cursor row follows
    assert live(spark, state, "uid") == [(1,)]
    ingest(spark, state, tax, make.raw([("INBOX", 1, 1, "a"), ("INBOX", 1, 2, "b")]))
    assert live(spark, state, "uid") == [(1,), (2,)]


def test_whole_flow(spark, state, make, tax, tmp_path):
    ingest(spark, state, tax, make.raw([
        ("INBOX", 10, 1, "a", "SALE, now 30% off", "offers@store.net"),
        ("INBOX", 10, 2, "b", "invoice no 7", "billing@lender.org"),
        ("INBOX", 10, 3, "c", "hello, \"there\"", "ann@pals.net"),
        ("INBOX", 10, 4, "", "Big sale unsubscribe", "boss@work.com"),
    ]))
    decide = spark.createDataFrame([
        ("boss@work.com", "addr", "set", "keep", None, "me", T0, 1),
        ("lender.org", "domain", "set", "receipt/bank", None, "me", T0, 2),
        ("pals.net", "domain", "defer", None, "ask", "me", T0, 3),
        ("ann@pals.net", "addr", "accept", None, None, "me", T0, 4),
        ("offers@store.net", "addr", "accept", None, None, "me", T0, 5),
    ], DECISION)
    assert rows_of(jobs.apply_decisions(spark, state, decide, tax), "key", "rejected") == [
        ("ann@pals.net", "no hint")]
    queue = {(r.scope, r.key): (r.status, r.current_leaf) for r in jobs.review_queue(spark, state).collect()}
    assert queue[("domain", "pals.net")] == ("deferred", None)
    assert queue[("addr", "offers@store.net")] == ("decided", "junk")
    assert jobs.coverage(spark, state, tax).first()["covered"] == 3

    assert tuple(jobs.classify_rules(spark, state, tax, T0).first()) == (4, 3, 0, 1)
    assert tuple(jobs.classify_rules(spark, state, tax, T0).first()) == (4, 0, 3, 1)
    answer = '{"tag":"notification","confidence":0.72,"rationale":"r"}'
    factory = lambda: lambda system, user, sampling: answer
    run = dict(model_id="m", run_ts=T0 + timedelta(1), factory=factory, limit=5, partitions=2)
    assert tuple(jobs.classify_llm_batch(spark, state, tax, **run).first()) == (1, 0)
    assert tuple(jobs.classify_llm_batch(spark, state, tax, **run).first()) == (0, 0)

    for _ in range(2):
        findings = jobs.audit(spark, state, tax, str(tmp_path / "audit"))
    assert rows_of(findings, "uid", "suspected_tag") == [(4, "junk")]
    assert page(tmp_path / "audit")[2] == "_1 contradiction(s) between assigned tag and keyword signals_"
    assert page(tmp_path / "audit")[-1] == "| INBOX:4 | keep | junk | unsubscribe, sale |"

    jobs.export_manifest(spark, state, tax, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out/manifest.parquet"))
    assert rows.count() == 4 and len(rows.columns) == 17
    header = page(tmp_path / "out/manifest.csv")[0]
    assert header.startswith("folder,uid,message_id,from_addr")

    jobs.export_rules(spark, state, str(tmp_path / "out"))
    assert page(tmp_path / "out/rules.tsv") == [
        "scope\tkey\tleaf", "addr\tboss@work.com\tkeep", "addr\toffers@store.net\tjunk",
        "domain\tlender.org\treceipt/bank"]
    jobs.export_rules(spark, state, str(tmp_path / "out"), "sieve")
    assert page(tmp_path / "out/rules.sieve")[:3] == [
        'require ["fileinto"];', "", 'if address :is "from" "boss@work.com" { fileinto "keep"; }']
    assert page(tmp_path / "out/rules.sieve")[-1] == (
        'if address :domain :is "from" "lender.org" { fileinto "receipt/bank"; }')

    jobs.sender_report(spark, state, tax, str(tmp_path / "senders"), 2)
    assert page(tmp_path / "senders")[0] == "# Top 2 senders" and len(page(tmp_path / "senders")) == 8

    jobs.write_summary(spark, state, tax, str(tmp_path / "summary"))
    text = page(tmp_path / "summary")
    assert "- Classified: 4 (100.0%)" in text and "- Open audit findings: 1" in text
    assert "- sender_rule: 3 (75.0%)" in text and "### notification" in text
    assert '- [0.72] notification — ann@pals.net: hello, "there"' in text
    assert not any("to triage" in line for line in text)

    cover, folders = jobs.status(spark, state, ["INBOX", "Nowhere"])
    assert cover.first()["classified"] == 4
    assert rows_of(folders) == [("INBOX", "complete", 10, 4), ("Nowhere", "not synced", None, None)]


def test_stale_rule_is_ignored(spark, state, make, tax):
    ingest(spark, state, tax, make.raw([("INBOX", 10, 3, "c", "hello", "ann@pals.net")]))
    decide = spark.createDataFrame([("ann@pals.net", "addr", "set", "keep", None, "me", T0, 1)], DECISION)
    jobs.apply_decisions(spark, state, decide, tax)
    from mailloom.taxonomy import Taxonomy

    smaller = Taxonomy("v2", tuple(t for t in tax.tags if t.name != "keep"), tax.keyword_rules)
    assert jobs.classify_rules(spark, state, smaller, T0).first()["uncovered"] == 1
    assert jobs.classify_rules(spark, state, tax, T0).first()["written"] == 1


# --- streams ----------------------------------------------------------------------------------


def test_stream_equals_batch(spark, make, tax, tmp_path):
    fmt = "json"
    one = make.raw([("INBOX", 10, 1, "a", "sale"), ("INBOX", 10, 2, ""), ("INBOX", 10, 2, "")])
    two = make.raw([("INBOX", 10, 3, "a"), ("Archive", 20, 1, "b"), ("Archive", 20, 2, "")])
    source = str(tmp_path / "landing")
    streamed = tables.init_state(spark, tables.State(str(tmp_path / "streamed")))
    whole = tables.init_state(spark, tables.State(str(tmp_path / "whole")))

    def stream():
        raw = landing.stream_raw(spark, source, fmt, max_files=1)
        start_ingest(raw, streamed, tax, str(tmp_path / "cp"), ORDER, lambda: T0).awaitTermination()

    for part in (one, two):
        part.coalesce(1).write.mode("append").format(fmt).save(source)
        stream()
    jobs.ingest(spark, whole, landing.read_raw(spark, source, fmt), tax, T0, ORDER)
    assert rows_of(tables.read_messages(spark, streamed)) == rows_of(tables.read_messages(spark, whole))
    assert len(live(spark, streamed)) == 4
    assert sum(r.fetched for r in tables.read_metrics(spark, streamed).collect()) == 6


def test_stream_survives_a_lost_checkpoint(spark, state, make, tax, tmp_path):
    """The same rows offered again add nothing."""
    source = str(tmp_path / "landing")
    make.raw([("INBOX", 10, 1, "a"), ("INBOX", 10, 2, "")]).write.parquet(source)
    for name in ("cp1", "cp2"):
        start_ingest(landing.stream_raw(spark, source), state, tax, str(tmp_path / name),
                     ORDER, lambda: T0).awaitTermination()
    assert live(spark, state, "uid") == [(1,), (2,)]


def test_stream_takes_late_low_uids_and_rollover(spark, state, make, tax, tmp_path):
    source = str(tmp_path / "landing")

    def push(rows):
        make.raw(rows).coalesce(1).write.mode("append").parquet(source)
        start_ingest(landing.stream_raw(spark, source), state, tax, str(tmp_path / "cp"),
                     ORDER, lambda: T0).awaitTermination()

    push([("INBOX", 10, 5, "e")])
    push([("INBOX", 10, 2, "b")])
    assert live(spark, state, "uid") == [(2,), (5,)]
    push([("INBOX", 11, 1, "n", "", "a@x.com", "", DAY + timedelta(1))])
    assert live(spark, state, "uidvalidity", "uid") == [(11, 1)]


def test_bounded_dedup_keeps_rows_without_id(spark, make, tmp_path):
    source = str(tmp_path / "landing")
    make.raw([("A", 1, 1, "a"), ("A", 1, 2, "a"), ("A", 1, 3, ""), ("A", 1, 4, "")]).write.parquet(source)
    out = bounded_dedup(landing.stream_raw(spark, source), "1 day")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
