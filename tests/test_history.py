"""Stored history: heads, compaction, what a small batch reads, durable model runs, progress."""

from __future__ import annotations

import glob
import hashlib
import os
from datetime import timedelta

import pytest
from conftest import DAY, rows_of
from pyspark.sql import functions as F

from mailloom.operators import intake, senders
from mailloom.plans import jobs
from mailloom.schemas import CURSOR
from mailloom.sources import files, landing, state as tables
from mailloom.streaming.ingest import IntakeListener, start_ingest

ORDER = ["INBOX", "Archive"]


def scans(df):
    """(files, rows) of every file scan of an executed plan."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def many(spark, make, first, last, folder="INBOX", validity=10, day=0):
    """Raw messages with uids in (first, last]; every tenth shares its id with the one before."""
    base = make.raw([])
    return base.unionByName(spark.range(first + 1, last + 1).select(
        F.lit(folder).alias("folder"), F.lit(validity).cast("bigint").alias("uidvalidity"),
        F.col("id").alias("uid"),
        F.concat(F.lit("m"), F.when(F.col("id") % 10 == 0, F.col("id") - 1).otherwise(F.col("id")).cast("string"))
        .alias("message_id"),
        F.concat(F.lit("u"), (F.col("id") % 7).cast("string"), F.lit("@x.com")).alias("from_addr"),
        F.lit("me").alias("to_addr"),
        F.when(F.col("id") % 3 == 0, "weekly sale").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("subject"),
        (F.lit(DAY).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(id as int))")).alias("date"),
        F.lit(1).cast("bigint").alias("size"), F.lit("text").alias("text"), F.lit("h").alias("headers_blob"),
        F.lit(DAY + timedelta(day)).cast("timestamp_ntz").alias("fetched_at")))


@pytest.fixture
def history(spark, state, make, tax):
    """Two runs of 4,000 and 2,000 messages, merged."""
    for first, last in ((0, 4000), (4000, 6000)):
        jobs.ingest(spark, state, many(spark, make, first, last), tax, DAY, ORDER)
    jobs.compact(spark, state)
    return state


def test_small_batch_reads_a_small_part_of_history(spark, history, make, tax):
    wanted = ["m4001", "new1", "new2"]
    ids = tables.read_ids(spark, history, wanted)
    read = scans(ids)
    assert [r.message_id for r in ids.collect()] == ["m4001"]
    # Three of the 64 hash buckets are opened, and of these only row groups that can hold an id.
    assert sum(n for n, _ in read) <= 3 + 2 and sum(rows for _, rows in read) < 400
    whole = scans(tables.read_ids(spark, history))
    assert sum(rows for _, rows in whole) > 5000
    # New uids lie behind all stored ones, so no stored key is read for them.
    assert sum(rows for _, rows in scans(tables.stored_keys(spark, history, 6001, 6003))) < 100


def test_few_jobs_a_batch(spark, history, make, tax):
    spark.sparkContext.setJobGroup("batch", "")
    jobs.ingest_indexed(spark, history, intake.index_messages(many(spark, make, 6000, 6005), tax, ("fetched_at",)),
                        DAY, ORDER, streamed=True)
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("batch"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n <= 25, n  # twice as many without the ledger and the written batch


def test_batch_of_many_ids_equals_few(spark, history, make, tax, monkeypatch):
    batch = many(spark, make, 5990, 6010).select("message_id")
    few = rows_of(tables.stored_ids(spark, history, batch, 20), "message_id")
    for literal, broadcast in ((0, 100), (0, 0)):
        monkeypatch.setattr(tables, "LITERAL_IDS", literal)
        monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast)
        met = tables.stored_ids(spark, history, batch, 20).join(batch.distinct(), "message_id", "left_semi")
        assert rows_of(met, "message_id") == few
    assert len(few) == 9


def test_reads_before_and_after_compaction(spark, state, make, tax):
    for first, last in ((0, 300), (300, 500)):
        jobs.ingest(spark, state, many(spark, make, first, last), tax, DAY, ORDER)
    jobs.classify_rules(spark, state, tax, DAY)
    jobs.ingest(spark, state, many(spark, make, 500, 600), tax, DAY, ORDER)
    jobs.classify_rules(spark, state, tax, DAY + timedelta(1))

    def all_reads():
        return [rows_of(tables.read_messages(spark, state)), rows_of(tables.read_classifications(spark, state)),
                rows_of(tables.read_ids(spark, state)), rows_of(jobs.manifest(spark, state, tax))]

    before = all_reads()
    head = jobs.compact(spark, state)
    assert (head.base, head.classifications_base) == (3, 2) and all_reads() == before
    # Old runs are not scanned any more, and can go.
    assert max(n for n, _ in scans(tables.read_messages(spark, state))) <= 2
    gone = tables.vacuum(spark, state)
    assert "messages/batch_id=3" in gone and all_reads() == before
    assert jobs.compact(spark, state) == head and tables.vacuum(spark, state) == []
    jobs.ingest(spark, state, many(spark, make, 600, 610), tax, DAY, ORDER)
    assert len(all_reads()[0]) == len(before[0]) + 9
    jobs.compact(spark, state, vacuum=True)
    assert files.names(spark, state.path("messages_base")) == ["at=4"]


def test_profiles_and_sketches_are_maintained(spark, state, make, tax):
    """After three runs, a compaction and a rollover they equal the scan of all messages."""
    def check():
        messages = tables.read_messages(spark, state)
        assert rows_of(jobs.sender_profiles(spark, state)) == rows_of(senders.sender_profiles(messages))
        top = senders.merged_top_senders(tables.read_profile_partials(spark, state), 4)
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in senders.top_senders(messages, 4).collect()]
        exact = jobs.distinct_messages(spark, state).first()[0]
        estimate = jobs.distinct_messages(spark, state, approximate=True).first()[0]
        assert abs(estimate - exact) <= 0.03 * exact
        return exact

    jobs.ingest(spark, state, many(spark, make, 0, 900), tax, DAY, ORDER)
    jobs.ingest(spark, state, many(spark, make, 2000, 2400, "Archive", 5), tax, DAY, ORDER)
    assert check() == 900 - 90 + 400 - 40
    jobs.compact(spark, state)
    jobs.ingest(spark, state, many(spark, make, 900, 1000), tax, DAY, ORDER)
    assert check() == 1000 - 100 + 400 - 40
    jobs.ingest(spark, state, many(spark, make, 3000, 3050, "Archive", 6, day=1), tax, DAY, ORDER)
    assert check() == 1000 - 100 + 45
    # No message of the base is read.
    read = " ".join(jobs.sender_profiles(spark, state).inputFiles())
    assert "/messages_base/" not in read and "/profiles_base/" in read


def test_of_two_writers_one_gets_an_error(spark, state, make, tax):
    raw = make.raw([("INBOX", 1, 1, "a")])
    jobs.ingest(spark, state, raw, tax, DAY)
    with pytest.raises(tables.Conflict):
        tables.commit_cursor(spark.createDataFrame(tables.read_cursor(spark, state).collect(), CURSOR), state, 1)
    # A half-written head counts as none.
    last = files.names(spark, state.path("heads"))[-1]
    files.create_text(spark, state.path("heads", f"{int(last[:-5]) + 1:012d}.json"), '{"batch": 9')
    assert tables.committed_batch(spark, state) == 1
    jobs.ingest(spark, state, make.raw([("INBOX", 1, 2, "b")]), tax, DAY)
    assert tables.committed_batch(spark, state) == 2


def test_metrics_of_a_run_that_failed_are_not_seen(spark, state, make, tax):
    jobs.ingest(spark, state, make.raw([("INBOX", 1, 1, "a")]), tax, DAY)
    tables.write_batch(tables.read_metrics(spark, state).drop("batch_id"), state, "metrics", 2)
    assert tables.read_metrics(spark, state).count() == 1


# --- model runs -----------------------------------------------------------------------------


def recorder(folder, fuse=None):
    """A list completer that leaves a file for each payload, and breaks when `fuse` files are there."""
    def factory():
        def call(system, users, sampling):
            assert 0 < len(users) <= 4
            for user in users:
                if fuse and len(os.listdir(folder)) >= fuse:
                    raise RuntimeError("line cut")
                name = hashlib.md5(user.encode()).hexdigest()
                with open(f"{folder}/{name}-{os.urandom(4).hex()}", "w"):
                    pass
            return ['{"tag":"keep","confidence":0.9}'] * len(users)

        return call

    return factory


def test_a_killed_model_run_keeps_its_chunks(spark, state, make, tax, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    jobs.ingest(spark, state, make.raw([("INBOX", 1, i, f"m{i}", f"hello {i}") for i in range(1, 41)]), tax, DAY)
    run = dict(model_id="m", run_ts=DAY, chunk_rows=8, listed=4, partitions=1)
    seen = []
    with pytest.raises(Exception, match="line cut"):
        jobs.classify_llm_batch(spark, state, tax, factory=recorder(str(calls), 25),
                                on_chunk=lambda *n: seen.append(n), **run)
    kept = tables.read_classifications(spark, state)
    done = kept.count()
    assert seen and seen[-1] == (done, 40) and kept.select("run_seq").distinct().count() == len(seen)
    lost = len(os.listdir(calls)) - done
    out = jobs.classify_llm_batch(spark, state, tax, factory=recorder(str(calls)), **run).first()
    assert tuple(out) == (40 - done, 0)
    latest = tables.read_classifications(spark, state)
    assert latest.count() == 40 and latest.select("uid").distinct().count() == 40
    # What was committed is not called again; only payloads of the broken chunk are.
    assert len(os.listdir(calls)) == 40 + lost and lost < 16


def test_residue_is_taken_anew_between_chunks(spark, state, make, tax):
    jobs.ingest(spark, state, make.raw([("INBOX", 1, i, f"m{i}", f"hello {i}") for i in range(1, 31)]), tax, DAY)
    other = make.log([("INBOX", 1, i, "keep", DAY, 99) for i in range(1, 31)], tax.content_hash)

    def meanwhile(called, total):
        run = tables.next_run(spark, state)
        tables.append_classification(other, state, tax.content_hash, run)

    answer = lambda: lambda system, user, sampling: '{"tag":"junk","confidence":1}'
    out = jobs.classify_llm_batch(spark, state, tax, "m", DAY, answer, chunk_rows=10, on_chunk=meanwhile).first()
    assert 0 < out["called"] < 30


def test_wrong_number_of_replies_is_an_error(spark, state, make, tax):
    jobs.ingest(spark, state, make.raw([("INBOX", 1, 1, "a", "hello")]), tax, DAY)
    with pytest.raises(Exception, match="1 payloads were sent, 0 replies came back"):
        jobs.classify_llm_batch(spark, state, tax, "m", DAY, lambda: lambda s, users, p: [], listed=4)


# --- streams ----------------------------------------------------------------------------------


def test_listener_and_compaction_of_a_stream(spark, state, make, tax, tmp_path):
    source = str(tmp_path / "landing")
    counts = []
    listener = IntakeListener(counts.append)
    spark.streams.addListener(listener)
    try:
        for i in range(1, 4):
            make.raw([("INBOX", 1, 2 * i, f"m{i}"), ("INBOX", 1, 2 * i + 1, f"m{i}")]).coalesce(1).write.mode(
                "append").parquet(source)
        query = start_ingest(landing.stream_raw(spark, source, max_files=1), state, tax, str(tmp_path / "cp"), ORDER,
                             lambda: DAY, compact_every=2)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert counts[-1] == 6 and counts == sorted(counts)
    head = tables.read_head(spark, state)
    assert (head.batch, head.base) == (3, 2)
    assert rows_of(tables.read_messages(spark, state), "message_id") == [("m1",), ("m2",), ("m3",)]
    assert glob.glob(state.path("ids_base", "at=2", "bucket=*"))
