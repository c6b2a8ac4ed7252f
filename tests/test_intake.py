from __future__ import annotations

from datetime import datetime

import pytest
from conftest import DAY, rows_of
from pyspark.sql import functions as F

from mailloom.operators import intake
from mailloom.schemas import LANDED


def test_normalize_and_hint(make, tax):
    raw = make.raw([("INBOX", 10, 1, "a", "Big SALE, now 30% off", "Offers@Store.NET", " hi \n there ")])
    row = intake.index_messages(raw, tax).first()
    assert (row.from_addr, row.from_domain, row.snippet, row.keyword_hint) == (
        "offers@store.net", "store.net", "hi there", "junk")


def test_clean_raw(spark):
    rows = [
        ("F", 1, None, {"message-id": " <a@b> ", "x": "1"}, None, ["p@q", "r@s"], None, None, None,
         "", "<p>hi</p>", DAY),
        ("F", 1, 2, {}, "X@y", [], "s", DAY, 5, "text", "<p>no</p>", DAY),
        ("F", 1, 3, {"b": "2", "a": "1"}, "X@y", None, "s", DAY, 5, None, None, DAY),
    ]
    got = {r.uid: r for r in intake.clean_raw(spark.createDataFrame(rows, LANDED)).collect()}
    first, second, third = got[0], got[2], got[3]
    assert (first.message_id, first.to_addr, first.from_addr, first.subject, first.size) == (
        "a@b", "p@q, r@s", "", "", 0)
    assert (first.text, second.text, third.text) == ("<p>hi</p>", "text", "")
    assert (second.message_id, second.to_addr) == ("", "")
    assert third.headers_blob == '[{"key":"a","value":"1"},{"key":"b","value":"2"}]'


def test_dedup_across_folders(make):
    raw = make.raw([("INBOX", 10, 1, "shared"), ("Archive", 20, 1, "shared"),
                    ("Archive", 20, 2, "unique"), ("Archive", 20, 3, ""), ("Archive", 20, 4, ""),
                    ("Archive", 20, 6, "twice"), ("Archive", 20, 5, "twice")])
    got = intake.dedup_messages(raw, folders=["INBOX", "Archive"])
    assert rows_of(got, "folder", "uid") == [
        ("Archive", 2), ("Archive", 3), ("Archive", 4), ("Archive", 5), ("INBOX", 1)]
    other = intake.dedup_messages(raw, folders=["Archive", "INBOX"])
    assert ("INBOX", 1) not in rows_of(other, "folder", "uid")


def test_dedup_against_store(make):
    stored = make.raw([("Old", 1, 1, "a"), ("Old", 1, 2, "")])
    batch = make.raw([("INBOX", 1, 1, "a"), ("INBOX", 1, 2, ""), ("INBOX", 1, 3, "b")])
    assert rows_of(intake.dedup_messages(batch, stored), "uid") == [(2,), (3,)]
    assert rows_of(intake.new_ids(batch, stored)) == [("b",)]


def test_released_ids_block_earlier_folders_only(make):
    """An id of a dropped folder is known until that folder's turn, and free after."""
    order = ["A", "B", "C"]
    released = make.raw([("B", 1, 1, "x")]).select("folder", "message_id")
    batch = make.raw([("A", 1, 1, "x"), ("B", 2, 1, "x"), ("C", 1, 1, "x")])
    got = intake.dedup_messages(batch, make.raw([]), order, released)
    assert rows_of(got, "folder") == [("B",)]


def test_refresh_keeps_own_rows(make):
    stored = make.raw([("B", 1, 1, "x"), ("A", 1, 9, "z")])
    batch = make.raw([("A", 1, 1, "x"), ("B", 1, 1, "x"), ("B", 1, 2, "y"), ("B", 1, 3, "z")])
    got = intake.dedup_refresh(batch, stored, ["A", "B"])
    assert rows_of(got, "folder", "uid") == [("B", 1), ("B", 2)]


def test_generations_by_time_not_number(make):
    raw = make.raw([("A", 99, 1, "a", "", "", "", datetime(2026, 1, 1)),
                    ("A", 10, 1, "b", "", "", "", datetime(2026, 1, 2)),
                    ("B", 5, 1, "c")])
    current = intake.current_generations(raw)
    assert rows_of(current, "folder", "uidvalidity") == [("A", 10), ("B", 5)]
    cursor = make.cursor([("A", 99, 7), ("B", 5, 0)])
    assert rows_of(intake.rolled_over(current, cursor)) == [("A",)]
    late = intake.current_generations(
        make.raw([("A", 10, 1, "b", "", "", "", datetime(2025, 1, 1))]), cursor)
    assert rows_of(late, "uidvalidity") == [(99,)]


def test_incremental_scan_and_cursor(make):
    cursor = make.cursor([("A", 10, 2), ("B", 1, 2), ("Z", 3, 4)])
    raw = make.raw([("A", 10, 2, "a"), ("A", 10, 3, "b"), ("B", 2, 1, "c"), ("C", 1, 0, "d"),
                    ("C", 1, 1, "e")])
    fetched = intake.incremental_scan(raw, cursor)
    assert rows_of(fetched, "folder", "uid") == [("A", 3), ("B", 1), ("C", 1)]
    everything = intake.incremental_scan(raw, cursor, full=True)
    assert everything.count() == 4
    generations = intake.current_generations(raw)
    moved = intake.advance_cursor(intake.fetch_stats(fetched), generations, cursor, F.lit(DAY).cast("timestamp_ntz"))
    assert rows_of(moved, "folder", "uidvalidity", "last_uid") == [
        ("A", 10, 3), ("B", 2, 1), ("C", 1, 1), ("Z", 3, 4)]


def test_cursor_of_empty_runs(make):
    cursor = make.cursor([("A", 10, 5)])
    raw = make.raw([("A", 10, 1, "a")])
    generations = intake.current_generations(raw)
    now = F.lit(DAY).cast("timestamp_ntz")
    nothing = intake.fetch_stats(raw.filter("false"))
    kept = intake.advance_cursor(nothing, generations, cursor, now)
    reset = intake.advance_cursor(nothing, generations, cursor, now, full=True)
    assert rows_of(kept, "last_uid") == [(5,)] and rows_of(reset, "last_uid") == [(0,)]


def test_upsert_refreshes_four_columns(make, tax):
    old = intake.index_messages(make.raw([("A", 1, 1, "a", "sale", "x@y.z", "old")]), tax)
    new = intake.index_messages(make.raw([("A", 1, 1, "b", "hello", "q@q.q", "new"),
                                          ("A", 1, 2, "c")]), tax)
    got = {r.uid: r for r in intake.upsert_messages(old, new).collect()}
    assert (got[1].message_id, got[1].subject, got[1].snippet, got[1].keyword_hint,
            got[1].from_addr) == ("b", "hello", "new", None, "x@y.z")
    assert len(got) == 2
    again = intake.upsert_messages(intake.upsert_messages(old, new), new)
    assert rows_of(again) == rows_of(intake.upsert_messages(old, new))


def test_counts(make):
    m = make.raw([("A", 1, 1, ""), ("A", 1, 2, ""), ("A", 1, 3, "a"), ("B", 1, 1, "a")])
    assert intake.message_count(m).first()[0] == 4
    assert intake.distinct_message_count(m).first()[0] == 2
    assert intake.distinct_message_count(m, approximate=True).first()[0] == 2


@pytest.mark.parametrize("command, bad", [
    ("UID STORE 1 +FLAGS (\\Seen)", True), (" expunge ", True), ("copy 1 x", True),
    ("EXAMINE INBOX", False), ("STOREX 1", False), ("UID FETCH 1:* (BODY.PEEK[])", False),
    ("XCOPY 1", False), ("subscribe", True),
])
def test_flag_commands(spark, command, bad):
    df = spark.createDataFrame([(command,)], "command string")
    assert intake.flag_commands(df).count() == int(bad)
