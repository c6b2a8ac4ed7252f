from __future__ import annotations

import math
from datetime import datetime

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from mailloom.functions import text as tx

SPACES = "".join(chr(i) for i in range(0x3101) if chr(i).isspace())
QUIET = settings(max_examples=4, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_snippet_equals_split_on_all_spaces(spark):
    texts = [f"{a}x{a}{b}y{b}" for a in SPACES for b in " \n　"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", tx.snippet(F.col("v")).alias("s")).collect()
    assert all(r.s == " ".join(r.v.split()) for r in got)


@QUIET
@given(st.lists(st.text(alphabet=SPACES + "abcé​­\U0001f600", max_size=1500),
                min_size=20, max_size=40))
def test_snippet_property(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", tx.snippet(F.col("v")).alias("s")).collect()
    assert all(r.s == " ".join(r.v.split())[:500] for r in got)


def test_snippet_reads_past_very_long_space(spark):
    assert one(spark, "a" + " \n" * 50_000 + "b" * 600, tx.snippet) == "a " + "b" * 498


def test_domain(spark):
    assert one(spark, "X@Y@Store.NET", tx.domain_of) == "store.net"
    assert one(spark, "Mailer-Daemon", tx.domain_of) == ""


def test_message_id_and_hash(spark):
    import hashlib

    assert one(spark, " <<a b@c>> ", tx.clean_message_id) == "a b@c"
    assert one(spark, None, tx.clean_message_id) == ""
    assert one(spark, "h1", tx.short_hash) == hashlib.sha256(b"h1").hexdigest()[:16]


def test_iso_text_in_any_time_zone(spark):
    stamps = [datetime(2026, 3, 29, 2, 30), datetime(2026, 1, 1, 1, 2, 3, 500000),
              datetime(2026, 1, 1, 0, 0, 0, 7)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r[0] for r in df.select(tx.iso_text(F.col("t"))).collect()]
            assert got == [s.isoformat() for s in stamps]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_leaves_and_lists(spark):
    df = spark.createDataFrame([(" receipt/a/b ",), ("keep",)], "v string")
    got = df.select(tx.leaf_tag(F.col("v")), tx.leaf_subtag(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("receipt", "a/b"), ("keep", None)]
    assert one(spark, "a,,b", tx.comma_list) == ["a", "b"]
    assert one(spark, "", tx.comma_list) == []


@QUIET
@given(st.sampled_from([0, 30, 60, 90, 300]),
       st.lists(st.tuples(st.integers(0, 699), st.integers(0, 400)), min_size=50, max_size=200))
def test_cut_equals_stepwise_cut(spark, budget, cases):
    def stepwise(body, head):
        room = max(budget - math.ceil(head / 4), 0)
        while body > 0 and math.ceil(body / 4) > room:
            body = max(body - 32, 0)
        return body

    df = spark.createDataFrame([("s" * b, "h" * h) for b, h in cases], "body string, head string")
    kept = df.select(tx.kept_length(F.col("head"), F.col("body"), budget)).collect()
    assert [r[0] for r in kept] == [stepwise(b, h) for b, h in cases]
