"""Plans and hot keys: what must hold when one key has a third of all rows."""

from __future__ import annotations

import re

import pytest
from conftest import DAY, plan, rows_of
from pyspark.sql import functions as F

from mailloom.operators import classify as cl, decisions as dec, intake, rules, senders, summary
from mailloom.plans import fixtures
from mailloom.plans.queries import QUERIES
from mailloom.session import (
    cluster_conf, fits_broadcast, heavy_keys, narrowed, salted_join, shared_dir, skew_join,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark, make, tax):
    """3000 messages; one sender, one Message-ID and the empty id are hot."""
    base = make.raw([]).select("*")
    rows = spark.range(3000).select(
        F.lit("INBOX").alias("folder"), F.lit(1).cast("bigint").alias("uidvalidity"),
        F.col("id").alias("uid"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN '' ELSE concat('m', id) END")
        .alias("message_id"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot@x.com' ELSE concat('u', id % 50, '@y.com') END")
        .alias("from_addr"),
        F.lit("me").alias("to_addr"), F.concat(F.lit("s"), F.col("id")).alias("subject"),
        F.lit(DAY).cast("timestamp_ntz").alias("date"), F.lit(1).cast("bigint").alias("size"),
        F.lit("text").alias("text"), F.lit("h").alias("headers_blob"),
        F.lit(DAY).cast("timestamp_ntz").alias("fetched_at"),
    )
    return intake.index_messages(base.unionByName(rows), tax).cache()


def test_rank_filters_cut_before_the_shuffle(hot, make):
    for df in (intake.first_seen(hot), senders.example_subjects(hot),
               summary.top_senders_per_tag(hot.select(F.col("subject").alias("tag"), "from_addr",
                                                      F.lit(1).alias("n")))):
        text = plan(df)
        partial, exchange = text.rfind("WindowGroupLimit"), text.rfind("Exchange hashpartitioning")
        assert "Partial" in text[partial:partial + 200] and partial > 0 and exchange > 0


def test_hot_ids(hot):
    kept = intake.dedup_messages(hot)
    assert kept.count() == 1 + 1000 + 1000
    # Rows without id share no key, so they do not gather in one task.
    keys = intake.first_seen(hot).filter("message_id = ''").select("__id").distinct()
    assert keys.count() == 1000


def test_salted_join_equals_join(spark, hot):
    right = hot.select("from_addr").distinct().withColumn("x", F.length("from_addr"))
    right = right.filter("from_addr != 'u7@y.com'")
    for how in ("inner", "left", "left_anti", "left_semi"):
        salted = salted_join(hot, right, ["from_addr"], how, F.col("uid"))
        assert rows_of(salted.select(sorted(salted.columns))) == rows_of(
            hot.join(right, "from_addr", how).select(sorted(salted.columns)))


def test_heavy_keys_are_split_by_their_size(spark, hot):
    """A domain and a sender hold a third of all rows; no task gets many more than `heavy_rows`."""
    right = hot.select("from_addr").distinct().withColumn("x", F.length("from_addr"))
    heavy = {r.from_addr: r["__parts"] for r in heavy_keys(hot, ["from_addr"], 100).collect()}
    assert heavy == {"hot@x.com": 10}
    for how in ("inner", "left", "left_anti", "left_semi"):
        split = skew_join(hot, right, ["from_addr"], how, F.col("uid"), 100)
        assert rows_of(split.select(sorted(split.columns))) == rows_of(
            hot.join(right, "from_addr", how).select(sorted(hot.join(right, "from_addr", how).columns)))
    part = F.pmod(F.xxhash64("uid"), F.lit(10))
    assert hot.filter("from_addr = 'hot@x.com'").groupBy(part.alias("p")).count().agg(F.max("count")).first()[0] < 150
    # Rules of all other keys are not repeated.
    wide = right.join(F.broadcast(heavy_keys(hot, ["from_addr"], 100)), "from_addr", "left")
    assert wide.agg(F.sum(F.coalesce("__parts", F.lit(1)))).first()[0] == right.count() + 9


def test_fits_broadcast(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)


def test_narrowed_join_equals_join(hot):
    keys = hot.filter("uid < 10").select("message_id", "uid")
    few = narrowed(hot, keys, ["message_id"], 10)
    assert few.count() < hot.count() and narrowed(hot, keys, ["message_id"], 10, 5) is hot
    assert rows_of(keys.join(few, "message_id", "left_semi")) == rows_of(
        keys.join(hot, "message_id", "left_semi"))


def test_shared_dir_follows_the_session(spark, monkeypatch):
    own = shared_dir(spark)
    real = spark.conf.get
    monkeypatch.setattr(spark.conf, "get", lambda k, *d: "/shared/x/" if k == "spark.checkpoint.dir" else real(k, *d))
    assert shared_dir(spark) == "/shared/x" != own


def test_cluster_conf():
    assert cluster_conf(100 << 40)["spark.sql.shuffle.partitions"] == str((100 << 40) // (128 << 20))
    assert cluster_conf(1)["spark.sql.shuffle.partitions"] == "200"


def test_many_rules_take_no_broadcast_hint(hot, make, tax):
    table = make.rules([("addr", f"u{i}@y.com", "keep", None) for i in range(50)]
                       + [("domain", "x.com", "junk", None)])
    few = rules.resolve_rules(hot, table, tax, max_rows=1000)
    many = rules.resolve_rules(hot, table, tax, max_rows=10)
    assert "__salt" in plan(many) and "__salt" not in plan(few)
    columns = ["uid", "resolved_tag", "method"]
    assert rows_of(few, *columns) == rows_of(many, *columns)


def test_hot_sender_profile(hot):
    top = senders.top_senders(hot, 1).first()
    assert (top.from_addr, top.message_count, top.example_subjects) == (
        "hot@x.com", 1000, ["s0", "s3", "s6"])


def test_hot_decision_key(spark, tax):
    log = spark.range(2000).select(
        F.lit("addr").alias("scope"), F.lit("hot@x.com").alias("key"),
        F.expr("CASE WHEN id = 1000 THEN 'set' ELSE 'defer' END").alias("action"),
        F.lit("keep").alias("leaf"), F.concat(F.lit("n"), F.col("id")).alias("note"),
        F.lit("me").alias("decided_by"), F.lit(DAY).cast("timestamp_ntz").alias("decided_at"),
        F.col("id").alias("seq"),
    )
    queue = spark.createDataFrame([("addr", "hot@x.com", None)], "scope string, key string, hint string")
    judged = dec.judge_decisions(log, queue, tax)
    assert rows_of(dec.rules_view(judged), "tag") == [("keep",)]
    assert rows_of(dec.deferrals_view(judged), "note") == [("n1999",)]


def test_scans_are_pruned(spark):
    text = plan(QUERIES["keyword_hint"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) <= {"doc_id", "text", "lang", "source"}
    raw = plan(QUERIES["scan_raw"](spark, SF))
    assert "text:" not in re.search(r"ReadSchema: struct<([^>]*)>", raw).group(1)


def test_log_filter_reaches_the_partitions(spark, state, make, tax):
    from mailloom.sources import state as tables

    log = make.log([("A", 1, 1, "keep", DAY, 1)], tax.content_hash)
    tables.append_classification(log, state, tax.content_hash, 1)
    text = plan(cl.latest_classification(tables.read_classifications(spark, state), tax.content_hash))
    assert re.search(r"PartitionFilters: \[[^\]]*taxonomy_hash", text)


def _customers(spark, folder, n):
    spark.range(n).coalesce(1).select(
        F.expr("CASE WHEN id > 0 THEN id END").alias("c_custkey"), F.concat(F.lit("C#"), "id").alias("c_name"),
        F.lit("Toys").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")


def test_leaves_of_many_versions_stay_out_of_the_driver(spark, tmp_path):
    _customers(spark, tmp_path, 50)
    found = QUERIES["stale_rules"](spark, str(tmp_path))
    assert "Broadcast" not in plan(found)
    # 'junk' and 'toys' of each customer; without a version no leaf is known.
    assert sorted(rows_of(found, "version", "leaf"), key=str) == sorted(
        [(f"v1-{i}", "junk") for i in range(1, 50)]
        + [(None, t) for t in ("junk", "receipt", "notification", "newsletter", "toys")], key=str)


def test_versions_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """One small file: its tasks follow the number of customers."""
    _customers(spark, tmp_path, 1000)
    monkeypatch.setattr(fixtures, "CUSTOMERS_A_TASK", 50)
    for made in (fixtures.taxonomy_tags, fixtures.taxonomy_rules):
        rows = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.countDistinct("version").alias("n"))
        sizes = [r["n"] for r in rows.collect()]
        assert len(sizes) > 15 and max(sizes) < 100
    # The set needs no other shuffle, and repeated versions give no leaf twice.
    leaves = QUERIES["valid_leaves"](spark, str(tmp_path))
    assert plan(leaves).count("Exchange") == 1
    assert leaves.count() == leaves.distinct().count() == 999 * 12 + 10 + 1 + 1
