from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailloom.schemas import CLASSIFICATION, CURSOR, DEFERRAL, RAW, RULE  # noqa: E402
from mailloom.sources.state import State, init_state  # noqa: E402
from mailloom.taxonomy import load_taxonomy  # noqa: E402

DAY = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("mailloom-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tax():
    return load_taxonomy()


@pytest.fixture
def state(spark, tmp_path):
    return init_state(spark, State(str(tmp_path / "state")))


@pytest.fixture(scope="session")
def make(spark):
    """Small tables: make.raw([...]), make.rules([...]), ..."""

    class Make:
        def raw(self, rows):
            """(folder, uidvalidity, uid, message_id, subject, from_addr, text, fetched_at)"""
            full = []
            for folder, validity, uid, mid, *rest in rows:
                subject, sender, text, at = (*rest, *["", "a@x.com", "", DAY][len(rest):])
                full.append((folder, validity, uid, mid, sender, "me@x.com", subject, DAY, 100,
                             text, f"h{uid}", at))
            return spark.createDataFrame(full, RAW)

        def rules(self, rows):
            """(scope, key, tag, subtag)"""
            return spark.createDataFrame([(*r, "tester", DAY) for r in rows], RULE)

        def deferrals(self, rows):
            return spark.createDataFrame([(*r, DAY) for r in rows], DEFERRAL)

        def cursor(self, rows):
            """(folder, uidvalidity, last_uid)"""
            return spark.createDataFrame([(*r, True, DAY, DAY, 1) for r in rows], CURSOR)

        def log(self, rows, hash_):
            """(folder, uidvalidity, uid, tag, created_at, run_seq)"""
            return spark.createDataFrame(
                [(f, v, u, tag, [], 1.0, "llm", "v1", hash_, "m", "p", "", False, at, run)
                 for f, v, u, tag, at, run in rows], CLASSIFICATION)

    return Make()


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan(df) -> str:
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString("simple"))
