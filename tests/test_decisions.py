from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows_of

from mailloom.operators import decisions as dec
from mailloom.schemas import DECISION


@pytest.fixture
def judge(spark, tax):
    queue = spark.createDataFrame(
        [("addr", "a@x.com", "junk"), ("addr", "b@x.com", None), ("domain", "x.com", None)],
        "scope string, key string, hint string")

    def run(rows):
        """(key, scope, action, leaf, note) in time order"""
        table = spark.createDataFrame(
            [(*r, "me", datetime(2026, 1, 1, 0, i), i) for i, r in enumerate(rows)], DECISION)
        return dec.judge_decisions(table, queue, tax)

    return run


def test_set_accept_override(judge):
    log = judge([
        ("a@x.com", "addr", "accept", None, None),
        ("x.com", "domain", "set", " receipt/bank ", None),
        ("x.com", "domain", "set", "keep", None),
        ("c@x.com", "addr", "set", "receipt/bank", None),
    ])
    assert rows_of(dec.rules_view(log), "scope", "key", "tag", "subtag") == [
        ("addr", "a@x.com", "junk", None), ("addr", "c@x.com", "receipt", "bank"),
        ("domain", "x.com", "keep", None)]


def test_rejections(judge):
    log = judge([
        ("b@x.com", "addr", "accept", None, None), ("b@x.com", "addr", "set", "nonsuch", None),
        ("b@x.com", "addr", "set", None, None), ("b@x.com", "addr", "jump", None, None),
        ("b@x.com", "planet", "set", "keep", None), ("zz", "addr", "accept", None, None),
    ])
    assert [r.rejected for r in log.orderBy("seq").collect()] == [
        "no hint", "not a leaf", "not a leaf", "unknown action", "unknown scope", "no hint"]
    assert dec.rules_view(log).count() == 0


def test_rule_clears_deferral(judge):
    log = judge([("x.com", "domain", "defer", None, "later"), ("x.com", "domain", "set", "keep", None)])
    assert dec.deferrals_view(log).count() == 0


def test_deferral_keeps_first_time_and_last_note(judge):
    log = judge([
        ("x.com", "domain", "defer", None, "old"), ("x.com", "domain", "clear", None, None),
        ("x.com", "domain", "defer", None, "one"), ("x.com", "domain", "defer", None, "two"),
    ])
    row = dec.deferrals_view(log).first()
    assert row.note == "two" and row.created_at == datetime(2026, 1, 1, 0, 2)


def test_rejected_rule_leaves_deferral(judge):
    log = judge([("x.com", "domain", "defer", None, "n"), ("x.com", "domain", "set", "bad", None)])
    assert dec.deferrals_view(log).count() == 1


def test_deferral_leaves_rule_and_delete_removes_it(judge):
    rows = [("x.com", "domain", "set", "keep", None), ("x.com", "domain", "defer", None, "n")]
    assert dec.rules_view(judge(rows)).count() == 1
    gone = judge([*rows, ("x.com", "domain", "delete", None, None)])
    assert dec.rules_view(gone).count() == 0 and dec.deferrals_view(gone).count() == 1
    back = judge([*rows, ("x.com", "domain", "delete", None, None), ("x.com", "domain", "set", "junk", None)])
    assert rows_of(dec.rules_view(back), "tag") == [("junk",)]
