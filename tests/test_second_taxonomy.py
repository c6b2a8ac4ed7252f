"""A taxonomy other than that of the ingest, white space of all kinds, order of decisions."""

from __future__ import annotations

from dataclasses import replace

from conftest import DAY, rows_of
from mailloom.operators import decisions, intake, model, rules
from mailloom.schemas import KEY
from mailloom.sources import state as tables


def mail(make, tax):
    return intake.index_messages(make.raw([
        ("INBOX", 1, 1, "a", "Sale now", "x@store.net", "half price"),
        ("INBOX", 1, 2, "b", "quarterly zebra", "y@zoo.com", "stripes"),
    ]), tax)


def other(tax):
    rule = replace(tax.keyword_rules[0], tag="keep", keywords=("zebra",))
    return replace(tax, version="v2", keyword_rules=(rule,))


def test_rules_use_the_taxonomy_given(make, tax):
    second = other(tax)
    got = rules.resolve_rules(mail(make, tax), make.rules([]), second)
    assert rows_of(got, "uid", "resolved_tag", "method") == [(1, None, None), (2, "keep", "keyword_rule")]
    payload = {r.uid: r.payload for r in model.build_payload(mail(make, tax), second, keep=KEY).collect()}
    assert "hint" not in payload[1] and payload[2].endswith("keep")


def test_white_space_of_commands_and_leaves(spark, tax):
    log = spark.createDataFrame([(c,) for c in (
        "\tSTORE 1 +FLAGS", "\r\nEXPUNGE", "EXPUNGE\t", " expunge ", "EXPUNGED", "FETCH 1")], "command string")
    assert intake.flag_commands(log).count() == 4
    leaves = spark.createDataFrame([("\tkeep\n",), ("keep x",)], "leaf string")
    assert rows_of(decisions.parse_leaf(leaves, tax), "tag", "valid") == [("keep", True), (None, False)]


def test_header_names_in_any_case(spark):
    from mailloom.functions.text import clean_message_id

    rows = spark.createDataFrame([({"Message-ID": "<q@x>"},), ({"subject": "s"},)], "headers map<string,string>")
    assert rows_of(rows.select(clean_message_id(intake._header("message-id")).alias("id"))) == [("",), ("q@x",)]


def test_a_later_run_wins_a_tie(spark, state):
    from mailloom.schemas import DECISION_LOG

    def one(tag, seq):
        row = {f: None for f in DECISION_LOG.names} | {
            "action": "set", "scope": "addr", "key": "x@store.net", "decided_by": "t", "decided_at": DAY,
            "seq": seq, "tag": tag}
        return spark.createDataFrame([tuple(row[f] for f in DECISION_LOG.names)], DECISION_LOG)

    tables.append_decisions(one("junk", 5), state, 1)
    tables.append_decisions(one("keep", 1), state, 2)
    assert rows_of(tables.read_rules(spark, state), "tag") == [("keep",)]
