from __future__ import annotations

import json
import os
from datetime import timedelta

import pytest
from conftest import DAY, rows_of
from pyspark.sql import functions as F

from mailloom.functions import reply as rp
from mailloom.operators import audit as audits, classify as cl, intake, model, summary
from mailloom.schemas import KEY

def now():
    return F.lit(DAY).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def messages(make, tax):
    return intake.index_messages(make.raw([
        ("INBOX", 10, 1, "a", "SALE, now 30% off", "offers@store.net"),
        ("INBOX", 10, 2, "b", "invoice no 7", "billing@lender.org"),
        ("INBOX", 10, 3, "c", "lunch on friday", "ann@pals.net"),
    ]), tax).cache()


# --- log ------------------------------------------------------------------------------


def test_latest_by_time_then_run(make):
    log = make.log([("A", 1, 1, "old", DAY, 9), ("A", 1, 1, "new", DAY + timedelta(1), 1),
                    ("A", 1, 2, "x", DAY, 1), ("A", 1, 2, "y", DAY, 2)], "h")
    other = make.log([("A", 1, 1, "other", DAY + timedelta(9), 1)], "other")
    both = log.unionByName(other)
    assert rows_of(cl.latest_classification(both, "h"), "uid", "tag") == [(1, "new"), (2, "y")]
    assert cl.classified_count(both).first()[0] == 2


def test_rules_pass_counts_and_rerun(messages, make, tax):
    none, empty = make.rules([]), make.log([], tax.content_hash)
    first = cl.classify_metrics(messages, none, empty, tax).first()
    assert tuple(first) == (3, 2, 0, 1)
    records = cl.classify_rules(messages, none, empty, tax, now(), 1)
    assert rows_of(records, "uid", "tag", "method", "confidence") == [
        (1, "junk", "keyword_rule", 1.0), (2, "receipt", "keyword_rule", 1.0)]
    assert tuple(cl.classify_metrics(messages, none, records, tax).first()) == (3, 0, 2, 1)
    assert cl.classify_rules(messages, none, records, tax, now(), 2).count() == 0


def test_sender_rule_overrides_and_subtag_only_change_is_kept(messages, make, tax):
    log = cl.classify_rules(messages, make.rules([]), make.log([], tax.content_hash), tax, now(), 1)
    rules = make.rules([("addr", "offers@store.net", "keep", None),
                        ("addr", "billing@lender.org", "receipt", "bank")])
    second = cl.classify_rules(messages, rules, log, tax, now(), 2)
    assert rows_of(second, "uid", "tag", "method") == [(1, "keep", "sender_rule")]


def test_other_generation_does_not_count(messages, make, tax):
    log = make.log([("INBOX", 9, 1, "junk", DAY, 1)], tax.content_hash)
    assert cl.classify_metrics(messages, make.rules([]), log, tax).first()["written"] == 2
    assert cl.manifest(messages, log, tax.content_hash).count() == 0


def test_manifest_and_summary(messages, make, tax):
    log = cl.classify_rules(messages, make.rules([]), make.log([], tax.content_hash), tax, now(), 1)
    rows = cl.manifest(messages, log, tax.content_hash)
    assert rows.count() == 2 and len(rows.columns) == 17
    counts = summary.tag_method_sender(rows)
    cover = summary.summary_coverage(messages, counts, audits.audit(messages, log, tax)).first()
    assert (cover.distinct_messages, cover.classified, cover.unclassified, cover.open_findings) == (
        3, 2, 1, 0)
    shares = summary.method_breakdown(counts).first()
    assert shares.share == 100.0
    assert summary.lowest_confidence(rows).count() == 0
    status = summary.status_coverage(messages, log).first()
    assert round(status.percent, 3) == 66.667


def test_residue_and_limit(messages, make, tax):
    none, empty = make.rules([]), make.log([], tax.content_hash)
    assert rows_of(cl.llm_residue(messages, none, empty, tax), "uid") == [(3,)]
    advisory = cl.llm_residue(messages, none, empty, tax, keyword_authoritative=False)
    assert rows_of(advisory, "uid") == [(1,), (2,), (3,)]
    assert rows_of(cl.llm_limit(advisory, 2), "uid") == [(1,), (2,)]
    assert cl.llm_limit(advisory, None) is advisory
    done = make.log([("INBOX", 10, 3, "keep", DAY, 1)], tax.content_hash)
    assert cl.llm_residue(messages, none, done, tax).count() == 0
    assert cl.llm_residue(messages, none, make.log([("INBOX", 10, 3, "keep", DAY, 1)], "x"), tax).count() == 1


# --- payload ---------------------------------------------------------------------------


def test_payload(messages, tax):
    row = model.build_payload(messages, tax, keep=KEY).filter("uid = 1").first()
    assert row.payload == ("From: offers@store.net\nSubject: SALE, now 30% off\nDate: 2026-01-01T00:00:00\n"
                           "Snippet: \nKeyword hint (advisory, may be wrong): junk")
    assert not row.truncated


def test_payload_cut(make, tax):
    m = intake.index_messages(make.raw([("A", 1, 1, "a", "s", "a@x.com", "some running text " * 120)]), tax)
    row = model.build_payload(m, tax, 60, KEY).first()
    assert row.truncated and len(row.payload) <= 240


# --- replies ------------------------------------------------------------------------------

# raw reply, then (tag, subtags, confidence, rationale) or None when invalid
REPLIES = [
    ('{"tag":"keep"}', ("keep", [], 0.0, "")),
    ('Reply follows >> {"tag":"junk","confidence":0.9} << end', ("junk", [], 0.9, "")),
    ('{"tag":"keep","confidence":"0.8"}', ("keep", [], 0.8, "")),
    ('{"tag":"keep","confidence":" 0.8 "}', ("keep", [], 0.8, "")),
    ('{"tag":"keep","confidence":"1_0.5_0"}', ("keep", [], 10.5, "")),
    ('{"tag":"keep","confidence":"-Inf"}', ("keep", [], float("-inf"), "")),
    ('{"tag":"keep","confidence":"infinity"}', ("keep", [], float("inf"), "")),
    ('{"tag":"keep","confidence":"0x1p3"}', None),
    ('{"tag":"keep","confidence":"1d"}', None),
    ('{"tag":"keep","confidence":"1__0"}', None),
    ('{"tag":"keep","confidence":true}', ("keep", [], 1.0, "")),
    ('{"tag":"keep","confidence":1}', ("keep", [], 1.0, "")),
    ('{"tag":"keep","confidence":1e-1}', ("keep", [], 0.1, "")),
    ('{"tag":"keep","subtags":["a","b"],"rationale":"why","more":{"x":[1]}}',
     ("keep", ["a", "b"], 0.0, "why")),
    ('{"tag":"keep",\n"subtags":[]}', ("keep", [], 0.0, "")),
    ('{"tag":"a}b"}', ("a}b", [], 0.0, "")),
    ('{"tag":"keep","confidence":null}', None),
    ('{"tag":"keep","subtags":null}', None),
    ('{"tag":null}', None),
    ('{"tag":5}', None),
    ('{"tag":"keep","rationale":7}', None),
    ('{"tag":"keep","subtags":"x"}', None),
    ('{"tag":"keep","subtags":["a",3]}', None),
    ('{"tag":"keep","subtags":["a",null]}', None),
    ('{"tag":"keep","confidence":"high"}', None),
    ('{"tag":"keep","confidence":"1d"}', None),
    ('{"tag":"keep","confidence":[1]}', None),
    ('{"confidence":1}', None),
    ("{'tag':'keep'}", None),
    ('{"tag":"keep",}', None),
    ('{"tag":"a"} {"tag":"b"}', None),
    ('}{', None), ('no object', None), ('', None), (None, None), ('{', None), ('[1]', None),
]


def test_strict_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, raw string")
    got = {r.i: r.reply for r in rp.with_parsed_reply(df, "raw").collect()}
    for i, (raw, want) in enumerate(REPLIES):
        assert (None if got[i] is None else tuple(got[i])) == want, raw


def test_replies_match_a_strict_model(spark):
    pydantic = pytest.importorskip("pydantic")

    class Reply(pydantic.BaseModel):
        tag: str
        subtags: list[str] = []
        confidence: float = 0.0
        rationale: str = ""

    for raw, want in REPLIES:
        try:
            text = raw[raw.index("{"):raw.rindex("}") + 1]
            r = Reply.model_validate_json(text)
            expected = (r.tag, r.subtags, r.confidence, r.rationale)
        except (ValueError, AttributeError, TypeError):
            expected = None
        assert expected == want, raw


def test_outcome(spark, tax):
    rows = [
        ("receipt", ["x", "junk/marketing"]), ("spam", ["receipt/bank"]), ("receipt/bank", []),
        ("keep", ["keep"]),
    ]
    df = spark.createDataFrame(
        [(i, (t, s, 0.5, "r")) for i, (t, s) in enumerate(rows)], f"i int, reply {rp.PARSED}")
    got = [(r.tag, r.subtag, r.confidence, r.rationale)
           for r in rp.with_outcome(df, tax).orderBy("i").collect()]
    assert got == [("receipt", "marketing", 0.5, "r"), ("unclassified", None, 0.0, ""),
                   ("receipt/bank", None, 0.5, "r"), ("keep", None, 0.5, "r")]


def test_abstain_is_strict(spark):
    df = spark.createDataFrame(
        [("keep", "a", 0.69), ("keep", "a", 0.7), ("unclassified", None, 0.1)],
        "tag string, subtag string, confidence double")
    got = [tuple(r) for r in rp.abstain(df, 0.7).collect()]
    assert got == [("unclassified", None, 0.69), ("keep", "a", 0.7), ("unclassified", None, 0.1)]


# --- completer ---------------------------------------------------------------------------------


def scripted(script, folder):
    """Factory of a completer that answers by subject and number of earlier calls.

    Each attempt has its own client, so the calls are counted in files.
    """

    def factory():
        def call(system, user, sampling):
            assert "Taxonomy v1:" in system and sampling["max_tokens"] == 200
            subject = user.split("\n")[1].removeprefix("Subject: ")
            n = len([f for f in os.listdir(folder) if f.startswith(subject)])
            open(os.path.join(folder, f"{subject}#{n}"), "w").close()
            return script[subject][n]

        return call

    return factory


def run(messages, make, tax, script, folder, **kw):
    records = model.classify_llm_batch(
        messages.coalesce(1), tax, "m1", now(), 1, scripted(script, folder), **kw)
    return {r.uid: r for r in records.collect()}


GOOD = '{"tag":"receipt","subtags":["receipt/bank"],"confidence":0.8,"rationale":"ok"}'
LOW = '{"tag":"keep","subtags":["receipt/bank"],"confidence":0.4,"rationale":"unsure"}'


def test_completer_retry_and_failure(messages, make, tax, tmp_path):
    got = run(messages, make, tax, {
        "SALE, now 30% off": [GOOD], "invoice no 7": ["garbage", GOOD], "lunch on friday": ["no", None],
    }, str(tmp_path))
    assert (got[1].tag, got[1].subtags, got[1].confidence, got[1].rationale) == (
        "receipt", ["bank"], 0.8, "ok")
    assert (got[2].tag, got[2].model_id, got[2].prompt_version) == ("receipt", "m1", "classify_v1")
    assert (got[3].tag, got[3].confidence, got[3].subtags) == ("unclassified", 0.0, [])
    assert len(list(tmp_path.iterdir())) == 5  # a valid first reply is asked for once


def test_completer_abstains(messages, make, tax, tmp_path):
    script = {"lunch on friday": [LOW, LOW]}
    got = run(messages.filter("uid = 3"), make, tax, script, str(tmp_path))
    assert (got[3].tag, got[3].subtags, got[3].confidence, got[3].rationale) == (
        "unclassified", [], 0.4, "unsure")
    sure = run(messages.filter("uid = 3"), make, tax, script, str(tmp_path), threshold=0.0)
    assert sure[3].tag == "keep"


def test_hint_reaches_the_model(messages, make, tax):
    def factory():
        return lambda system, user, sampling: json.dumps(
            {"tag": "keep" if "advisory, may be wrong): receipt" in user else "junk",
             "confidence": 1.0})

    out = model.classify_llm_batch(messages.filter("uid = 2"), tax, "m", now(), 1, factory)
    assert out.first()["tag"] == "keep"


def test_metrics(messages, make, tax):
    out = model.classify_llm_batch(messages, tax, "m", now(), 1, lambda: lambda s, u, p: LOW)
    assert tuple(model.llm_metrics(out).first()) == (3, 3)


def test_replay_equals_completer(spark, messages, make, tax, tmp_path):
    script = {1: ["x", GOOD], 2: [LOW, GOOD], 3: ["x", "y"]}
    table = spark.createDataFrame(
        [("INBOX", 10, uid, i, raw) for uid, raws in script.items() for i, raw in enumerate(raws, 1)],
        "folder string, uidvalidity bigint, uid bigint, attempt int, raw string")
    subjects = {1: "SALE, now 30% off", 2: "invoice no 7", 3: "lunch on friday"}
    called = run(messages, make, tax, {subjects[u]: raws for u, raws in script.items()},
                 str(tmp_path))
    replayed = model.classify_llm_batch(messages, tax, "m1", now(), 1, replies=table).collect()
    assert {r.uid: r for r in replayed} == called


# --- audit --------------------------------------------------------------------------------------


def test_audit(make, tax):
    m = intake.index_messages(make.raw([
        ("A", 1, 1, "a", "Big SALE, now 30% off", "x@y.z", "unsubscribe"), ("A", 1, 2, "b", "hello"),
        ("A", 1, 3, "c", "invoice no 7"), ("A", 1, 4, "d", "sale"),
    ]), tax)
    log = make.log([("A", 1, 1, "keep", DAY, 1), ("A", 1, 2, "keep", DAY, 1),
                    ("A", 1, 3, "receipt", DAY, 1), ("A", 1, 4, "unclassified", DAY, 1)],
                   tax.content_hash)
    found = audits.audit(m, log, tax)
    assert rows_of(found, "uid", "assigned_tag", "suspected_tag", "trigger_keywords", "resolved") == [
        (1, "keep", "junk", ["unsubscribe", "% off", "sale"], False),
        (4, "unclassified", "junk", ["sale"], False)]
    assert audits.open_findings(found).first()[0] == 2
