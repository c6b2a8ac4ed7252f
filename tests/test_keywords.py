from __future__ import annotations

import random

import pytest

from mailloom.functions import keywords as kw
from mailloom.taxonomy import KeywordRule, Tag, Taxonomy

CASES = [
    ("Big SALE, now 30% off", "", "junk"),
    ("hello", "", None),
    ("wholesale", "", "junk"),
    ("invoice no 7", "", "receipt"),
    ("invoice on sale", "", "junk"),
    ("hi", "please UNSUBSCRIBE", "junk"),
    ("hi", "invoice no 7", None),
    ("this", "week", "newsletter"),
    ("limited", "offer", "junk"),
]


@pytest.fixture(params=[kw.CASE_LIMIT, 0], ids=["case", "array"])
def limit(request, monkeypatch):
    monkeypatch.setattr(kw, "CASE_LIMIT", request.param)


def frame(spark):
    return spark.createDataFrame([(s, t, "a@b.c") for s, t, _ in CASES],
                                 "subject string, snippet string, from_addr string")


def test_first_rule_wins(spark, tax, limit):
    got = kw.with_keyword_hint(frame(spark), tax).collect()
    assert [r.keyword_hint for r in got] == [c[2] for c in CASES]


def test_unknown_field_and_no_rules(spark, limit):
    t = Taxonomy("x", (Tag("a", "d"), Tag("b", "d")), (
        KeywordRule("a", ("hello",), ("body",)), KeywordRule("b", ("a@b",), ("from_addr",))))
    assert {r.keyword_hint for r in kw.with_keyword_hint(frame(spark), t).collect()} == {"b"}
    none = kw.with_keyword_hint(frame(spark), Taxonomy("x", ()))
    assert {r.keyword_hint for r in none.collect()} == {None}


def test_contradiction(spark, tax, limit):
    df = spark.createDataFrame([
        ("keep", "Big SALE, now 30% off", "unsubscribe"), ("junk", "invoice sale", ""),
        ("junk", "sale", "hi"), ("receipt", "this", "week"), ("keep", "hi", "invoice no 7"),
    ], "tag string, subject string, snippet string")
    hits = kw.with_signals(df, tax).select(kw.first_contradiction("tag").alias("hit"))
    got = [r.hit for r in hits.collect()]
    assert df.filter(kw.has_signal(tax)).count() == 4  # "this" and "week" do not meet
    assert df.filter("subject = 'hi' AND snippet = 'x'").filter(kw.has_signal(tax)).count() == 0
    odd = Taxonomy("x", (), (KeywordRule("a", ("a.b", "q\\Ez")),))
    texts = spark.createDataFrame([("a.b", ""), ("axb", ""), ("q\\Ez", ""), ("qez", "")],
                                  "subject string, snippet string")
    assert [r.subject for r in texts.filter(kw.has_signal(odd)).collect()] == ["a.b"]
    none = kw.with_signals(df, Taxonomy("x", ())).select(kw.first_contradiction("tag").alias("hit"))
    assert {r.hit for r in none.collect()} == {None}
    assert got[0].suspected_tag == "junk"
    assert got[0].trigger_keywords == ["unsubscribe", "% off", "sale"]
    assert got[1].suspected_tag == "receipt" and got[1].trigger_keywords == ["invoice"]
    assert got[2] is None
    assert got[3] is None  # the fields meet at a line break, not at a space
    assert got[4].suspected_tag == "receipt"  # both fields, whatever the rule lists


def random_rules(rng, n):
    """Keywords of one to twelve characters over few letters, so that many hit, some not ASCII."""
    def word():
        return "".join(rng.choice("abcdé %") for _ in range(rng.choice([1, 4, 5, 6, 7, 9, 12])))

    def rule(i):
        fields = rng.choice([("subject",), ("subject", "snippet"), ("from_addr", "body")])
        return KeywordRule(f"t{i % 7}", tuple(word() for _ in range(10)), fields)

    return Taxonomy("x", tuple(Tag(f"t{i}", "d") for i in range(7)), tuple(rule(i) for i in range(n // 10)))


def test_many_keywords_equal_brute_force(spark):
    rng = random.Random(4)
    rules = random_rules(rng, 5000)
    texts = [("".join(rng.choice("abcdefé %") for _ in range(n)), "".join(rng.choice("abcdxyzé") for _ in range(2 * n)), "b@c")
             for n in (0, 1, 2, 3, 10, 30, 30, 30, 60)] + [("zzzz", "yyyy", "q@r")]
    df = spark.createDataFrame(texts, "subject string, snippet string, from_addr string")

    def text_of(row, fields):
        have = dict(zip(("subject", "snippet", "from_addr"), row))
        return " ".join(have.get(f, "") for f in fields)

    hints = [next((r.tag for r in rules.keyword_rules if any(k in text_of(t, r.fields) for k in r.keywords)), None)
             for t in texts]
    both = [f"{s}\n{t}" for s, t, _ in texts]
    signals = [[(r.tag, [k for k in r.keywords if k in t]) for r in rules.keyword_rules if any(k in t for k in r.keywords)]
               for t in both]
    got = kw.with_signals(kw.with_keyword_hint(df, rules), rules).withColumn("any", kw.has_signal(rules)).collect()
    assert [r.keyword_hint for r in got] == hints and len({*hints}) > 2
    assert [[(s.suspected_tag, s.trigger_keywords) for s in r.signals] for r in got] == signals
    assert [r.any for r in got] == [bool(s) for s in signals]


def test_few_keywords_share_a_slot():
    words = tuple(f"keyword number {i}" for i in range(5000))
    table = kw.GramTable.of((KeywordRule("a", words, ("subject",)),))
    assert sum(map(len, table.slots)) == 5000 and not table.short
    # Filed by their rarest gram: a common beginning does not fill one slot.
    assert max(map(len, table.slots)) < 20
