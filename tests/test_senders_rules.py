from __future__ import annotations

import pytest
from conftest import rows_of

from mailloom.operators import intake, reports, review, rules, senders


@pytest.fixture(scope="module")
def messages(make, tax):
    return intake.index_messages(make.raw([
        ("INBOX", 10, 1, "a", "SALE, now 30% off", "offers@store.net"),
        ("INBOX", 10, 2, "b", "Deal", "offers@store.net", "unsubscribe"),
        ("INBOX", 10, 3, "c", "hi", "ann@pals.net"),
        ("INBOX", 10, 4, "d", "", "daemon"),
    ]), tax).cache()


def test_top_senders(messages):
    top = senders.top_senders(messages, 100).collect()
    assert top[0].from_addr == "offers@store.net" and top[0].message_count == 2
    assert top[0].keyword_hint == "junk" and top[0].example_subjects == ["SALE, now 30% off", "Deal"]
    assert len(senders.top_senders(messages, 1).collect()) == 1


def test_examples_drop_empty_after_the_cut(make, tax):
    raw = make.raw([("A", 1, i, str(i), s, "x@y.z") for i, s in enumerate(["", "one", "", "two"], 1)])
    got = senders.sender_profiles(intake.index_messages(raw, tax)).first()
    assert got.example_subjects == ["one"]


def test_profiles_equal_top(messages):
    columns = ["from_addr", "message_count", "keyword_hint", "first_seen", "last_seen"]
    assert rows_of(senders.sender_profiles(messages), *columns) == rows_of(
        senders.top_senders(messages, 100), *columns)


def test_empty(messages):
    assert senders.top_senders(messages.filter("false")).count() == 0
    assert senders.sender_profiles(messages.filter("false")).count() == 0


def test_search_reaches_any_rank(messages):
    assert rows_of(senders.senders_matching(messages, "PALS"), "from_addr") == [("ann@pals.net",)]


def test_rollup_skips_empty_domain(messages):
    got = senders.domain_rollup(senders.sender_profiles(messages))
    assert rows_of(got) == [("pals.net", 1), ("store.net", 2)]


def test_report_escapes_pipes(make, tax):
    m = intake.index_messages(make.raw([("A", 1, 1, "a", "a|b", "x@y.z")]), tax)
    lines = reports.sender_report_lines(senders.top_senders(m, 5), "v1", 5)
    text = [r.line for r in lines.orderBy(*reports.LINE_ORDER).collect()]
    assert text[0] == "# Top 5 senders" and text[2] == "_Taxonomy version: v1_"
    assert text[-1] == "| 1 | x@y.z | y.z | 1 | — | a\\|b |"


# --- rules ---------------------------------------------------------------------------


@pytest.fixture(params=[10**6, 0], ids=["broadcast", "salted"])
def bound(request):
    return request.param


def resolved(messages, rule_rows, make, tax, bound, **kw):
    out = rules.resolve_rules(messages, make.rules(rule_rows), tax, max_rows=bound, **kw)
    return {r.uid: r for r in out.collect()}


def test_address_beats_domain(messages, make, tax, bound):
    got = resolved(messages, [("addr", "offers@store.net", "keep", None),
                              ("domain", "store.net", "junk", None)], make, tax, bound)
    assert (got[1].resolved_tag, got[1].method, got[1].confidence) == ("keep", "sender_rule", 1.0)


def test_domain_fallback_and_subtag(messages, make, tax, bound):
    got = resolved(messages, [("domain", "pals.net", "receipt", "bank")], make, tax, bound)
    assert (got[3].resolved_tag, got[3].resolved_subtag) == ("receipt", "bank")
    assert (got[1].resolved_tag, got[1].method) == ("junk", "keyword_rule")
    assert got[4].resolved_tag is None and got[4].method is None and got[4].confidence is None


def test_invalid_leaf_falls_through(messages, make, tax, bound):
    rows = [("addr", "ann@pals.net", "nonsuch", None), ("domain", "pals.net", "newsletter", "")]
    assert resolved(messages, rows, make, tax, bound)[3].resolved_tag == "newsletter"
    table = make.rules(rows)
    assert rules.invalid_rules(table, tax).count() == 1
    assert rows_of(rules.mark_stale_rules(table, tax), "leaf", "stale") == [
        ("newsletter", False), ("nonsuch", True)]


def test_advisory_keywords(messages, make, tax, bound):
    got = resolved(messages, [], make, tax, bound, keyword_authoritative=False)
    assert all(r.resolved_tag is None for r in got.values())


def test_coverage(messages, make, tax):
    row = rules.coverage(messages, make.rules([]), tax).first()
    assert (row.total, row.covered, row.fraction, row.below_target) == (4, 2, 0.5, True)
    empty = rules.coverage(messages.filter("false"), make.rules([]), tax).first()
    assert (empty.total, empty.covered, empty.fraction) == (0, 0, 0.0)


# --- queue ------------------------------------------------------------------------------


def test_queue(messages, make):
    queue = review.review_queue(messages, make.rules([("domain", "store.net", "junk", "marketing")]),
                                make.deferrals([("addr", "ann@pals.net", "ask"),
                                                ("domain", "store.net", "old")]))
    got = [(r.scope, r.key, r.message_count, r.status, r.current_leaf, r.note)
           for r in queue.collect()]
    assert got == [
        ("addr", "offers@store.net", 2, "undecided", None, ""),
        ("domain", "pals.net", 1, "undecided", None, ""),
        ("addr", "daemon", 1, "undecided", None, ""),
        ("addr", "ann@pals.net", 1, "deferred", None, "ask"),
        ("domain", "store.net", 2, "decided", "junk/marketing", "old"),
    ]
    assert rows_of(review.queue_search(queue, "PALS"), "key") == [
        ("ann@pals.net",), ("pals.net",)]
    by_count = [r.message_count for r in review.queue_sort_by(queue, "message_count", True).collect()]
    assert by_count == sorted(by_count, reverse=True)
    for column in review.SORTABLE:
        assert review.queue_sort_by(queue, column).count() == 5
    with pytest.raises(ValueError):
        review.queue_sort_by(queue, "nope")


def test_queue_filter_reaches_the_tail(make, tax):
    raw = make.raw([("A", 1, i, str(i), "s", "bulk@x.com") for i in range(1, 6)]
                   + [("A", 1, 9, "z", "s", "rare@tail.org")])
    m = intake.index_messages(raw, tax)
    none = (make.rules([]), make.deferrals([]))
    assert "rare@tail.org" not in [r.key for r in review.review_queue(m, *none, n=1).collect()]
    found = [r.key for r in review.review_queue(m, *none, n=1, sender="tail").collect()]
    assert found == ["tail.org", "rare@tail.org"]
