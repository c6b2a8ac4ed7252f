"""Keyword rules as column expressions: first matching rule, matched keywords.

The rules are literals of the plan, so no row is ever multiplied by a rule table.
Up to CASE_LIMIT keywords the match is a short-circuit CASE chain inside
whole-stage codegen, at the cost of one search of the text for each keyword. Beyond
that the cost is that of the text: its q-grams are looked up in one table, which
names for each q-gram the few keywords that hold it at a place of their own, and
only these are searched for. Measured on texts of 500 characters, both cost about
the same at a few hundred keywords, and 5,000 cost twice as much as 1,000.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailloom.taxonomy import KeywordRule, Taxonomy

CASE_LIMIT = 200
GRAM = 4  # bytes; the few keywords that are shorter are searched for one by one
HINT_FIELDS = ("subject", "from_addr", "snippet")


@dataclass(frozen=True)
class GramTable:
    """Keywords in rule order, filed by their rarest q-gram.

    `slots` holds, at the CRC-32 of a q-gram modulo its length, the places of keywords.
    Other q-grams that fall on a slot only cause a search that finds nothing.
    """

    words: list[str]
    tags: list[str]
    rules: list[int]
    slots: list[list[int]]
    short: list[int]

    @classmethod
    def of(cls, rules: tuple[KeywordRule, ...], wanted=lambda rule: True) -> GramTable:
        entries = [(w, r.tag, i) for i, r in enumerate(rules) if wanted(r) for w in r.keywords]
        words, tags, places = (list(c) for c in zip(*entries)) if entries else ([], [], [])
        raw = [w.encode() for w in words]
        grams = [{w[i:i + GRAM] for i in range(len(w) - GRAM + 1)} for w in raw]
        common = Counter(g for gs in grams for g in gs)
        size = 64
        while size < 8 * len(words):
            size *= 2
        slots: list[list[int]] = [[] for _ in range(size)]
        for k, gs in enumerate(grams):
            if gs:
                slots[zlib.crc32(min(gs, key=lambda g: (common[g], g))) % size].append(k)
        return cls(words, tags, places, slots, [k for k, gs in enumerate(grams) if not gs])

    def found(self, text: Column) -> Column:
        """Places of the keywords that the text contains, in rule order."""
        if not self.words:
            return F.array().cast("array<int>")
        raw = text.cast("binary")
        starts = F.octet_length(text) - GRAM + 1
        # Literals of one value: the optimiser folds them once for the plan.
        slots = F.from_json(F.lit(json.dumps(self.slots)), "array<array<int>>")
        words = F.from_json(F.lit(json.dumps(self.words)), "array<string>")
        near = F.transform(F.sequence(F.lit(1), F.greatest(starts, F.lit(1))), lambda i: F.get(
            slots, (F.crc32(F.substring(raw, i, F.lit(GRAM))) % len(self.slots)).cast("int")))
        some = F.array_distinct(F.flatten(F.filter(near, lambda ks: F.size(ks) > 0)))
        if self.short:
            some = F.concat(some, F.lit(self.short))
        return F.array_sort(F.filter(some, lambda k: F.contains(text, F.get(words, k))))


def _any_of(haystack: Column, keywords: tuple[str, ...]) -> Column:
    return reduce(
        lambda a, b: a | b, [F.contains(haystack, F.lit(k)) for k in keywords], F.lit(False)
    )


def _joined(fields: tuple[str, ...]) -> Column:
    """Fields joined by one space in lower case; an unknown field counts as ''."""
    parts = [F.coalesce(F.col(f), F.lit("")) if f in HINT_FIELDS else F.lit("") for f in fields]
    return F.lower(F.concat_ws(" ", *parts))


def with_keyword_hint(messages: DataFrame, taxonomy: Taxonomy,
                      column: str = "keyword_hint") -> DataFrame:
    """Add the tag of the first rule (in order) with a keyword in its fields."""
    rules = taxonomy.keyword_rules
    if not rules:
        return messages.withColumn(column, F.lit(None).cast("string"))
    slot = {f: i for i, f in enumerate(dict.fromkeys(r.fields for r in rules))}
    # One text per distinct field list, made once and shared by all its rules.
    texts = {f: f"__text_{i}" for f, i in slot.items()}
    wide = messages.withColumns({name: _joined(f) for f, name in texts.items()})
    if sum(len(r.keywords) for r in rules) <= CASE_LIMIT:
        hint = reduce(
            lambda chain, r: chain.when(_any_of(F.col(texts[r.fields]), r.keywords), F.lit(r.tag)),
            rules,
            F.when(F.lit(False), F.lit(None).cast("string")),
        )
    else:
        # The first rule of each field list, then the first of these.
        firsts = []
        for fields, name in texts.items():
            table = GramTable.of(rules, lambda r, own=fields: r.fields == own)
            k = F.get(table.found(F.col(name)), F.lit(0))
            firsts.append(F.when(k.isNotNull(), F.struct(
                F.get(F.lit(table.rules), k).alias("rule"), F.get(F.lit(table.tags), k).alias("tag"))))
        hint = F.array_min(F.array_compact(F.array(*firsts)))["tag"]
    return wide.withColumn(column, hint).drop(*texts.values())


def _audit_text() -> Column:
    """Subject and snippet, always both, whatever fields a rule lists."""
    return F.lower(F.concat_ws("\n", F.coalesce("subject", F.lit("")),
                               F.coalesce("snippet", F.lit(""))))


def has_signal(taxonomy: Taxonomy) -> Column:
    """Whether any keyword of any rule is in the text.

    One pattern, so that the text is made once however far the filter is pushed.
    """
    words = [k for r in taxonomy.keyword_rules for k in r.keywords]
    if not words:
        return F.lit(False)
    if len(words) > CASE_LIMIT:
        return F.size(GramTable.of(taxonomy.keyword_rules).found(_audit_text())) > 0
    quoted = ["\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words]
    return F.rlike(_audit_text(), F.lit("|".join(quoted)))


def with_signals(messages: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Add `signals`: the rules, in order, with a keyword in subject or snippet, as
    array of struct(suspected_tag, trigger_keywords); keywords stay in rule order.
    """
    wide = messages.withColumn("__text", _audit_text())
    text = F.col("__text")
    rules = taxonomy.keyword_rules
    if not rules:
        found = F.array().cast("array<struct<suspected_tag:string,trigger_keywords:array<string>>>")
    elif sum(len(r.keywords) for r in rules) <= CASE_LIMIT:
        found = F.array_compact(F.array(*[
            F.when(
                _any_of(text, r.keywords),
                F.struct(
                    F.lit(r.tag).alias("suspected_tag"),
                    F.array_compact(F.array(*[
                        F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in r.keywords
                    ])).alias("trigger_keywords"),
                ),
            )
            for r in rules
        ]))
    else:
        table = GramTable.of(rules)
        rule_of, tags, words = (F.lit(v) for v in (table.rules, table.tags, table.words))
        hits = F.col("__hits")
        wide = wide.withColumn("__hits", table.found(text))
        found = F.transform(
            F.array_distinct(F.transform(hits, lambda k: F.get(rule_of, k))),
            lambda r: F.transform(F.filter(hits, lambda k: F.get(rule_of, k) == r), lambda k: F.struct(
                F.get(tags, k).alias("tag"), F.get(words, k).alias("word"))))
        found = F.transform(found, lambda g: F.struct(
            F.get(g, F.lit(0))["tag"].alias("suspected_tag"),
            F.transform(g, lambda x: x["word"]).alias("trigger_keywords")))
    return wide.withColumn("signals", found).drop("__text", "__hits")


def first_contradiction(assigned: str) -> Column:
    """First signal of another tag than the assigned one, or null."""
    other = F.filter("signals", lambda hit: hit["suspected_tag"] != F.col(assigned))
    return F.get(other, F.lit(0))
