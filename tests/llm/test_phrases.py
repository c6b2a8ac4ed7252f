"""Phrases by SON partitioning against brute force, and odd rows."""

from __future__ import annotations

import collections
import re

import pytest

from mailloom.llm import phrases

DOCS = "doc_id long, text string, lang string, n string, phrase string, shard string, hash string"
EXTRA = ("n", "p", "s", "h")
VERSE = "the quick fox. the quick fox, the Quick fox jumps over\tthe lazy dog! a lazy dog; a lazy  dog\nof the quick fox"
TEXTS = [(1, VERSE, "en"), (1, VERSE, "en"), (2, None, "en"), (3, "", None), (4, VERSE, None), (5, VERSE, "und"),
         (None, "É é É é : É é É é", "fr"), (6, " \t ", "fr"), (7, "x " * 3000, "de"), (8, ".,;:!?\n\x0b\x0c\r", "de"),
         (9, "no break   here \x01 \x01 \x01", "en"), (10, "w" * 70_000 + " tail", "de")]


def brute(rows, support, top, inside=50):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = []
        for w, a in f.items():
            if len(w) == 1 or a < support:
                continue
            if any(len(v) == 3 and b >= support and w in (v[:2], v[1:]) and 100 * b >= inside * a for v, b in f.items()):
                continue
            cut = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            held.append((-cut[0], -a, " ".join(w).encode(), f[w[:cut[1]]], f[w[cut[1]:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(held)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    return sorted(tuple(r) for r in phrases.collocations(docs, **more).collect())


def test_phrases_equal_brute_force(spark):
    rows = TEXTS * 4
    want = brute(rows, 10, 2000)
    assert found(spark, rows) == want and {r[0] for r in want} == {"en", "und", "fr", "de"}
    assert found(spark, rows, support=5, top=3) == brute(rows, 5, 3)


def test_support_of_one_shard(spark):
    # Nine times is never enough and ten times always, wherever the texts fall.
    rows = [(i, f"only nine {i}", "en") for i in range(9)] + [(i, f"just ten {i}", "en") for i in range(10)]
    assert [r[2] for r in found(spark, rows)] == ["just ten"]


@pytest.mark.parametrize("tokens", [1, 50])
def test_full_bitmaps_and_short_runs_change_nothing(spark, tokens):
    rows = TEXTS[:6] * 4
    bounds = phrases.Bounds(run_tokens=tokens, word_bits=6, phrase_bits=10, part_bytes=1)
    assert found(spark, rows, bounds=bounds) == brute(rows, 10, 2000)


def test_no_texts(spark):
    assert found(spark, []) == [] and found(spark, TEXTS[2:4]) == []
