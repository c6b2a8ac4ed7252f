"""Operators for training data: odd rows, and results against brute force."""

from __future__ import annotations

import collections
import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from mailloom.llm import (
    components, decontamination, jaccard, ngram_trie, packing, quality_classifier, quality_rules, secrets,
    substrings, warc, wavelet,
)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, n_words string, spans string, label string"
LONG = " ".join(f"w{i} the" for i in range(30_000))
SAME = " ".join(f"same{i} of" for i in range(20))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (7, SAME + " tail end"),
       (None, SAME), (8, "one"), (9, "\x00 ß É"), (10, "x" * 100_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "7", "s", "l") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def path(name):
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path(name))


def test_quality(odd, empty):
    got = quality_rules.quality_report(odd).collect()
    assert len(got) == len(ODD) and quality_rules.quality_report(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and by[5].kept
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_jaccard(odd, empty):
    got = sorted(jaccard.jaccard_components(odd).collect(), key=str)
    label = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(ODD) and label[6] == label[7] == label[5] == 5 and label[4] == 4
    assert label[1] == 1 and label[2] == 2 and label[None] is None
    assert jaccard.jaccard_components(empty).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.keep_first(odd).collect()) == sorted(
        map(str, [1, 2, 3, 4, 5, 8, 9, 10, None]))


def test_jaccard_in_blocks(odd):
    want = sorted(map(str, jaccard.jaccard_components(odd).collect()))
    assert sorted(map(str, jaccard.jaccard_components(odd, group_docs=1).collect())) == want


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(99, 98)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98}


def brute_repeats(rows):
    first, out = {}, []
    words = {d: t.split(" ") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i:i + 13]), d)
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_substrings(spark, odd, empty):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(3, a + " x " + b), (1, b), (2, "y " + a[:60] + " z"), (4, b + " " + a), (5, a + " " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_repeats(df).collect())) == brute_repeats(rows)
    got = [r for r in substrings.remove_repeats(odd).collect()]
    assert len(got) == len(ODD) and substrings.remove_repeats(empty).count() == 0
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 1, 2, 4, 5))
    assert {r.n_removed for r in got if r.doc_id in (6, 7)} == {40}


def test_automaton():
    s = substrings.SuffixAutomaton()
    s.add(list("abcabd"), 1)
    s.add(list("cabx"), 2)
    assert list(s.matches(list("zcabd"), 3)) == [(0, None), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert list(s.matches(list("abx"), 9))[-1] == (3, 2)


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, SAME, 0), (2, "w7 THE w8", 0), (3, None, 0), (4, "", 0), (5, "absent word", 0)],
                                  "item_id long, text string, label int")
    got = {(r.doc_id, r.n_hit): r for r in decontamination.contamination(odd, items).collect()}
    assert got[5, 40].item_ids == ["1"] and got[7, 40].n_words == 42 and got[4, 3].item_ids == ["2"] and got[1, 0].n_words == 0
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(odd, items.filter("item_id > 9")).filter("contaminated").count() == 0
    assert {r.doc_id for r in decontamination.keep_clean(odd, items).collect()} == {1, 2, 3, 8, 9, 10}
    phrases = decontamination.phrases_of(items.filter("item_id = 2"))
    index = decontamination.build_index(odd, phrases.terms)
    assert decontamination.proximity_matches(index, phrases, 2).count() > 0


def test_secrets(spark, empty):
    key = "0f4b1c2d3e5a69788796a5b4c3d2e1f001122334"
    df = spark.createDataFrame([
        (1, f'é the token = "{key}" and more', "a"), (2, "thisisaverylongwordindeedreally", "b"), (3, None, "c"), (4, "", "d")],
        "doc_id long, text string, probability string")
    got = {r.doc_id: r for r in secrets.findings(df).collect()}
    assert set(got) == {1, 2} and got[1].secret and got[1].start == 15 and not got[2].secret
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert masked == {1: 'é the token = "[SECRET]" and more', 2: "thisisaverylongwordindeedreally", 3: None, 4: ""}
    assert secrets.findings(empty).count() == 0


def test_packing(odd, empty):
    got = packing.pack(odd, path("word_bpe_49k.json"), part_tokens=30_000).collect()
    sizes = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes[r.sequence_id] and len(r.ids) == 4 * r.length
        sizes[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(sizes.values())
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


def test_hilbert_neighbours():
    np = pytest.importorskip("numpy")
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = grid[np.argsort(packing.hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_wavelet(spark, odd, empty):
    np = pytest.importorskip("numpy")
    v = np.random.default_rng(3).integers(0, 50, 3000)
    w, docs, lengths = wavelet.read_shard(wavelet.write_shard(v, [None, 7], [1000, 2000]))
    assert (w.decode() == v).all() and docs == [None, 7] and list(lengths) == [1000, 2000]
    assert [w.access(i) for i in (0, 511, 512, 2999)] == [v[i] for i in (0, 511, 512, 2999)]
    assert w.occurrences(11) == np.flatnonzero(v == 11).tolist() and w.count(99) == 0
    assert w.rank(11, 1234) == (v[:1234] == 11).sum()
    got = sorted(wavelet.read_tokens(*wavelet.write_tokens(odd, path("byte_bpe_50k.json"))).collect(), key=lambda r: r.start)
    assert len(got) == len(ODD) and got[0].doc_id is None and got[1].n_tokens == 1
    assert wavelet.read_tokens(*wavelet.write_tokens(empty, path("byte_bpe_50k.json"))).count() == 0
    with pytest.raises(ValueError):
        wavelet.read_shard(wavelet.write_shard(v, [1], [3000])[:-5])


def test_token_ids():
    from mailloom.llm.tokens import Encoder

    texts = ["", " a", "a  b\n\nc ", "It's THE Éa\xa0b", "x<|endoftext|>y", "1234 ab12 __ İ ς\x1c", "a\n b\tc", "漢字 é"]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        e = Encoder(path(name), kind)
        assert [e.ids(t) for t in texts * 3] == [e.whole(t) if t else b"" for t in texts * 3]


def test_block_places():
    import numpy as np

    from mailloom.llm.grams import _get, _put

    for top in (5, (1 << 24) - 1, 1 << 24, (1 << 32) - 1):
        places = np.array([0, top, 3], "i8")
        got = _get(_put(np.array([1, 2, 1 << 50], "u8"), places, np.array([7, 9]), np.array([1, 2])))
        assert got[1].tolist() == places.tolist() and got[0].tolist() == [1, 2, 1 << 50]
        assert got[2].tolist() == [7, 9] and got[3].tolist() == [1, 3]
    with pytest.raises(ValueError):
        _put(np.array([1], "u8"), np.array([1 << 32], "i8"), np.array([7]), np.array([1]))


def test_language_model(spark, odd, empty):
    got = ngram_trie.score_texts(odd).collect()
    assert len(got) == len(ODD) and ngram_trie.score_texts(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 1 and by[5].score > by[5].base_score
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_language_model_pairs_met_once(spark):
    texts = {1: "red fox", 2: "blue fox jumps"}
    docs = spark.createDataFrame([(*r, "7", "s", "l") for r in texts.items()], DOCS)
    words, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts.values():
        seq = ["<s>", *t.split(), "</s>"]
        words.update(seq[1:])
        contexts.update(seq[:-1])
        pairs.update(zip(seq, seq[1:]))
    kinds = collections.Counter(a for a, _ in pairs)

    def p(a, b):
        base = (words[b] + 0.1) / (sum(words.values()) + 0.1 * (len(words) + 1))
        return (pairs[a, b] - 0.75 + 0.75 * kinds[a] * base) / contexts[a]

    for r in ngram_trie.score_texts(docs, F.lit(False)).collect():
        seq = ["<s>", *texts[r.doc_id].split(), "</s>"]
        want = sum(math.log10(p(a, b)) for a, b in zip(seq, seq[1:]))
        assert abs(r.score - want) < r.n_tokens / 32


def test_weak_labels(odd, empty):
    got = {r.doc_id: r for r in quality_classifier.classify(odd).collect()}
    assert not got[1].kept and not got[2].kept and quality_classifier.classify(empty).count() == 0
    fitted = quality_classifier.fit_votes([("11-", 80), ("00-", 15), ("10-", 2), ("---", 3)])
    assert fitted["11-"] > 0.9 and fitted["00-"] < 0.1


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u", "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (2, "v\r\nw", None, 1), (4, "x", "", 1), (None, "n", "q", 1)],
                                  "page_id long, url string, html string, size int")
    got = {r.page_id: r for r in warc.read_archives(*warc.write_archives(pages)).collect()}
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 1, 9) and got[1].payload == "<p>é</p>".encode()
    assert got[2].record_type == "response" and got[4].refers_to == 2 and got[None].record_type == "response"
    assert warc.read_archives(*warc.write_archives(pages.limit(0))).count() == 0


def test_salvage():
    records = [warc.member(warc.record_bytes(i, "u", b"payload %d" % i, "X")) for i in range(9)]
    data = bytearray(b"".join(records))
    at = sum(map(len, records[:4]))
    data[at + 30] ^= 255
    got = list(warc.salvage(bytes(data)))
    assert [g[0] for g in got] == ["record"] * 4 + ["gap"] + ["record"] * 4
    assert (got[4][1], got[4][2]) == (at, at + len(records[4])) and list(warc.salvage(b"")) == []


def test_byte_memory_holds_a_word_once():
    """Letters are found again behind a blank and before signs, and are kept once."""
    from mailloom.llm.tokens import ByteEncoder

    enc = ByteEncoder(path("byte_bpe_50k.json"))
    for text in ("so Zuqarst, Zuqarst. Zuqarst blorno blorno, (else) other's\nelse é", "a Zuqarst! blorno; " + "y" * 99 + ". ",
                 "x Ärgö, Ärgö İx, \x85 b", "x Ärgö, İx, Ärgö. 中文, 中文 x1, x1 -- ,"):
        assert enc.ids(text) == enc.whole(text)
    kept = [*enc.words, *enc.pieces]
    for word in ("Zuqarst", "blorno", "Ärgö"):
        assert [w for w in kept if w in (word, " " + word)] == [word]


def test_byte_group_looks_a_word_up_once():
    """A group of texts has the ids of its texts one by one; words with signs are put together once."""
    from mailloom.llm.tokens import ByteEncoder

    enc = ByteEncoder(path("byte_bpe_50k.json"))
    texts = ["Zuqarst, blorno.\nElse Zuqarst,", "", " Zuqarst, ", "\nZuqarst,\n(x) \x00 it's\n", "a  b\n\nc", "\x1c0 \x1d0 \x85",
             "", "é, Ärgö,\nÄrgö, İx\xa0y", "Ärgö, 中文, é\n中文 «é», 12, x1, --", "\n", " ", "\n,", ",", "blorno, " * 50 + "Zuqarst,"]
    asked, learn = collections.Counter(), enc.words.learn
    enc.words.learn = lambda word: asked.update([word]) or learn(word)
    ids, sizes = enc.all_ids(texts)
    whole = [enc.whole(t) for t in texts]
    assert ids.tobytes() == b"".join(whole) and sizes.tolist() == [len(w) // 4 for w in whole]
    assert max(asked.values()) == asked["blorno,"] == asked["Zuqarst,"] == 1
    assert "blorno" in enc.words and "blorno," not in enc.words


def test_byte_memory_stays_bounded(monkeypatch):
    """A group of more different words than the memory holds neither fills it further nor changes ids."""
    from mailloom.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 40)
    enc = tokens.ByteEncoder(path("byte_bpe_50k.json"))
    for k in range(3):
        texts = [" ".join(f"{chr(97 + i)}{chr(97 + j)}q{'z' * k} {i}  {j}," for i in range(9)) for j in range(9)]
        texts += [t.replace("  ", " ") for t in texts]
        assert enc.all_ids(texts)[0].tobytes() == b"".join(map(enc.whole, texts))
        assert len(enc.words) + len(enc.pieces) <= 20 >= len(enc.old_words) + len(enc.old_pieces)


def test_word_features_by_outline():
    """Slots of words are those of their lower case and of their shape, for any signs."""
    import random
    import re

    import numpy as np

    def plain(text):
        words, slots = re.findall("[^ \t\n\x0b\x0c\r]+", text), collections.Counter()
        for word in words:
            shape = word[:40]
            for pattern, sign in (("[a-zß-öø-ÿ]+", "a"), ("[A-ZÀ-ÖØ-Þ]+", "A"), ("[0-9]+", "0")):
                shape = re.sub(pattern, sign, shape)
            for x in (word.lower(), "\1" + shape):
                slots[zlib.crc32(x.encode()) % quality_classifier.DIMS] += 1
        again = len(words) - len(set(words))
        slots = sorted(slots.items()) + ([(quality_classifier.DIMS + 1, again)] if again else [])
        return ([s for s, _ in slots], [math.sqrt(n / len(words)) for _, n in slots]) if words else ([0], [1.0])

    r = random.Random(3)
    signs = "aAzZ09ßàÀÿÞ×÷ĀŸİ,.- \n\t\x0b\x1d\x85\xa0Ω中\U0001F600"
    for text in ["", "É\x85a b\xa0c", "é" * 41 + "9 " + "x" * 100 + "A",
                 *("".join(r.choice(signs) for _ in range(r.randint(1, 120))) for _ in range(500))]:
        slots, values = quality_classifier.hashed(text)
        wanted = plain(text)
        assert slots.tolist() == wanted[0] and np.array_equal(values, wanted[1])
    # Words of one outline share one shape, worked out once.
    quality_classifier.hashed("Qwxa1, Tyuo2, Rtyi3,")
    assert b"Aaaa0," in quality_classifier._SHAPE_SLOTS
