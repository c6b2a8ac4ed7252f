"""Removal of word runs that stand in a document with a smaller doc_id.

The windows that several documents share are found first. The runs of windows that a
document is the first to hold are the reference text; it is cut into shards of bounded
size. Each shard becomes a suffix automaton over words, whose states know the smallest
document they stand in. Every other run of shared windows streams through the automaton
of its owner's shard for matching statistics, and spans that reach the window width in a
smaller document are removed. A shard that very many runs ask for is handed to several
tasks, each with the automaton and a part of the runs.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import kept, parts_for, small_batches
from mailloom.llm.grams import block_windows, shared_windows

WIDTH = 13
SHARD_WORDS = 60_000
TASK_WORDS = 600_000
_words = re.compile("[^ \t\n\x0b\x0c\r]+").findall


class SuffixAutomaton:
    """All word runs of the passages added, in ascending order of their document."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, moves: dict, link: int, first) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for the run that reaches q from p by the shorter way."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, doc) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matches(self, words: list, bound: int):
        """For each word the longest run ending there that the passages hold, up to `bound`
        words, and the smallest document with it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        s, n = 0, 0
        for word in words:
            while s and word not in nxt[s]:
                s = link[s]
                n = length[s]
            if word in nxt[s]:
                s = nxt[s][word]
                n = min(n + 1, bound)
            while s and length[link[s]] >= n:
                s = link[s]
            yield n, first[s]


RUNS = "doc_id long, text_key long, runs array<struct<start:int,windows:int,owner:long>>"


def _runs(pdf):
    """Runs of shared windows with one owner, for each document of a block that has any."""
    import numpy as np
    import pandas as pd

    ids, keys, sizes, _, _, _, place, low, _, _ = block_windows(pdf)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, place, "right")
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:].astype("i8") != place[:-1].astype("i8") + 1) | (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(cut)
    windows = np.diff(np.append(at, len(place)))
    start = place[at].astype("i8") - (ends - sizes)[doc[at]]
    edges = np.searchsorted(doc[at], np.arange(len(ids) + 1))
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            out.append((ids[i], keys[i], [
                {"start": int(s), "windows": int(w), "owner": int(o)}
                for s, w, o in zip(start[a:b], windows[a:b], low[at[a:b]])]))
    return pd.DataFrame(out, columns=["doc_id", "text_key", "runs"])


FIRST = "doc_id long, text_key long, n_words long, out string, text string, runs array<struct<start:int,windows:int,owner:long>>"


def _render(words: list[str], digest: bool) -> str:
    text = " ".join(words)
    return hashlib.sha256(text.encode()).hexdigest() if digest else text


def _first_pass(digest: bool):
    """Documents without runs are done; the others go on with their texts."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                words = _words(text or "")
                out.append((len(words), _render(words, digest), None) if runs is None
                           else (len(words), None, text))
            got = pd.DataFrame(out, columns=["n_words", "out", "text"], index=pdf.index)
            yield pd.concat([pdf[["doc_id"]].astype("Int64"), pdf[["text_key"]], got, pdf[["runs"]]], axis=1)

    return run


def _passages(width: int):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, key, text, runs in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["runs"]):
                words = _words(text)
                for r in runs:
                    part = words[r["start"]:r["start"] + r["windows"] + width - 1]
                    out.append((int(r["owner"]), int(doc), int(key), int(r["start"]), len(part), " ".join(part)))
            yield pd.DataFrame(out, columns=["owner", "doc_id", "text_key", "start", "n", "words"])

    return run


SPANS = "doc_id long, text_key long, spans array<struct<start:int,end:int>>"


def _match(width: int):
    def run(pdf):
        import pandas as pd

        automaton = SuffixAutomaton()
        reference = pdf[pdf["owner"] == pdf["doc_id"]].sort_values(["doc_id", "start"])
        for doc, words in zip(reference["doc_id"].tolist(), reference["words"]):
            automaton.add(words.split(" "), doc)
        asked, out = pdf[pdf["owner"] != pdf["doc_id"]], []
        for doc, key, start, words in zip(asked["doc_id"].tolist(), asked["text_key"].tolist(),
                                          asked["start"].tolist(), asked["words"]):
            spans: list[list[int]] = []
            for i, (n, first) in enumerate(automaton.matches(words.split(" "), width), start + 1):
                if n == width and first < doc:
                    if spans and i - width <= spans[-1][1]:
                        spans[-1][1] = i
                    else:
                        spans.append([i - width, i])
            if spans:
                out.append((doc, key, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["doc_id", "text_key", "spans"])

    return run


def repeated_spans(touched: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS,
                   task_words: int = TASK_WORDS) -> DataFrame:
    """(doc_id, text_key, spans): word spans [start, end) that stand in a smaller document.

    `touched` holds texts with their runs of shared windows. Spans of different owners can
    overlap; they are sorted by start.
    """
    small_batches(touched.sparkSession)
    passages = kept(touched.select("doc_id", "text_key", "text", "runs").mapInPandas(
        _passages(width), "owner long, doc_id long, text_key long, start int, n int, words string"), "passages")
    reference = F.col("owner") == F.col("doc_id")
    total = passages.filter(reference).agg(F.sum("n")).first()[0]
    shards = parts_for(total, shard_words)
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    # One row for each shard that more runs ask for than one task takes.
    hot = kept(passages.filter(~reference).groupBy("shard").agg(
        F.ceil(F.sum("n") / task_words).cast("int").alias("salts")).filter("salts > 1"), "hot")
    passages = passages.join(hot, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(reference, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int")))
    spans = passages.withColumn("salt", F.explode(salt)).groupBy("shard", "salt").applyInPandas(
        _match(width), SPANS)
    return spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _cut(digest: bool):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                words = _words(text)
                left = words
                if spans is not None:
                    left, at = [], 0
                    for s in spans:  # they can overlap
                        left += words[at:s["start"]]
                        at = max(at, s["end"])
                    left += words[at:]
                out.append((len(words), len(words) - len(left), _render(left, digest)))
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(
                out, columns=["n_words", "n_removed", "out"], index=pdf.index)], axis=1)

    return run


def remove_repeats(df: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of `df` (doc_id, text).

    Each word goes that a window of `width` words covers which also stands in a document
    with a smaller doc_id; windows are judged on the texts as given. kept_text joins the
    words that are left by one blank; with `digest` it is kept_sha256 instead, so that no
    text is written. Null text has no words. Rows without doc_id keep all words and remove
    none elsewhere. Rows of one doc_id do not remove each other's words, and rows of equal
    doc_id and text get equal results. Other columns are not read. Texts are shuffled once.
    """
    runs = kept(shared_windows(df, width, False, False, _runs, RUNS), "runs")
    runs = runs.groupBy("doc_id", "text_key").agg(F.first("runs").alias("runs"))  # repeated rows
    small_batches(df.sparkSession)
    docs = df.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    first = kept(docs.join(runs, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "text", "runs").mapInPandas(_first_pass(digest), FIRST), "first")
    touched = first.filter("text IS NOT NULL")
    spans = kept(repeated_spans(touched, width), "spans")
    cut = touched.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").mapInPandas(
        _cut(digest), "doc_id long, n_words long, n_removed long, out string")
    done = first.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "out")
    return done.union(cut).withColumnRenamed("out", "kept_sha256" if digest else "kept_text")
