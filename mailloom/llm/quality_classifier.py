"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-
maximisation over the counts of vote patterns (at most 3 to the number of labellers, so a
small table whatever the input) estimates each labeller's accuracy and the share of good
texts. The posterior of a text's pattern is its label; labels of a bounded sample train a
linear scorer on hashed words and word shapes, which then scores every whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mailloom.llm.common import kept, small_batches
from mailloom.llm.quality_rules import measured

SAMPLE_ROWS = 4000
DIMS = 1 << 15
ROUNDS = 100


def votes() -> dict[str, Column]:
    """1 good, 0 bad, null no vote, of the measures in __quality."""
    q = lambda k: F.col("__quality")[k]
    n = q("n_words")

    def vote(measure: str, per: str, good: int, bad: int) -> Column:
        share = F.lit(100) * q(measure)
        return F.when(share >= bad * q(per), 0).when(share <= good * q(per), 1)

    def mostly(pattern: str, good: int, bad: int) -> Column:
        left = F.char_length(F.regexp_replace("text", pattern, ""))
        share = F.lit(100) * (F.char_length("text") - left)
        return F.when(share >= bad * F.char_length("text"), 0).when(share <= good * F.char_length("text"), 1)

    stop = F.lit(100) * q("n_stop_words")
    return {
        "symbols": vote("n_symbols", "n_words", 5, 20),
        "stop_words": F.when((stop < 4 * n) & (n > 25), 0).when(stop >= 8 * n, 1),
        "repeats": vote("n_repeat_words", "n_words", 5, 20),
        "lines": vote("n_dup_lines", "n_lines", 5, 40),
        "length": F.when(n < 10, 0).when(n >= 40, 1),
        "word_length": F.when((q("word_chars") > 12 * n) | (q("word_chars") < 2 * n), 0).when(
            q("word_chars").between(3 * n, 8 * n), 1),
        "capitals": mostly("[A-Z]+", 10, 40),
        # Words that follow themselves.
        "echoes": mostly("(?<!\\S)(\\S{1,40}+)(?: \\1)+(?!\\S)", 5, 15),
        "signs": mostly("[^\\p{L}\\s.,;:'\"()\\-]+", 2, 8),
    }


def fit_votes(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of good for each pattern of votes ("1", "0", "-"), by EM from majority votes."""
    if not patterns:
        return {}
    v = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in p] for p, _ in patterns])
    k = np.array([n for _, n in patterns], "float64")
    voted = v >= 0
    good = np.where(voted.any(1), np.where(voted, v, 0).sum(1) / np.maximum(voted.sum(1), 1), 0.5)
    for _ in range(rounds):
        w1, w0 = k * good, k * (1 - good)
        prior = np.clip(w1.sum() / k.sum(), 0.01, 0.99)
        # Chance that a labeller votes good, given a good and a bad text; lightly smoothed.
        yes1 = (w1 @ (v == 1) + 1.8) / (w1 @ voted + 2)
        yes0 = (w0 @ (v == 1) + 0.2) / (w0 @ voted + 2)
        odds = np.log(prior / (1 - prior)) + np.where(v == 1, np.log(yes1 / yes0), 0).sum(1) + np.where(
            v == 0, np.log((1 - yes1) / (1 - yes0)), 0).sum(1)
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {p: float(g) for (p, _), g in zip(patterns, good)}


_SHAPES = [(re.compile(p), r) for p, r in (("[a-zß-öø-ÿ]+", "a"), ("[A-ZÀ-ÖØ-Þ]+", "A"), ("[0-9]+", "0"))]
# The signs of Latin-1 with each letter and digit as its kind: words of one outline have one shape.
_OUTLINE = b"".join(
    next((r for p, r in _SHAPES if p.fullmatch(chr(i))), chr(i)).encode("latin-1") for i in range(256))


def _shape_slot(start: str) -> int:
    for pattern, sign in _SHAPES:
        start = pattern.sub(sign, start)
    return zlib.crc32(b"\1" + start.encode()) % DIMS << 32


class _Outlines(dict):
    """Shape features by outline."""

    def __missing__(self, outline: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        slot = self[outline] = _shape_slot(outline.decode("latin-1"))
        return slot


_SHAPE_SLOTS = _Outlines()


class _Slots(dict):
    """Hashed features of words in UTF-8: the word in lower case, and (in the upper bits) its shape.

    The shape is that of the first 40 characters.
    """

    def __missing__(self, word: bytes) -> int:
        if word.isascii():
            lower, start = word.lower(), word[:40]
        else:
            text = word.decode()
            lower, start = text.lower().encode(), text[:40]
            try:
                start = start.encode("latin-1")
            except UnicodeEncodeError:
                pass
        shape = _SHAPE_SLOTS[start.translate(_OUTLINE)] if isinstance(start, bytes) else _shape_slot(start)
        if len(self) > 600_000:
            self.clear()
        both = self[word] = zlib.crc32(lower) % DIMS + shape
        return both


_SLOTS = _Slots()


def hashed(text: str):
    """(slots, values) of a text; values are roots of shares of its words."""
    words = text.encode().split()  # bytes are cut at ASCII blanks alone
    if not words:
        return np.array([0]), np.array([1.0])
    both = np.fromiter(map(_SLOTS.__getitem__, words), "i8", len(words))
    slots, n = np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32]), return_counts=True)
    again = len(words) - len(set(words))
    if again:  # repeated words
        slots, n = np.append(slots, DIMS + 1), np.append(n, again)
    return slots, np.sqrt(n / len(words))


def train(rows, steps: int = 150):
    """Weights of a logistic scorer on ((slots, values), posterior); the last is the constant."""
    w = np.zeros(DIMS + 3)
    if not rows:
        return w
    made = [m for m, _ in rows]
    y = np.array([p for _, p in rows])
    col, val = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    row = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
    # Both kinds weigh alike, however rare bad texts are.
    weight = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
    w[-1] = 0.0
    square = np.zeros_like(w)
    for _ in range(steps):
        s = np.bincount(row, val * w[col], minlength=len(y)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight
        grad = np.bincount(col, val * err[row], minlength=len(w)) + 1e-6 * w
        grad[-1] = err.sum()
        square += grad**2
        w -= 0.3 * grad / (np.sqrt(square) + 1e-9)
    return w


def _sample(voted: DataFrame, rows: int) -> DataFrame:
    """(row_key, pattern, slots, shares) of the `rows` different texts with the smallest row keys,
    hashed in tasks: no text reaches the driver."""
    few = voted.select("row_key").distinct().orderBy("row_key").limit(rows)

    def run(batches):
        for pdf in batches:
            made = [hashed(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "row_key": pdf["row_key"], "pattern": pdf["pattern"],
                "slots": [s.astype("i8").tobytes() for s, _ in made], "shares": [v.tobytes() for _, v in made]})

    own = voted.join(F.broadcast(few), "row_key").select("row_key", "pattern", "text")
    return own.mapInPandas(run, "row_key long, pattern string, slots binary, shares binary").dropDuplicates(["row_key"])


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, posterior, score, kept) for each row of `docs` (doc_id, text).

    posterior is the label model's chance that the text is good, score the linear scorer's,
    kept says that the score is a half or more. Null and empty texts have a defined score and
    are not kept. At most `sample_rows` different rows, those with the smallest hashes of doc_id
    and text, train the scorer; votes are counted over all rows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = measured(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    pattern = F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in votes().values()])
    # The measures are taken once: texts are written beside their votes, for the scorer to read.
    voted = kept(made.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"),
                             pattern.alias("pattern")), "votes")
    counts = [(r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().orderBy("pattern").toLocalIterator()]
    posterior = fit_votes(counts)
    weights = train([((np.frombuffer(r["slots"], "i8"), np.frombuffer(r["shares"], "f8")), posterior[r["pattern"]])
                     for r in _sample(voted, sample_rows).orderBy("row_key").toLocalIterator()])

    def run(batches):
        for pdf in batches:
            s = []
            for text in pdf["text"]:
                slots, values = hashed(text)
                s.append(float(weights[slots] @ values + weights[-1]) if text.strip() else -30.0)
            score = 1 / (1 + np.exp(-np.clip(np.array(s, "float64"), -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "posterior": pdf["posterior"],
                                "score": score, "kept": score >= 0.5})

    # At most 3**9 patterns, held as a literal of the plan.
    chance = F.create_map(*[F.lit(x) for p, g in posterior.items() for x in (p, g)]) if posterior else None
    p = F.lit(0.5) if chance is None else F.element_at(chance, F.col("pattern"))
    scored = voted.select("doc_id", "text", p.alias("posterior"))
    return scored.mapInPandas(run, "doc_id long, posterior double, score double, kept boolean")
