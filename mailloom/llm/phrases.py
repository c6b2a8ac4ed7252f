"""Collocations by SON partitioning: phrases mined shard by shard, then counted exactly.

A phrase that occurs `support` times in a language occurs at least ceil(support / SHARDS)
times in one of SHARDS shards of its texts, however these are dealt. Three passes over the
texts, each with bounded memory in its tasks:

1. words and their counts; a bitmap of frequent words prunes phrases in what follows,
2. each shard is mined completely at the lowered support, by 64-bit hashes of phrases; the
   union over the shards is the set of candidates, kept as a bitmap,
3. phrases in the bitmap are counted by their words over all texts.

Both bitmaps have a bound. One that fills up, and hashes that collide, only let more
phrases through to the exact count of the third pass, so they change no result.

Texts: A-Z in lower case; pieces end at [.,;:!?] and line ends; words are what lies between
spaces and tabs. A null or empty text has no words, a null language is `und`. Equal rows
count each. Other columns of the input take no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from mailloom.llm.common import kept, small_batches

SUPPORT = 10
INSIDE = 50  # percent of a phrase's count in a longer one that make the phrase drop
TOP = 2_000
SHARDS = 4
UNKNOWN = "und"
COUNTS = "lang string, phrase string, n long"

ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Bounds:
    """What a task or a bitmap holds; none of it changes a result."""

    run_tokens: int = 2_000_000  # tokens that a task counts at once
    word_bits: int = 24  # 2 MB
    phrase_bits: int = 0  # 0: about one bit a word, 2 MB to 64 MB
    part_bytes: int = 32 << 20  # hashes that one task sums up; their parts are 2**10 to 2**20

    def of_phrases(self, total: int) -> int:
        return self.phrase_bits or min(29, max(24, total.bit_length()))


class Numbers(dict):
    """Words with their numbers; a new word takes the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Run:
    """Texts of one language as numbers of words; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.words, self.parts, self.size = Numbers({b"\n": 0, b"": 1}), [], 0

    def add(self, text: str) -> None:
        tokens = text.encode().lower().translate(PIECES).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.words.__getitem__, tokens), "i8", len(tokens))
        self.parts += [found[found != 1], np.zeros(1, "i8")]
        self.size += len(self.parts[-2]) + 1

    def tokens(self) -> np.ndarray:
        return np.concatenate(self.parts)


def _runs(batches: Iterator[pd.DataFrame], run_tokens: int) -> Iterator[tuple[str, Run]]:
    """Texts gathered by language; all are handed on when run_tokens are held."""
    held, size = {}, 0
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            run = held.setdefault(lang, Run())
            size -= run.size
            run.add(text)
            size += run.size
            if size >= run_tokens:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _counts(lang: str, phrases: list[str], n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": pd.Series([lang] * len(n), dtype=object),
                         "phrase": pd.Series(phrases, dtype=object), "n": n})


def _count_words(bounds: Bounds):
    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, run in _runs(batches, bounds.run_tokens):
            n = np.bincount(run.tokens(), minlength=len(run.words))[2:]
            yield _counts(lang, [w.decode() for w in run.words][2:], n)

    return run_


def _slot(lang: str, words: list[bytes]) -> np.ndarray:
    start = zlib.crc32(lang.encode() + b"\t")
    return np.fromiter((zlib.crc32(w, start) for w in words), "i8", len(words))


def _phrases(run: Run, lang: str, known: np.ndarray, word_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For two and three words in turn: places and hashes of all phrases of frequent words.

    Hashes are those of the words, mixed in order, so all tasks give a phrase the same one.
    """
    import xxhash

    words, tokens = list(run.words), run.tokens()
    slots = _slot(lang, words) & ((1 << word_bits) - 1)
    good = (known[slots >> 3] >> (slots & 7) & 1).astype(bool)
    good[0] = False
    mark = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), "u8", len(words))
    start = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    here = np.append(good[tokens], [False, False])
    at = np.flatnonzero(here)
    hashed = (start ^ mark[tokens[at]]) * MIX
    for length in (2, 3):
        on = here[at + length - 1]
        at, hashed = at[on], hashed[on]
        hashed = (hashed ^ (hashed >> np.uint64(29)) ^ mark[tokens[at + length - 1]]) * (MIX if length == 2 else TURN)
        yield length, at, hashed


def _width(lowered: int) -> str:
    return "u1" if lowered < 256 else "u8"


def _mine(known: Broadcast, bits: int, lowered: int, bounds: Bounds):
    """Phrases of each run by hash: its leading bits name a part, the 32 bits behind them cross the
    shuffle. A task's texts belong to one shard; counts beyond the lowered support are as good as that."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % SHARDS
        for lang, run in _runs(batches, bounds.run_tokens):
            every = [h for _, _, h in _phrases(run, lang, known.value, bounds.word_bits)]
            found, n = np.unique(np.concatenate(every), return_counts=True)
            parts = (found >> np.uint64(64 - bits)).astype("i8")
            own, starts = np.unique(parts, return_index=True)
            ends = np.append(starts[1:], len(found))
            found = (found >> np.uint64(32 - bits)).astype("u4")
            n = np.minimum(n, lowered).astype(_width(lowered))
            yield pd.DataFrame({
                "part": own, "shard": shard,
                "hashes": [found[s:e].tobytes() for s, e in zip(starts, ends)],
                "counts": [n[s:e].tobytes() for s, e in zip(starts, ends)],
            })

    return run_


def _frequent(lowered: int, bits: int, phrase_bits: int):
    """Of one part: a bitmap of the hashes that reach the lowered support in some shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        seen = np.zeros(1 << (phrase_bits - bits), bool)
        for _, own in pdf.groupby("shard"):
            hashes = np.frombuffer(b"".join(own["hashes"]), "u4")
            counts = np.frombuffer(b"".join(own["counts"]), _width(lowered))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order].astype("i8")
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            often = hashes[starts][np.add.reduceat(counts, starts) >= lowered]
            seen[often >> np.uint32(32 - (phrase_bits - bits))] = True
        return pd.DataFrame({"part": [part], "bitmap": [np.packbits(seen, bitorder="little").tobytes()]})

    return run


def _count(known: Broadcast, wanted: Broadcast, phrase_bits: int, bounds: Bounds):
    """Exact counts of the candidates of each run."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, run in _runs(batches, bounds.run_tokens):
            words, tokens = [w.decode() for w in run.words], run.tokens()
            for length, at, hashed in _phrases(run, lang, known.value, bounds.word_bits):
                bit = (hashed >> np.uint64(64 - phrase_bits)).astype("i8")
                at = at[(wanted.value[bit >> 3] >> (bit & 7) & 1).astype(bool)]
                code = tokens[at]
                for i in range(1, length):
                    if len(words) >= 1 << 21:  # of a very long text: codes must fit 64 bits
                        code = np.unique(code, return_inverse=True)[1]
                    code = code * len(words) + tokens[at + i]
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                text = [[words[w] for w in tokens[at[first] + i]] for i in range(length)]
                yield _counts(lang, list(map(" ".join, zip(*text))), n)

    return run_


def _word_bitmap(slots: DataFrame, word_bits: int) -> np.ndarray:
    """Column `slot` (0 to 2**word_bits - 1) as a bitmap; the driver gets at most 2**word_bits / 64 numbers."""
    long = slots.groupBy(F.expr("slot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toPandas()
    words = np.zeros(1 << max(word_bits - 6, 0), "i8")
    words[long["at"].to_numpy("i8")] = long["bits"].to_numpy("i8")
    return words.view("u1")


def _phrase_bitmap(local: DataFrame, lowered: int, bits: int, phrase_bits: int) -> np.ndarray:
    """Candidates of all shards as a bitmap; the driver gets its parts, 2**phrase_bits bits in all."""
    each = (1 << (phrase_bits - bits)) // 8
    wanted = np.zeros(1 << (phrase_bits - 3), "u1")
    often = _frequent(lowered, bits, phrase_bits)
    for row in local.groupBy("part").applyInPandas(often, "part long, bitmap binary").collect():
        wanted[row.part * each:(row.part + 1) * each] = np.frombuffer(row.bitmap, "u1")
    return wanted


def counted(docs: DataFrame, support: int = SUPPORT, bounds: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all words and phrases of two and three words that occur at least
    `support` times, and (lang, n): all words of each language."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("text <> ''")
    words = kept(texts.mapInPandas(_count_words(bounds), COUNTS)
                 .groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.filter(F.col("n") >= support)
    slot = F.crc32(F.concat("lang", F.lit("\t"), "phrase")).bitwiseAND(F.lit((1 << bounds.word_bits) - 1))
    known = context.broadcast(_word_bitmap(frequent.select(slot.alias("slot")), bounds.word_bits))
    phrase_bits = bounds.of_phrases(total)
    # A word starts at most two phrases, of five bytes each.
    bits = min(20, phrase_bits - 3, max(10, (10 * total // bounds.part_bytes).bit_length()))
    lowered = -(-support // SHARDS)
    local = texts.mapInPandas(_mine(known, bits, lowered, bounds), "part long, shard int, hashes binary, counts binary")
    wanted = context.broadcast(_phrase_bitmap(local, lowered, bits, phrase_bits))
    phrases = texts.mapInPandas(_count(known, wanted, phrase_bits, bounds), COUNTS).groupBy("lang", "phrase").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= support)
    every = kept(frequent.select("lang", "phrase", "n").unionByName(phrases)
                 .withColumn("words", F.size(F.split("phrase", " "))), "phrases")
    return every, sizes


def _tail(words: int) -> F.Column:
    return F.substring_index("phrase", " ", -words)


def _cuts(every: DataFrame) -> DataFrame:
    """Each candidate cut after its first word and, of three, after its second."""
    long = every.filter("words > 1")
    cut = F.sequence(F.lit(1), F.col("words") - 1)
    parts = long.withColumn("k", F.explode(cut))
    return parts.select(
        "lang", "phrase", "words", F.col("n").alias("a"), "k",
        F.when(F.col("k") == 1, F.substring_index("phrase", " ", 1)).otherwise(F.substring_index("phrase", " ", 2)).alias("left"),
        F.when(F.col("words") - F.col("k") == 1, _tail(1)).otherwise(_tail(2)).alias("right"))


def _scored(every: DataFrame) -> DataFrame:
    """Candidates with the counts of the parts of their lowest-scoring cut, of ties the first."""
    of = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    to = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    met = _cuts(every).join(of, ["lang", "left"]).join(to, ["lang", "right"])
    wide = [F.col(c).cast("decimal(18,0)") for c in "alr"]
    score = F.expr("(1000000BD * wa * wa) div (wl * wr)")
    cut = met.withColumns(dict(zip(("wa", "wl", "wr"), wide))).withColumn("score", score)
    return cut.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _standing(scored: DataFrame, every: DataFrame) -> DataFrame:
    """Without phrases of two words that mostly occur inside one candidate of three."""
    long = every.filter("words = 3")
    inner = long.select("lang", "n", F.explode(F.array(
        F.substring_index("phrase", " ", 2), _tail(2))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    held = scored.join(inner, ["lang", "phrase"], "left")
    return held.filter(F.expr(f"longer IS NULL OR longer * 100BD < a * {INSIDE}BD")).drop("longer")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score,
    count (both downwards) and phrase (by its bytes)."""
    every, sizes = counted(docs, support, bounds)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _standing(_scored(every), every).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
