"""Bigram language model in an Elias-Fano trie, one memory-mapped file for each range of words.

Level 1 holds the words of a range by 64-bit hash in Elias-Fano form, their counts, quantised
back-off weights, and Elias-Fano pointers to their successors. Level 2 holds successors as
32-bit marks, sorted within their word, with quantised probabilities. A query finds the
context on level 1 and searches the mark between its two pointers only. Probabilities are
absolute discounting over pairs met `min_pair` times or more, interpolated with word counts.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, functions as F

from mailloom.llm.common import kept, parts_for, small_batches, store_file, text_bytes
from mailloom.llm.grams import _unzip, _zip, word_hashes
from mailloom.session import fresh_path

DISCOUNT = 0.75
MIN_PAIR = 1  # every pair counts; above 1 prunes the model
BLOCK_TOKENS = 2_000_000
BUCKET_BYTES = 14_000_000
STEPS = 32  # quantised: -log10(p) in 32nds, one byte
START, END = 1, 2  # marks that stand for the edges of a text
_SPAN = 128  # bits between counts


class EliasFano:
    """A sorted sequence of unsigned numbers: low bytes plain, high parts in unary."""

    def __init__(self, arrays: dict, size: int, shift: int):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.size, self.shift = size, shift

    @staticmethod
    def encode(values, top: int) -> tuple[dict, int]:
        """Arrays and the number of low bits (a multiple of 8) of numbers below `top`."""
        import numpy as np

        n = max(1, len(values))
        shift = min(56, max(0, (top // n).bit_length() - 1) // 8 * 8)
        values = np.asarray(values, "uint64")
        low = values & np.uint64((1 << shift) - 1)
        high = (values >> np.uint64(shift)).astype("i8")
        bits = np.zeros((top >> shift) + len(values) + 2 + _SPAN, "u1")
        bits[high + np.arange(len(values))] = 1
        bits = bits[:len(bits) // _SPAN * _SPAN]
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, _SPAN).sum(1, dtype="i8"))])
        width = {0: "u1", 8: "u1", 16: "<u2", 24: "<u4", 32: "<u4"}.get(shift, "<u8")
        return {"low": low.astype(width), "high": np.packbits(bits), "ones": ones.astype("<u4")}, shift

    def _select(self, k, bit: int):
        """Places of the k-th (from 0) ones or zeros."""
        import numpy as np

        ones = self.ones
        # Counts before a span are searched where they lie; zeros by halving.
        lo, hi = np.zeros(len(k), "i8"), np.full(len(k), len(ones) - 1, "i8")
        while (hi - lo > 1).any():
            mid = (lo + hi) >> 1
            c = ones[mid].astype("i8")
            c = c if bit else mid * _SPAN - c
            lo, hi = np.where(c <= k, mid, lo), np.where(c <= k, hi, mid)
        before = ones[lo].astype("i8")
        before = before if bit else lo * _SPAN - before
        spans = np.unpackbits(self.high[(lo[:, None] * (_SPAN // 8) + np.arange(_SPAN // 8))], axis=1) == bit
        return lo * _SPAN + (np.cumsum(spans, 1, dtype="i2") > (k - before)[:, None]).argmax(1)

    def access(self, i):
        import numpy as np

        high = (self._select(i, 1) - i).astype("uint64")
        return high << np.uint64(self.shift) | self.low[i].astype("uint64")

    def find(self, values):
        """Index of each value, or -1."""
        import numpy as np

        if not self.size or not len(values):
            return np.full(len(values), -1, "i8")
        h = (values >> np.uint64(self.shift)).astype("i8")
        low = (values & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype)
        end = self._select(h, 0) - h
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - h + 1, 0)
        return within(self.low, start, end, low)


def within(sorted_, start, end, values):
    """Index of each value between start and end, where `sorted_` ascends, or -1."""
    import numpy as np

    lo, hi = start.astype("i8").copy(), end.astype("i8").copy()
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(sorted_) - 1)
        less = (lo < hi) & (sorted_[mid] < values)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    ok = (lo < end) & (sorted_[np.minimum(lo, len(sorted_) - 1)] == values) if len(sorted_) else lo < 0
    return np.where(ok, lo, -1)


def quantised(p):
    import numpy as np

    return np.clip(np.round(-np.log10(np.maximum(p, 1e-8)) * STEPS), 0, 255).astype("u1")


def trie_bytes(words, counts, owner, marks, pairs) -> bytes:
    """File of one range. `owner` is the place of a pair's first word in `words`."""
    import numpy as np

    share = (pairs - DISCOUNT) / counts[owner]
    left = 1 - np.bincount(owner, share, minlength=len(words))
    level, shift = EliasFano.encode(words, 1 << 64)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    points, pshift = EliasFano.encode(pointers, int(pointers[-1]) + 1)
    arrays = {f"w_{k}": v for k, v in level.items()} | {f"p_{k}": v for k, v in points.items()} | {
        "counts": counts.astype("<u8"), "left": quantised(left), "marks": marks.astype("<u4"), "share": quantised(share)}
    places, at = {}, 0
    for k, v in arrays.items():
        places[k] = (at, len(v), v.dtype.str)
        at += -(-v.nbytes // 8) * 8
    head = json.dumps({"words": len(words), "shift": shift, "pshift": pshift, "arrays": places}).encode()
    head += b" " * (-(len(head) + 12) % 8)
    body = b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())
    return b"EFT1" + struct.pack("<Q", len(head)) + head + body


class Trie:
    """One range file, mapped where it is local, else read."""

    def __init__(self, path: str):
        import numpy as np

        if "://" in path and not path.startswith("file:"):
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(path)
            data = np.frombuffer(system.open_input_file(base).read(), "u1")
        else:
            data = np.memmap(path.removeprefix("file://").removeprefix("file:"), "u1", "r")
        size = struct.unpack("<Q", data[4:12].tobytes())[0]
        head, base = json.loads(data[12:12 + size].tobytes()), 12 + size
        a = {k: data[base + at:base + at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in head["arrays"].items()}
        part = lambda p: {k[2:]: v for k, v in a.items() if k.startswith(p)}
        self.words = EliasFano(part("w_"), head["words"], head["shift"])
        self.points = EliasFano(part("p_"), head["words"] + 1, head["pshift"])
        self.counts, self.left, self.marks, self.share = a["counts"], a["left"], a["marks"], a["share"]


def _tokens(texts: list[str], lower: bool = True):
    """(hash of each token, index of its text): the words of each text, then its end."""
    import numpy as np

    h, doc = word_hashes(texts, lower)
    h = np.where(h < 8, h + np.uint64(8), h)
    n = len(texts)
    at = np.searchsorted(doc, np.arange(n), "right")
    return np.insert(h, at, np.uint64(END)), np.insert(doc, at, np.arange(n))


def _before(h, doc):
    import numpy as np

    prev = np.concatenate([np.full(1, START, "uint64"), h[:-1]])
    prev[np.concatenate([[True], doc[1:] != doc[:-1]])] = START
    return prev


def _spread(h):
    """Words in ranges of equal size; the marks of edges among them."""
    import numpy as np

    return np.where(h < 8, h * np.uint64(0x9E3779B97F4A7C15), h)


def _edges(buckets: int):
    import numpy as np

    return np.array([(b << 64) // buckets for b in range(buckets)], "uint64")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _count(buckets: int):
    """Blocks of documents to (bucket, words with counts, pairs of a word and a mark)."""

    def run(batches):
        import numpy as np
        import pandas as pd

        edges, held, size = _edges(buckets), [], 0

        def flush():
            h, prev = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            words, counts = np.unique(np.concatenate([h, prev[prev == _START_AT]]), return_counts=True)
            owner = np.searchsorted(words, prev).astype("u8")
            keys, pairs = np.unique(owner << np.uint64(32) | h >> np.uint64(32), return_counts=True)
            owner = (keys >> np.uint64(32)).astype("i8")
            w = np.append(np.searchsorted(words, edges), len(words))
            p = np.searchsorted(owner, w)
            return pd.DataFrame([
                (b, _zip(words[w[b]:w[b + 1]], counts[w[b]:w[b + 1]].astype("<u4"),
                         np.diff(owner[p[b]:p[b + 1]] - w[b], prepend=0).astype("<u4"),
                         (keys[p[b]:p[b + 1]] & np.uint64(0xFFFFFFFF)).astype("<u4"), pairs[p[b]:p[b + 1]].astype("<u4")))
                for b in range(buckets) if w[b + 1] > w[b]], columns=["bucket", "body"])

        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            h, doc = _tokens(texts)
            held.append((_spread(h), _spread(_before(h, doc))))
            size += len(h)
            if size >= BLOCK_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


_START_AT = START * 0x9E3779B97F4A7C15 % (1 << 64)
MANIFEST = "bucket int, file string, words long, tokens long, pairs long"


def _build(folder: str, min_pair: int):
    def run(pdf):
        import numpy as np
        import pandas as pd

        parts = [_unzip(b, "<u8", "<u4", "<u4", "<u4", "<u4") for b in pdf["body"]]
        words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype("u8")
        at, keys = 0, []
        for p in parts:
            keys.append(inverse[at:at + len(p[0])][np.cumsum(p[2], dtype="i8")].astype("u8") << np.uint64(32) | p[3])
            at += len(p[0])
        keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        pairs = np.bincount(inverse, np.concatenate([p[4] for p in parts]), minlength=len(keys))
        keys, pairs = keys[pairs >= min_pair], pairs[pairs >= min_pair]
        owner = (keys >> np.uint64(32)).astype("i8")
        bucket = int(pdf["bucket"].iloc[0])
        data = trie_bytes(words, counts, owner, keys & np.uint64(0xFFFFFFFF), pairs)
        real = words != _START_AT
        return pd.DataFrame([(bucket, store_file(folder, f"trie-{bucket:06d}", data), int(real.sum()),
                              int(counts[real].sum()), len(keys))], columns=["bucket", "file", "words", "tokens", "pairs"])

    return run


def build_model(docs: DataFrame, min_pair: int = MIN_PAIR, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, DataFrame]:
    """Trie files of all `docs` (doc_id, text). Returns their folder and the manifest of the
    files that count; a repeated task writes files of other names."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_path(spark, "trie")
    buckets = parts_for(text_bytes(docs), bucket_bytes)
    sent = docs.select("text").mapInPandas(_count(buckets), "bucket int, body binary")
    return folder, kept(sent.groupBy("bucket").applyInPandas(_build(folder, min_pair), MANIFEST), "manifest")


def _scores(folder: str, files: list, buckets: int, total: int, distinct: int):
    def run(batches):
        import numpy as np
        import pandas as pd

        edges, tries = _edges(buckets), {}
        floor = total + 0.1 * (distinct + 1)

        def trie(b):
            if b not in tries:
                tries[b] = Trie(f"{folder}/{files[b]}") if files[b] else None
            return tries[b]

        def by_range(sorted_, found):
            at = np.append(np.searchsorted(sorted_, edges), len(sorted_))
            for b in range(buckets):
                if at[b + 1] > at[b] and trie(b) is not None:
                    found(trie(b), slice(at[b], at[b + 1]))

        for pdf in batches:
            if not len(pdf):
                continue
            h, doc = _tokens([t or "" for t in pdf["text"]])
            prev, h = _spread(_before(h, doc)), _spread(h)
            words, inverse = np.unique(h, return_inverse=True)
            count = np.zeros(len(words), "f8")

            def counted(t, s):
                i = t.words.find(words[s])
                count[s] = np.where(i >= 0, t.counts[np.maximum(i, 0)], 0)

            by_range(words, counted)
            c = count[inverse]
            base = (c + 0.1) / floor
            # One search for each different pair, by context.
            contexts, ci = np.unique(prev, return_inverse=True)
            keys, ki = np.unique(ci.astype("u8") << np.uint64(32) | h >> np.uint64(32), return_inverse=True)
            owner = (keys >> np.uint64(32)).astype("i8")
            mark = (keys & np.uint64(0xFFFFFFFF)).astype("u4")
            left, share = np.ones(len(contexts)), np.zeros(len(keys))

            def searched(t, s):
                i = t.words.find(contexts[s])
                known = i >= 0
                i0 = np.maximum(i, 0)
                left[s] = np.where(known, 10.0 ** (t.left[i0] / -STEPS), 1.0)
                start, end = t.points.access(i0).astype("i8"), t.points.access(i0 + 1).astype("i8")
                a, b = np.searchsorted(owner, [s.start, s.stop])
                k = owner[a:b] - s.start
                at = within(t.marks, np.where(known[k], start[k], 0), np.where(known[k], end[k], 0), mark[a:b])
                if len(t.share):
                    share[a:b] = np.where(at >= 0, 10.0 ** (t.share[np.maximum(at, 0)] / -STEPS), 0.0)

            by_range(contexts, searched)
            p = share[ki] + left[ci] * base
            n = len(pdf)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, c > 0, minlength=n).astype("i8"),
                "train_tokens": total, "base_score": np.bincount(doc, np.log10(base), minlength=n),
                "score": np.bincount(doc, np.log10(p), minlength=n)})

    return run


def score_texts(docs: DataFrame, held: Column | None = None, min_pair: int = MIN_PAIR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    The model learns from the rows that are not held out: all counts of all their texts. A
    pair below `min_pair` backs off to the word. Null and empty texts are one end token.
    Rows without doc_id are training rows. Repeated rows count each. With nothing to learn
    from, every probability is the base. Other columns are not read.
    """
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    learn = rows.filter(~F.col("held_out"))
    folder, manifest = build_model(learn, min_pair)
    buckets = parts_for(text_bytes(learn), BUCKET_BYTES)
    # One row for each range file, of some millions of words.
    found = {r["bucket"]: r for r in manifest.toLocalIterator()}
    files = [found[b]["file"] if b in found else None for b in range(buckets)]
    total, distinct = sum(r["tokens"] for r in found.values()), sum(r["words"] for r in found.values())
    small_batches(spark)
    return rows.mapInPandas(
        _scores(folder, files, buckets, total, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
