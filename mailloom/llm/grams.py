"""Word windows of whole texts as 64-bit hashes, and which of them other documents share.

Windows are not rows: a task sorts the hashes of a block of documents and sends one packed
list to each bucket of hashes, about seven bytes a window. A bucket is a bounded part of
all windows, as buckets grow in number with the input. It finds the hashes of more than
one document and answers each block with the places of these, so a block learns which
windows of its documents are shared, by how many rows, and what the smallest doc_id is.
A window that a third of all documents hold costs its bucket three bytes for each.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import parts_for, small_batches, text_bytes

BLOCK_WINDOWS = 2_000_000
BUCKET_BYTES = 14_000_000  # of text; about two million windows
HASH_BITS = 56

_P = 0x9E3779B97F4A7C15
_TABLES: dict = {}


def _tables(size: int):
    """Powers of an odd number and of its inverse modulo 2**64, random values of bytes."""
    import numpy as np

    if size > len(_TABLES.get("power", ())):
        n = max(size, 1 << 16) * 5 // 4
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("power", _P), ("inverse", inverse)):
            p = np.full(n, base, "uint64")
            p[0] = 1
            _TABLES[name] = np.multiply.accumulate(p)
        _TABLES["value"] = np.random.default_rng(7).integers(1, 2**63, 256, "uint64")
    return _TABLES["power"], _TABLES["inverse"], _TABLES["value"]


def mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str], lower: bool):
    """(hash of each word, index of its text) over all texts; words lie between ASCII blanks."""
    import numpy as np

    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", "u1")
    ends = np.cumsum([len(r) + 1 for r in raw])
    power, inverse, value = _tables(len(data) + 1)
    kind = np.arange(256)
    blank = (kind == 32) | ((kind >= 9) & (kind <= 13))
    value = np.where(blank, 0, value).astype("uint64")
    if lower:
        value[65:91] = value[97:123]
    edge = np.diff(np.concatenate([[1], blank[data].view("i1"), [1]]))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(value[data] * power[:len(data)])])
    h = (sums[stops] - sums[starts]) * inverse[starts]
    h = mix(h + (stops - starts).astype("uint64") * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(ends, starts, "right")


def windows(hashes, width: int):
    """Hash of each run of `width` words."""
    import numpy as np

    n = max(0, len(hashes) - width + 1)
    h = np.zeros(n, "uint64")
    for k in range(width):
        h = h * np.uint64(0xFF51AFD7ED558CCD) + hashes[k:k + n]
    return mix(h)


def text_windows(texts: list[str], width: int, lower: bool, distinct: bool):
    """(hash, text index, words of each text): windows in order, or the distinct ones sorted.

    With `distinct`, a text of fewer words, but not none, is one window.
    """
    import numpy as np

    h, doc = word_hashes(texts, lower)
    n_words = np.bincount(doc, minlength=len(texts))
    w = windows(h, width)
    own = doc[:len(w)]
    whole = own == doc[width - 1:] if len(w) else np.zeros(0, bool)
    w, own = w[whole], own[whole]
    if distinct:
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        at = np.concatenate([[0], np.cumsum(n_words)])
        few = np.array([windows(h[at[i]:at[i + 1]], int(n_words[i]))[0] for i in short], "uint64")
        w, own = np.concatenate([w, few]), np.concatenate([own, short])
        order = np.lexsort((w, own))
        w, own = w[order], own[order]
        if len(w):
            first = np.concatenate([[True], (w[1:] != w[:-1]) | (own[1:] != own[:-1])])
            w, own = w[first], own[first]
    return w, own, n_words


def _zip(*arrays) -> bytes:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    parts = [c.compress(a.tobytes()) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unzip(body: bytes, *types: str):
    import numpy as np
    import zstandard

    d, at, out = zstandard.ZstdDecompressor(), 4 * len(types), []
    for n, t in zip(struct.unpack_from(f"<{len(types)}I", body), types):
        out.append(np.frombuffer(d.decompress(body[at:at + n]), t))
        at += n
    return out


def _put(hashes, index, docs, sizes) -> bytes:
    """A block's sorted hashes of one bucket, their places, and the block's documents."""
    import numpy as np

    step = np.diff(hashes, prepend=np.uint64(0))
    low, high = (step & np.uint64(0xFFFFFFFF)).astype("<u4"), (step >> np.uint64(32)).astype("<u4")
    top = int(index.max(initial=0))
    if top >= 1 << 32:
        raise ValueError(f"a block of more than {1 << 32} windows")
    size = 3 if top < 1 << 24 else 4
    place = index.astype("<u4").view("u1").reshape(-1, 4)[:, :size]
    tail = _zip(high, np.diff(docs, prepend=0), sizes.astype("<u4"))
    return struct.pack("<II", len(hashes), size) + low.tobytes() + place.tobytes() + tail


def _get(body: bytes):
    import numpy as np

    n, size = struct.unpack_from("<II", body)
    low = np.frombuffer(body, "<u4", n, 8).astype("uint64")
    place = np.zeros((n, 4), "u1")
    place[:, :size] = np.frombuffer(body, "u1", size * n, 8 + 4 * n).reshape(n, size)
    high, docs, sizes = _unzip(body[8 + (4 + size) * n:], "<u4", "<i8", "<u4")
    hashes = np.cumsum(low | high.astype("uint64") << np.uint64(32), dtype="uint64")
    return hashes, place.view("<u4").ravel(), np.cumsum(docs), np.cumsum(sizes)


def _blocks(width: int, lower: bool, distinct: bool, buckets: int):
    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = 0

        def flush():
            block = (task << 24) + seq
            hashes, ids, keys = (np.concatenate([x[i] for x in held]) for i in range(3))
            sizes, n_words = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            sums = [np.concatenate([x[i] for x in held]) for i in (5, 6)]
            h = hashes >> np.uint64(64 - HASH_BITS)
            order = np.argsort(h, kind="stable")
            h = h[order]
            edges = np.searchsorted(
                h, (np.arange(buckets + 1, dtype="float64") / buckets * 2.0**HASH_BITS).astype("uint64"))
            out = [(i, block, 1, _put(h[a:b], order[a:b], ids, sizes))
                   for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            table = _zip(ids, keys, sizes.astype("<i8"), n_words.astype("<i8"), *sums)
            out.append((block % buckets, block, 0, table))
            return pd.DataFrame(out, columns=["bucket", "block", "kind", "body"])

        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for i in range(0, len(texts), 250):
                part = texts[i:i + 250]
                w, own, n_words = text_windows(part, width, lower, distinct)
                sizes = np.bincount(own, minlength=len(part))
                # Sums over a set of hashes that no order changes: the set's signature.
                sums = [np.bincount(own, minlength=len(part)).astype("uint64") for _ in (0, 1)]
                if distinct and len(w):
                    full = sizes > 0
                    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
                    for s, salt in zip(sums, (1, 2)):
                        s[full] = np.add.reduceat(mix(w * np.uint64(2 * salt + 1)), at)
                held.append((w, pdf["doc_id"].to_numpy("int64")[i:i + 250],
                             pdf["text_key"].to_numpy("int64")[i:i + 250], sizes, n_words,
                             sums[0].view("<i8"), sums[1].view("<i8")))
                count += len(w)
                if count >= BLOCK_WINDOWS:
                    yield flush()
                    held, count, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


def _answer(pdf, lows: bool):
    """One bucket: the hashes of more than one doc_id, told to the blocks that hold them.

    Without `lows` the smallest doc_id is left at 0.
    """
    import numpy as np
    import pandas as pd

    tables = pdf[pdf["kind"] == 0][["block", "kind", "body"]]
    lists = pdf[pdf["kind"] == 1]
    got, blocks = [_get(b) for b in lists["body"]], lists["block"].tolist()
    if not got:
        return tables
    hashes = np.concatenate([g[0] for g in got])
    docs = np.concatenate([g[2][np.searchsorted(g[3], g[1], "right")] for g in got])
    source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    place = np.concatenate([g[1] for g in got])
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    shared = np.repeat(low != high, sizes)
    rows = order[shared]
    low, sizes = np.repeat(low if lows else low * 0, sizes)[shared], np.repeat(sizes, sizes)[shared]
    by = np.argsort(source[rows], kind="stable")
    rows, low, sizes = rows[by], low[by], sizes[by]
    edges = np.searchsorted(source[rows], np.arange(len(got) + 1))
    out = [(blocks[i], 1, _zip(place[rows[a:b]], low[a:b], sizes[a:b].astype("<i8"),
                            np.diff(hashes[rows[a:b]], prepend=np.uint64(0))))
           for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    return pd.concat([tables, pd.DataFrame(out, columns=["block", "kind", "body"])])


def block_windows(pdf):
    """The answers to one block: (ids, keys, sizes, n_words, sums a and b, and of the shared
    windows in order the place, smallest doc_id, rows, hash)."""
    import numpy as np

    table = _unzip(pdf[pdf["kind"] == 0]["body"].iloc[0], *["<i8"] * 6)
    parts = [_unzip(b, "<u4", "<i8", "<i8", "<u8") for b in pdf[pdf["kind"] == 1]["body"]]
    if not parts:
        return (*table, *(np.zeros(0, t) for t in ("<u4", "<i8", "<i8", "<u8")))
    place, low, rows = (np.concatenate([p[i] for p in parts]) for i in range(3))
    hashes = np.concatenate([np.cumsum(p[3], dtype="uint64") for p in parts])  # sent as steps
    order = np.argsort(place, kind="stable")
    return (*table, place[order], low[order], rows[order], hashes[order])


def shared_windows(df: DataFrame, width: int, lower: bool, distinct: bool, per_block, schema: str,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`per_block(pdf) -> pdf` over every block of `df` (doc_id, text), read by block_windows.

    Rows without doc_id are left out. A row is known by doc_id and text_key, the hash of
    its text, so repeated rows get equal answers.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select("doc_id", "text", F.xxhash64("text").alias("text_key")).filter("doc_id IS NOT NULL")
    buckets = parts_for(text_bytes(docs), bucket_bytes)
    sent = docs.mapInPandas(_blocks(width, lower, distinct, buckets),
                            "bucket int, block long, kind int, body binary")
    lows = not distinct  # a set has no use for them

    def answer(pdf):
        return _answer(pdf, lows)

    told = sent.groupBy("bucket").applyInPandas(answer, "block long, kind int, body binary")
    return told.groupBy("block").applyInPandas(per_block, schema)
