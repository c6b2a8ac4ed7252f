"""Packing along a space-filling curve.

Each document becomes a hashed vector of few dimensions; its place on the Hilbert curve
is its key. Documents are range-sorted by that key, so neighbours on the curve share
sequences, and are cut every 4096 tokens. Only the end of each range is shorter: it is cut
into sequences whose lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import kept, parts_for, small_batches
from mailloom.llm.tokens import encoder

DIMS = 4
BITS = 15
PART_TOKENS = 4_000_000
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long,"
          " offset long")


def hilbert_keys(points, bits: int = BITS):
    """Place on the Hilbert curve of each row of whole-number coordinates in [0, 2**bits)."""
    import numpy as np

    x = [points[:, d].astype("int64") for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, the coarsest first
        low = q - 1
        for d in range(n):
            hit = (x[d] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0]) ^ swap
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, n):  # Gray code
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def projected(ids, starts, dims: int = DIMS):
    """Hashed vectors: the signed sums of each document's token ids, one sign for each
    (id, dimension) by a hash, scaled to length one."""
    import numpy as np

    top = int(ids.max()) + 1
    h = np.arange(top, dtype="uint64")[:, None] * np.uint64(dims) + np.arange(dims, dtype="uint64")
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    signs = ((h >> np.uint64(63)).astype("float32") * 2 - 1)
    sums = np.stack([np.add.reduceat(signs[ids, d], starts) for d in range(dims)], 1)
    norm = np.sqrt((sums.astype("float64") ** 2).sum(1, keepdims=True))
    return sums / np.where(norm == 0, 1, norm)


def tokenized(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, key, n_tokens, ids): ids of the whole text and the end id, as uint16 bytes."""
    small_batches(df.sparkSession)

    def run(batches):
        import numpy as np
        import pandas as pd

        enc = encoder(tokenizer, "word")
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            if not len(pdf):
                continue
            raw = [enc.ids(t or "") + end for t in pdf["text"]]
            sizes = np.array([len(r) // 4 for r in raw])
            ids = np.frombuffer(b"".join(raw), "<u4")
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            grid = ((projected(ids, starts) + 1) / 2 * (2**BITS - 1)).astype("int64")
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "key": hilbert_keys(grid),
                "n_tokens": sizes,
                "ids": [np.frombuffer(r, "<u4").astype("<u2").tobytes() for r in raw]})

    return df.select("doc_id", "text").mapInPandas(
        run, "doc_id long, key long, n_tokens long, ids binary")


def cut_lengths(total: int, length: int) -> list[int]:
    """Lengths of the sequences that hold `total` tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [
        1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2,
         part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence, with the piece's ids.

    Every id lies in one piece; offsets have no gaps. Null and empty texts hold the end id
    alone. Rows are packed as they are: repeated rows and equal ids are packed each, ordered
    by key, doc_id and text ids. An empty table gives no pieces. Other columns are not read.
    `length` is a power of two. A sequence is `length` long but for the ends of ranges, one
    for each `part_tokens`, which are cut at powers of two. The tokenizer's ids are below 65536.
    """
    spark = df.sparkSession
    tokens = kept(tokenized(df, tokenizer, end_id), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0]
    ranges = tokens.repartitionByRange(parts_for(total, part_tokens), "key", "doc_id")
    ranges = ranges.sortWithinPartitions("key", "doc_id", "ids").withColumn(
        "part", F.spark_partition_id())

    def run(batches):
        import numpy as np
        import pandas as pd

        held: list[tuple] = []  # pieces of the open sequence: doc, start, ids, doc_tokens
        fill, done = 0, 0

        def rows(pieces, sequence):
            offset = 0
            for doc, start, ids, size in pieces:
                yield doc, start, len(ids), ids.astype("<u4").tobytes(), size, sequence, offset
                offset += len(ids)

        def frame(out):
            got = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            return got.astype({"doc_id": "Int64"})

        part = 0
        for pdf in batches:
            out: list[tuple] = []
            for doc, ids, part in zip(pdf["doc_id"].tolist(), pdf["ids"], pdf["part"].tolist()):
                doc = None if doc is None or doc != doc else int(doc)
                ids, at = np.frombuffer(ids, "<u2"), 0
                while at < len(ids):
                    take = min(len(ids) - at, length - fill)
                    held.append((doc, at, ids[at:at + take], len(ids)))
                    at, fill = at + take, fill + take
                    if fill == length:
                        out += rows(held, (part << 32) + done)
                        held, fill, done = [], 0, done + 1
            if out:
                yield frame(out)
        out = []
        for room in cut_lengths(fill, length):  # the end of the range
            fits, later, left = [], [], room
            for doc, start, ids, size in held:
                if left:
                    fits.append((doc, start, ids[:left], size))
                if len(ids) > left:
                    later.append((doc, start + left, ids[left:], size))
                left = max(0, left - len(ids))
            out += rows(fits, (part << 32) + done)
            held, done = later, done + 1
        if out:
            yield frame(out)

    small_batches(spark)
    return ranges.select("doc_id", "ids", "part").mapInPandas(run, PIECES)

