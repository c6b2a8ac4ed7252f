"""Token shards as wavelet matrices: one compressed file for each shard of documents.

A wavelet matrix holds a sequence bit-plane by bit-plane, from the top bit on; each plane
lists the bits in the order that stable sorting by the planes above leaves, zeros first.
With counts of ones before each block, access, counting and search for occurrences need a
few words of each plane. File: magic, a length, a header in JSON, then zstd parts: document
ids, document lengths, and for each level the packed bits and the block counts.
"""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import DataFrame, Window, functions as F

from mailloom.llm.common import kept, parts_for, small_batches, store_file, text_bytes
from mailloom.llm.tokens import encoder
from mailloom.session import fresh_path

MAGIC = b"WVMX0001"
BLOCK = 512
SHARD_BYTES = 8_000_000
GROUP_CHARS = 6_000_000  # of the texts encoded at once


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of unsigned ids."""

    def __init__(self, planes, zeros: list[int], size: int):
        self.planes, self.zeros, self.size = planes, zeros, size
        self._counts = [None] * len(planes)

    @classmethod
    def build(cls, values) -> WaveletMatrix:
        import numpy as np

        v = np.asarray(values)
        levels = max(1, int(v.max()).bit_length()) if len(v) else 1
        v = v.astype("<u2" if levels <= 16 else "<u4")
        planes, zeros = [], []
        for bit in range(levels - 1, -1, -1):
            ones = (v & v.dtype.type(1 << bit)).astype(bool)
            at = np.flatnonzero(ones)
            planes.append(np.packbits(ones))
            zeros.append(len(v) - len(at))
            if bit:  # nothing stands below the last plane
                v = np.concatenate([v.take(np.flatnonzero(~ones)), v.take(at)])
        return cls(planes, zeros, len(v))

    def bits(self, level: int):
        import numpy as np

        return np.unpackbits(self.planes[level], count=self.size).view(bool)

    def decode(self):
        """All ids in order."""
        import numpy as np

        v = np.zeros(self.size, "<u2" if len(self.planes) <= 16 else "<u4")
        for k in range(len(self.planes)):  # from the lowest plane up
            level = len(self.planes) - 1 - k
            ones, out, z = self.bits(level), np.empty_like(v), self.zeros[level]
            out[np.flatnonzero(~ones)] = v[:z]
            out[np.flatnonzero(ones)] = v[z:] | v.dtype.type(1 << k)
            v = out
        return v

    def counts(self, level: int):
        """Ones before each block of BLOCK bits."""
        import numpy as np

        if self._counts[level] is None:
            p = self.planes[level]
            step = BLOCK // 8
            padded = np.zeros(-(-max(1, len(p)) // step) * step, "u1")
            padded[:len(p)] = p
            ones = np.bitwise_count(padded).reshape(-1, step).sum(1)
            self._counts[level] = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        return self._counts[level]

    def _ones(self, level: int, i: int) -> int:
        import numpy as np

        block, p = i // BLOCK, self.planes[level]
        n = int(self.counts(level)[block])
        part = np.unpackbits(p[block * BLOCK // 8:i // 8 + 1])[:i - block * BLOCK]
        return n + int(part.sum())

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            i = z + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of `value` among the first i ids."""
        return self._interval(value, i)[1] - self._interval(value, i)[0]

    def _interval(self, value: int, i: int) -> tuple[int, int]:
        lo, hi, levels = 0, i, len(self.planes)
        if value >> levels:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (levels - 1 - level) & 1:
                lo, hi = z + a, z + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _select_bit(self, level: int, bit: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        import numpy as np

        c = self.counts(level)
        before = c if bit else np.arange(len(c)) * BLOCK - c
        block = int(np.searchsorted(before, k, "right")) - 1
        p = self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8]
        found = np.flatnonzero(np.unpackbits(p).view(bool) == bit)
        return block * BLOCK + int(found[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of `value`, from 0."""
        lo, hi = self._interval(value, self.size)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            z = self.zeros[level]
            i = self._select_bit(level, True, i - z) if i >= z else self._select_bit(level, False, i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def write_shard(ids, doc_ids: list, lengths) -> bytes:
    """The bytes of a shard file."""
    import numpy as np
    import zstandard

    w = WaveletMatrix.build(ids)
    null = np.array([d is None for d in doc_ids], "u1")
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [docs.tobytes(), null.tobytes(), np.asarray(lengths, "<i8").tobytes()]
    for level, plane in enumerate(w.planes):
        parts += [plane.tobytes(), w.counts(level).tobytes()]
    packed = [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]
    head = json.dumps({"tokens": w.size, "docs": len(doc_ids), "zeros": w.zeros, "block": BLOCK,
                       "parts": [len(p) for p in packed],
                       "crc32": [zlib.crc32(p) for p in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


def read_shard(content: bytes):
    """(wavelet matrix, document ids, document lengths); ValueError on a damaged file."""
    import numpy as np
    import zstandard

    if content[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = struct.unpack_from("<I", content, 8)[0]
    head, at, parts = json.loads(content[12:12 + size]), 12 + size, []
    for n, crc in zip(head["parts"], head["crc32"]):
        part = content[at:at + n]
        if len(part) != n or zlib.crc32(part) != crc:
            raise ValueError("damaged wavelet shard")
        parts.append(zstandard.ZstdDecompressor().decompress(part))
        at += n
    docs, null, lengths = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "u1", "<i8")))
    w = WaveletMatrix([np.frombuffer(p, "u1") for p in parts[3::2]], head["zeros"], head["tokens"])
    w._counts = [np.frombuffer(p, "<i8") for p in parts[4::2]]
    return w, [None if x else int(d) for d, x in zip(docs, null)], lengths


def write_tokens(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2,
                 shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Write `df` (doc_id, text) as shard files in ascending doc_id order.

    Returns the folder and the manifest (part, seq, file, n_tokens, n_docs, first_token): the
    files that count, in order. A task that is repeated writes files of other names, so a
    lost executor leaves no half-written file among them. Null and empty texts hold the end
    id alone; rows with equal doc_id are neighbours, by text; null doc_ids come first. An
    empty table has an empty manifest.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    small_batches(spark)
    docs = df.select("doc_id", "text")
    shards = docs.repartitionByRange(
        parts_for(text_bytes(docs), shard_bytes), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import numpy as np
        import pandas as pd

        enc = encoder(tokenizer, "byte")
        raw, docs, lengths, size, part, seq = [], [], [], 0, 0, 0
        texts, chars = [], 0

        def encode():
            nonlocal texts, chars, size
            ids, sizes = enc.all_ids(texts)
            raw.append(np.insert(ids, np.cumsum(sizes), end_id))
            lengths.extend((sizes + 1).tolist())
            size += raw[-1].nbytes
            texts, chars = [], 0

        def flush():
            ids = np.concatenate(raw)
            name = store_file(folder, f"shard-{part:06d}-{seq:04d}", write_shard(ids, docs, lengths))
            return pd.DataFrame({"part": [part], "seq": [seq], "file": [name],
                                 "n_tokens": [len(ids)], "n_docs": [len(docs)]})

        for pdf in batches:
            for doc, text, part in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["part"].tolist()):
                docs.append(None if doc is None or doc != doc else int(doc))
                texts.append(text or "")
                chars += len(texts[-1]) + 16  # empty ones are not free
                if chars >= GROUP_CHARS:
                    encode()
                if size >= 4 * shard_bytes:  # a range far larger than the mean
                    yield flush()
                    raw, docs, lengths, size, seq = [], [], [], 0, seq + 1
        if texts:
            encode()
        if docs:
            yield flush()

    manifest = kept(shards.withColumn("part", F.spark_partition_id()).mapInPandas(
        run, "part int, seq int, file string, n_tokens long, n_docs long"), "manifest")
    # One row for each shard file: a running sum over these stays small.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long")
    return folder, manifest.withColumn("first_token", first)


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the shard files, ids as uint32 bytes."""
    spark = manifest.sparkSession
    rows = "file string, doc_id long, local long, n_tokens long, ids binary"

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                w, docs, lengths = read_shard(content)
                ids, ends = w.decode().astype("<u4"), np.cumsum(lengths)
                starts = ends - lengths
                for i in range(0, len(docs), 500):
                    yield pd.DataFrame({
                        "file": path.rsplit("/", 1)[-1],
                        "doc_id": pd.array(docs[i:i + 500], "Int64"), "local": starts[i:i + 500],
                        "n_tokens": lengths[i:i + 500],
                        "ids": [ids[a:b].tobytes() for a, b in
                                zip(starts[i:i + 500], ends[i:i + 500])]})

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = files.mapInPandas(run, rows)
    # The manifest names the files that count and where each starts.
    return found.join(manifest.select("file", "first_token"), "file").select(
        "doc_id", (F.col("first_token") + F.col("local")).alias("start"), "n_tokens", "ids")
