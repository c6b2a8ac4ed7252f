"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word shingles overlap in `percent` hundredths of the
union or more, so each holds T = ceil(percent / 100 * n) shingles of the other. A document
with fewer than T shared shingles has no link. Of the others, one for each set goes on;
two that link share a shingle among the n - T + 1 rarest of each, so documents meet in
groups that such shingles connect. Within a group inverted lists are searched by
DivideSkip: the short lists are merged and counted, the long ones are probed by binary
search for documents that can still reach T.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import kept
from mailloom.llm.components import components
from mailloom.llm.grams import HASH_BITS, block_windows, shared_windows

WIDTH = 5
PERCENT = 80
GROUP_DOCS = 6000
SETS = "doc_id long, n_shingles long, sum_a long, sum_b long, shared binary, prefix array<long>"


def pack(hashes) -> bytes:
    """Hashes of HASH_BITS in as many bytes as they need."""
    return hashes.astype("<u8").view("u1").reshape(-1, 8)[:, :HASH_BITS // 8].tobytes()


def unpack(body: bytes):
    import numpy as np

    out = np.zeros((len(body) * 8 // HASH_BITS, 8), "u1")
    out[:, :HASH_BITS // 8] = np.frombuffer(body, "u1").reshape(len(out), -1)
    return out.view("<u8").ravel()


def _sets(percent: int):
    def per_block(pdf):
        import numpy as np
        import pandas as pd

        ids, _, sizes, _, sum_a, sum_b, place, _, rows, hashes = block_windows(pdf)
        owner = np.searchsorted(np.cumsum(sizes), place, "right")
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = []
        for i, (doc, n) in enumerate(zip(ids.tolist(), sizes.tolist())):
            a, b = edges[i], edges[i + 1]
            least = -(-percent * n // 100)
            shared, prefix = None, None
            if n and b - a >= least:
                h = hashes[a:b]
                h = h[np.lexsort((h, rows[a:b]))]  # rarest first; windows of one row come before
                head = (n - least + 1) - (n - len(h))
                if head > 0:
                    shared, prefix = pack(h), h[:head].astype("<i8")
            out.append((doc, n, int(sum_a[i]), int(sum_b[i]), shared, prefix))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SETS.split(", ")])

    return per_block


def search_group(ids, sizes, sets, percent: int) -> list[tuple]:
    """What links in a group: (first, other) index pairs, the first of each component by id
    with each other document of it.

    `sets` are arrays of shared shingles, `sizes` the sizes of the whole sets. A pair is
    checked unless earlier links connect it already.
    """
    import numpy as np

    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    n = np.array([sizes[i] for i in order])
    lengths = [len(sets[i]) for i in order]
    _, terms = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    docs = np.repeat(np.arange(len(order)), lengths)
    by = np.argsort(terms, kind="stable")  # within a list, documents ascend
    posting = docs[by]
    at = np.searchsorted(terms[by], np.arange(int(terms.max()) + 2))
    own = np.split(terms, np.cumsum(lengths)[:-1])
    root = np.arange(len(order))
    for q in range(1, len(order)):
        least = -(-percent * int(n[q]) // 100)
        lists = [posting[at[t]:at[t + 1]] for t in own[q].tolist()]
        first = int(np.searchsorted(n, -(-percent * int(n[q]) // 100)))  # smaller sets cannot link
        lists = [x[np.searchsorted(x, first):np.searchsorted(x, q)] for x in lists]
        lists = sorted((x for x in lists if len(x)), key=len)
        if len(lists) < least:
            continue
        longest = max(2, len(lists[-1]))
        skipped = min(least - 1, int(least / (0.01 * math.log2(longest) + 1)))
        short, long_ = lists[:len(lists) - skipped], lists[len(lists) - skipped:]
        merged = np.sort(np.concatenate(short), kind="stable")  # merges the sorted runs
        found, counts = np.unique(merged, return_counts=True)
        hit = counts >= least - skipped
        found, counts = found[hit], counts[hit]
        while len(found):
            new = root[found] != root[q]
            found, counts = found[new], counts[new]
            if not len(found):
                break
            d, c = int(found[-1]), int(counts[-1])
            found, counts = found[:-1], counts[:-1]
            need = -(-percent * int(n[q] + n[d]) // (100 + percent))
            for left, x in zip(range(len(long_), 0, -1), long_):
                if c + left < need:
                    break
                i = int(np.searchsorted(x, d))
                c += i < len(x) and int(x[i]) == d
            if c >= need:
                low, high = sorted((int(root[d]), int(root[q])))
                root[root == high] = low
    firsts: dict[int, int] = {}
    for i, r in enumerate(root.tolist()):
        if r not in firsts or ids[order[i]] < ids[firsts[r]]:
            firsts[r] = order[i]
    return [(firsts[r], order[i]) for i, r in enumerate(root.tolist()) if firsts[r] != order[i]]


def _search(percent: int):
    def run(pdf):
        import pandas as pd

        out = []
        for _, g in pdf.groupby(["label", "i", "j"], sort=False):
            ids = g["doc_id"].tolist()
            sets = [unpack(b) for b in g["shared"]]
            out += [(ids[a], ids[b]) for a, b in search_group(ids, g["n_shingles"].tolist(), sets, percent)]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def jaccard_components(df: DataFrame, percent: int = PERCENT, width: int = WIDTH,
                       group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `df` (doc_id, text).

    Null and empty texts have no shingles and link with nothing; a text of fewer words
    than `width` is one shingle. Rows of one doc_id are one node. A row without doc_id has
    no component. Groups of more than `group_docs` different sets are searched in pairs
    of blocks, so no task holds more than two blocks. Other columns are not read.
    """
    spark = df.sparkSession
    sets = kept(shared_windows(df, width, True, True, _sets(percent), SETS), "sets")
    key = ["n_shingles", "sum_a", "sum_b"]
    alike = sets.filter("n_shingles > 0").groupBy(*key).agg(
        F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    nodes = kept(sets.drop("shared", "prefix").join(alike, key, "left").select(
        "doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")), "nodes")
    firsts = nodes.filter("doc_id = first").select("doc_id").distinct()
    rare = kept(sets.filter("prefix IS NOT NULL").select("doc_id", "prefix").join(
        firsts, "doc_id", "left_semi"), "rare")

    # One edge from each document of a rare shingle's list to the first of the list.
    heads = rare.select("doc_id", F.explode("prefix").alias("shingle"))
    hubs = heads.groupBy("shingle").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
    meet = heads.join(hubs.filter("hub <> last"), "shingle")
    groups = components(meet.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))

    large = kept(groups.groupBy("label").agg(F.count("*").alias("members")).filter(
        F.col("members") > group_docs), "large")
    placed = groups.join(large, "label", "left").select(
        F.col("node").alias("doc_id"), "label",
        F.coalesce(F.ceil(F.col("members") / group_docs), F.lit(1)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).select("doc_id", "label", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("p"))
    # Written, so that Spark knows its size: a small one is broadcast and no set moves twice.
    placed = kept(placed, "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    tasks = sets.filter("shared IS NOT NULL").select("doc_id", "n_shingles", "shared").join(placed, "doc_id").select(
        "doc_id", "n_shingles", "shared", "label", "p.i", "p.j").withColumn(
        "bucket", F.pmod(F.xxhash64("label", "i", "j"), F.lit(parts)))
    links = kept(tasks.groupBy("bucket").applyInPandas(_search(percent), "a long, b long"), "links")

    twice = nodes.groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    if large.isEmpty() and twice.filter("low <> high").isEmpty():
        # Every group was searched at once: its links lead to the first of a component.
        found = links.select(F.col("b").alias("first"), F.col("a").alias("label"))
    else:
        same = nodes.filter("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
        found = components(links.union(same)).withColumnRenamed("node", "first")
    # A set is that of its first document; so is its component.
    named = nodes.join(found, "first", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "first").alias("component_id"))
    none = F.lit(None).cast("long")
    return named.union(df.filter("doc_id IS NULL").select("doc_id", none, none))


def keep_first(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `df` with one document of each component: the smallest doc_id, once.

    Different texts under one doc_id all stay, rows that repeat id and text count once, and
    rows without doc_id stay.
    """
    firsts = jaccard_components(df, percent).filter("doc_id = component_id").select("doc_id").distinct()
    named = df.filter("doc_id IS NOT NULL").join(firsts, "doc_id", "left_semi").select(*df.columns)
    return named.dropDuplicates(["doc_id", "text"]).union(df.filter("doc_id IS NULL"))
