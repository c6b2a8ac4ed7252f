"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailloom.llm.common import kept

HELD_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or, with itself, its smaller) neighbours to the smallest.

    The smallest neighbour is found by combining in the map tasks; the join that follows
    is a plain one, whose skewed side Spark splits.
    """
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges  # a > b
    low = near.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    pairs = near.join(low, "a")
    if large:
        found = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        found = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b")))
    return found.filter("a <> b").distinct()


def _forests(batches):
    """Edges of each run of batches as stars around the smallest nodes they reach within it."""
    import numpy as np
    import pandas as pd

    def stars(held):
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[:len(a)], at[len(a):]
        root = np.arange(len(nodes))
        while (root[x] != root[y]).any():
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        hung = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[hung], "b": nodes[root[hung]]})

    held, size = [], 0
    for pdf in batches:
        held.append((pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64")))
        size += len(pdf)
        if size >= HELD_EDGES:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def _hangs(edges: DataFrame) -> bool:
    """Whether each node hangs on one label and no label on another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return per.filter("up > 1 OR (up > 0 AND n > up)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach, for each node of an edge.

    Tasks first turn what edges they hold into stars; then large stars and small stars in
    turn, until every node hangs on its label. Each round is written to the shared folder,
    and its edges are no more than those of the round before.
    """
    plain = edges.select("a", "b").filter("a <> b")
    now = kept(plain.mapInPandas(_forests, "a long, b long").distinct(), "edges")
    while not _hangs(now):
        now = kept(_star(_star(now, True), False), "edges")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)
