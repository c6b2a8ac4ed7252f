"""Hard negatives of anchors by threshold joins over an inverted index.

Vectors become integers (floor of `scale` times a component), and a score is an integer
inner product, so all arithmetic is exact. Rows are dealt to blocks and anchors to chunks;
each pair of them is one task-sized group, so neither a label nor the anchors gather.

In a group the join follows L2AP. Components come in order of growing energy. Of each row
the leading components stay out of the index as long as the norms of these parts say that
they alone cannot reach any threshold; a row that is out wholly is never met. The index
holds, for each step of components from the last to the first, the rows that reach so far.
Partial scores are accumulated along it, and rows whose partial score and remaining norm
reach no threshold leave. Candidates are then finished with their omitted part.

Thresholds start high and are lowered for those windows that are not full: for positives
in the group, for negatives over all groups (LEVELS, percent of the positive's score).
A window that is full at one level is final, since all lower scores come later.

Rows with a null vec_id, label or vector, or a null or non-finite component take no part,
nor do empty vectors; rows of other length never meet. Rows that share a vec_id are rows of
their own. Integers beyond 64 bits, as components or as scores, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailloom.llm.common import kept

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # a negative's score in percent of the positive's
LEVELS = (75, 50, LEAST)
BLOCK, CHUNK = 4_096, 1_024  # rows and anchors of one group, on average
STEP = 8  # components that the index takes at once

ROW = "row long, vec_id long, label long, size int, vector binary"
SCORED = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
MINED = "slot int, " + SCORED + ", negative long, negative_id long, negative_score long"


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, numbered, with their integers as bytes (32 bits where they fit)."""
    finite = F.forall(F.transform("embedding", lambda x: x.cast("double")),
                      lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
             & (F.size("embedding") > 0))
    rows = vectors.filter(F.coalesce(given & finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(v):
            whole = np.floor(np.asarray(v, "f8") * scale)
            most = np.abs(whole).max()
            if not most < 2.0 ** 63:
                raise ValueError("a component is beyond 64 bits")
            return whole.astype("<i4" if most < 2.0 ** 31 else "<i8").tobytes()

        for pdf in batches:
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"], "label": pdf["label"], "size": [len(v) for v in pdf["embedding"]],
                "vector": [packed(v) for v in pdf["embedding"]],
            })

    whole = rows.mapInPandas(run, "vec_id long, label long, size int, vector binary")
    return whole.withColumn("row", F.monotonically_increasing_id())


def _matrix(vectors, size: int) -> np.ndarray:
    rows = [np.frombuffer(v, "<i4" if len(v) == 4 * size else "<i8") for v in vectors]
    return np.stack(rows).astype("i8") if rows else np.zeros((0, size), "i8")


def _exact(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose products and sums are exact: doubles up to 2**53, else Python integers."""
    top = [int(max(m.max(initial=0), -int(m.min(initial=0)))) for m in (a, x)]
    kind = "f8" if top[0] * top[1] * max(a.shape[1], 1) < 2 ** 53 else object
    return a.astype(kind), x.astype(kind)


class Index:
    """Inverted index of some rows for anchors with a threshold each."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort((rows.astype("f8") ** 2).sum(axis=0), kind="stable")
        self.a, self.x = _exact(anchors[:, order], rows[:, order])
        self.steps = [*range(0, rows.shape[1], STEP), rows.shape[1]]
        # Norms of the leading parts, rounded up.
        self.a_norm, self.x_norm = (self._leading(m) for m in (self.a, self.x))

    def _leading(self, m: np.ndarray) -> np.ndarray:
        squares = np.cumsum(m.astype("f8") ** 2, axis=1)
        norms = np.sqrt(squares) * (1 + 1e-9)
        return np.concatenate([np.zeros((len(m), 1)), norms[:, [s - 1 for s in self.steps[1:]]]], axis=1)

    def above(self, who: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `who`, row, score) of all scores of at least `least`, one threshold an anchor."""
        a, a_norm, last = self.a[who], self.a_norm[who], len(self.steps) - 1
        least = least - np.abs(least) * 1e-12  # a double may lie above the integer it stands for
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(least[:, None] > 0, a_norm / np.maximum(least, 1e-300)[:, None], np.inf)
        share[:, 0] = 0
        # Leading steps that stay out: together they reach no threshold.
        with np.errstate(invalid="ignore"):
            out = self.x_norm * share.max(axis=0, initial=0) < 1
        cut = np.where(out.all(axis=1), last, out.argmin(axis=1) - 1)
        rows = np.argsort(cut, kind="stable")
        rows = rows[cut[rows] < last]
        acc = np.zeros((len(who), len(rows)), a.dtype)
        for step in range(last - 1, -1, -1):
            n = np.searchsorted(cut[rows], step, side="right")  # rows that the index holds here
            if not n:
                break
            part = slice(self.steps[step], self.steps[step + 1])
            acc[:, :n] += a[:, part] @ self.x[rows[:n], part].T
            if step % 2 == 0:  # what is left of a row: its omitted part, or what comes yet
                rest = np.maximum(cut[rows], step)
                alive = acc + a_norm[:, rest] * self.x_norm[rows, rest] >= least[:, None]
                some = alive.any(axis=0)
                rows, acc = rows[some], acc[:, some]
        rest = cut[rows]
        near, at = np.nonzero(acc + a_norm[:, rest] * self.x_norm[rows, rest] >= least[:, None])
        score = acc[near, at]
        for step in np.unique(rest):
            if step:
                of = np.flatnonzero(rest[at] == step)
                lead = slice(0, self.steps[step])
                for some in np.array_split(of, -(-len(of) // 65_536) or 1):
                    score[some] += (a[near[some], lead] * self.x[rows[at[some]], lead]).sum(axis=1)
        found = score >= least[near]
        return near[found], rows[at[found]], score[found]


def _ranked(near, at, score, ids):
    """In order of anchor, score downwards and vec_id. Scores leave the wide type here, without those
    of a row with itself, which may be beyond it."""
    score = score.astype("i8")
    order = np.lexsort((ids[at], -score, near))
    return near[order], at[order], score[order]


def _first(near: np.ndarray, n: int) -> np.ndarray:
    """The first n of each anchor in ranked pairs."""
    starts = np.searchsorted(near, near, side="left")
    return np.arange(len(near)) - starts < n


def _positives(n: int):
    """The first n other rows of equal label that this group has for each of its anchors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["size"].iloc[0])
        parts = []
        for _, same in pdf.groupby("label"):
            asked = same["asked"].to_numpy()
            anchors, rows = same[asked], same[~asked]
            if not len(anchors) or not len(rows):
                continue
            index = Index(_matrix(list(anchors["vector"]), size), _matrix(list(rows["vector"]), size))
            ids, own = rows["vec_id"].to_numpy("i8"), rows["row"].to_numpy("i8")
            of, of_id = anchors["row"].to_numpy("i8"), anchors["vec_id"].to_numpy("i8")
            open_ = np.arange(len(anchors))
            top = index.a_norm[:, -1] * index.x_norm[:, -1].max()
            for share in (0.5, 0.25, 0.125, None):  # lowered until the window is full, or all rows are seen
                least = top[open_] * share if share else np.full(len(open_), -np.inf)
                near, at, score = index.above(open_, least)
                other = own[at] != of[open_[near]]
                near, at, score = _ranked(near[other], at[other], score[other], ids)
                full = np.bincount(near, minlength=len(open_)) >= n
                done = (full if share else np.ones(len(open_), bool))[near] & _first(near, n)
                who = open_[near[done]]
                parts.append(pd.DataFrame({
                    "anchor": of[who], "anchor_id": of_id[who], "positive": own[at[done]],
                    "positive_id": ids[at[done]], "positive_score": score[done]}))
                open_ = open_[~full]
                if not len(open_):
                    break
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])

    return run


def _negatives(n: int, level: int, least: int, most: int):
    """The first n rows of another label for each window of each anchor, down to `level` percent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["size"].iloc[0])
        asked = pdf["asked"].to_numpy()
        anchors, rows = pdf[asked], pdf[~asked]
        names = [c.split()[0] for c in MINED.split(", ")]
        if not len(anchors) or not len(rows):
            return pd.DataFrame(columns=names)
        index = Index(_matrix(list(anchors["vector"]), size), _matrix(list(rows["vector"]), size))
        ids, own = rows["vec_id"].to_numpy("i8"), rows["row"].to_numpy("i8")
        labels, of_label = rows["label"].to_numpy("i8"), anchors["label"].to_numpy("i8")
        windows = [sorted(w, key=lambda x: x["slot"]) for w in anchors["windows"]]
        least_of = np.array([min(-(-max(level, least) * w["positive_score"] // 100) for w in ws)
                             for ws in windows], "f8")
        near, at, score = index.above(np.arange(len(anchors)), least_of)
        other = labels[at] != of_label[near]
        near, at, score = _ranked(near[other], at[other], score[other], ids)
        starts = np.searchsorted(near, np.arange(len(anchors) + 1))
        found = []
        for k, (row, vec_id) in enumerate(zip(anchors["row"], anchors["vec_id"])):
            of_anchor = score[starts[k]:starts[k + 1]]
            for w in windows[k]:
                p = int(w["positive_score"])
                from_ = np.searchsorted(-of_anchor, -(most * p // 100), side="left")
                to = np.searchsorted(-of_anchor, -max(level, least) * p // 100, side="right")
                for i in range(starts[k] + from_, starts[k] + min(to, from_ + n)):
                    found.append((w["slot"], row, vec_id, w["positive"], w["positive_id"], p,
                                  own[at[i]], ids[at[i]], score[i]))
        return pd.DataFrame(found, columns=names)

    return run


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """All rows beside all anchors, in bounded groups: each row once a chunk, each anchor once a block."""
    def dealt(n):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = rows.withColumn("block", dealt(blocks)).withColumn("chunk", each(chunks)).withColumn("asked", F.lit(False))
    asked = anchors.withColumn("chunk", dealt(chunks)).withColumn("block", each(blocks)).withColumn("asked", F.lit(True))
    return index.unionByName(asked, allowMissingColumns=True)


def _in_order(score: str, vec_id: str, row: str) -> list[Column]:
    return [F.desc(score), F.col(vec_id), F.col(row)]


def mine(vectors: DataFrame, anchors: Column, scale: int = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from `vectors`
    (vec_id, label, embedding).

    `anchors` is a condition on vec_id. An anchor's positives are its first other rows of equal
    label by score, then by smaller vec_id; for each of them come the first rows of another label
    whose score lies in `least` to `most` percent of the positive's. `levels` are the thresholds
    in turn, in percent; the last counts as `least`. An anchor without positives, or a window
    without rows, gives none; so does an empty table.
    """
    rows = kept(_whole(vectors, scale), "integers")
    asked = rows.filter(anchors)
    n, n_asked = rows.count(), asked.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_asked // CHUNK))
    key = ["size", "block", "chunk"]
    near = _grid(rows, asked, blocks, chunks).groupBy(*key).applyInPandas(_positives(positives), SCORED)
    order = Window.partitionBy("anchor").orderBy(*_in_order("positive_score", "positive_id", "positive"))
    first = near.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= positives)
    # Below zero, `least` percent are more than `most` percent.
    open_ = kept(first.filter("positive_score >= 0"), "windows")
    window = Window.partitionBy("anchor", "slot").orderBy(*_in_order("negative_score", "negative_id", "negative"))
    ended = None
    for level in (*[x for x in levels if x > least], least):
        listed = open_.groupBy("anchor").agg(F.collect_list(F.struct(
            "slot", "positive", "positive_id", "positive_score")).alias("windows"))  # as many as positives
        waiting = asked.join(listed, F.col("row") == F.col("anchor")).drop("anchor")
        met = _grid(rows, waiting, blocks, chunks).groupBy(*key).applyInPandas(
            _negatives(negatives, level, least, most), MINED)
        ranked = kept(met.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= negatives), "mined")
        if level > least:
            full = ranked.filter(F.col("rank") == negatives).select("anchor", "slot")
            open_ = kept(open_.join(full, ["anchor", "slot"], "left_anti"), "windows")
            ranked = ranked.join(full, ["anchor", "slot"], "left_semi")
        ended = ranked if ended is None else ended.unionByName(ranked)
        if level > least and open_.isEmpty():
            break
    return ended.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
