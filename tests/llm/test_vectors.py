"""Multi-index near duplicates and hard negatives against brute force, and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.llm import hard_negatives, multi_index

# Columns of the operators' own names must not disturb them.
VECTORS = "vec_id long, embedding array<double>, label int, block string, digest string, rank string, n string, i string"
EXTRA = ("b", "d", "r", "n", "i")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTORS)


def planted(n, size=12, labels=3, seed=5):
    """Random vectors, with chains of near copies and exact copies; a third of all under one label."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0 or not rows:
            v, label = rng.normal(size=size), int(rng.integers(labels)) if i % 3 else 0
        else:
            _, v, label = rows[-1]
            v = np.asarray(v) if i % 4 == 3 else np.asarray(v) + rng.normal(size=size) * 0.17
        rows.append((i, [float(x) for x in v], label))
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, threshold):
    n = len(rows)
    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None and label is not None and usable(v) and any(v) else None
             for i, v, label in rows]
    met = {k: [m for m in range(n) if m != k and units[k] is not None and units[m] is not None
               and rows[k][2] == rows[m][2] and len(units[k]) == len(units[m]) and units[k] @ units[m] >= threshold]
           for k in range(n)}
    low = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in range(n):
        old = dict(low)
        for k, others in met.items():
            for m in others:
                low[rows[k][0]] = min(low[rows[k][0]], low[rows[m][0]])
        if old == low:
            break
    return sorted(((r[0], len(met[k]), low.get(r[0]), True if r[0] is None else low[r[0]] == r[0])
                   for k, r in enumerate(rows)), key=repr)


def links(df, **more):
    return sorted((tuple(r) for r in multi_index.near_vectors(df, **more).collect()), key=repr)


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "CHUNK", 2)
    rows = planted(240)
    want = brute_links(rows, 0.93)
    assert links(frame(spark, rows)) == want and sum(r[1] for r in want) > 100


def test_target_recall(spark):
    rows = planted(400, size=16)
    want = {r[0]: r[1] for r in brute_links(rows, 0.93)}
    got = {r[0]: r[1] for r in links(frame(spark, rows), target_recall=0.95)}
    assert sum(got.values()) >= 0.9 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def test_few_cells_are_visited():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    books = [multi_index._centroids(centres + rng.normal(size=(8, 6)) * 0.01, 8) for _ in (0, 1)]
    low = [multi_index._bounds(centres, b) for b in books]
    seen = multi_index.visited(*low, 0.14)
    assert seen.any(axis=(1, 2)).all() and seen.mean() < 0.1
    # The traversal takes exactly the cells whose bounds add up to no more than the reach.
    assert (seen == (low[0][:, :, None] + low[1][:, None, :] <= 0.14 + multi_index.SLACK)).all()


ODD = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0),
       (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0),
       (9, [1.0, 0.0], 0), (10, [1e300, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 1), (13, [2.0], 0),
       (14, [1.0], 0), (15, [-0.0, -1.0], 0), (16, [0.0, -1.0], 0), (17, [0.0, 1.0], 0), (17, [-1.0, 0.0], 0)]


def test_links_of_odd_rows(spark):
    assert links(frame(spark, ODD)) == brute_links(ODD, 0.93)
    assert multi_index.near_vectors(frame(spark, ODD[:1]).limit(0)).count() == 0
    assert links(frame(spark, ODD[:7])) == [(i, 0, i, True) for i in range(1, 8)]


def test_links_of_float_vectors(spark):
    rows = planted(60)
    floats = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    narrow = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert links(floats) == brute_links(narrow, 0.93)


# --- hard negatives --------------------------------------------------------------------------


def brute_mine(rows, every, least=30, most=90, scale=256):
    whole = [(k, i, label, [math.floor(scale * x) for x in v]) for k, (i, v, label) in enumerate(rows)
             if i is not None and label is not None and usable(v)]
    out = []
    for k, i, label, v in whole:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in whole
                         if m != k and len(v) == len(w)))
        for p, j, _, _ in [s for s in scored if s[3] == label][:5]:
            inside = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(inside[:10])]
    return sorted(out)


def mined(df, every, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("block, chunk", [(4096, 1024), (50, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = planted(300, size=20)
    want = brute_mine(rows, 10)
    assert mined(frame(spark, rows), 10) == want and len(want) > 300


def test_negatives_by_other_levels(spark):
    rows = planted(120, size=9)
    assert mined(frame(spark, rows), 5, levels=(85, 60)) == mined(frame(spark, rows), 5, levels=()) == brute_mine(rows, 5)


def test_negatives_of_odd_rows(spark):
    rows = [r if r[0] != 10 else (10, [1e6, 3e9], 0) for r in ODD] + [
        (20, [0.5, 0.0], 1), (20, [0.5, 0.0], 1), (30, [0.4, 0.1], 2), (40, [0.0, 0.0], 2), (50, [-3.0, 2.0], 2)]
    assert mined(frame(spark, rows), 1) == brute_mine(rows, 1)
    assert hard_negatives.mine(frame(spark, ODD[:1]), F.lit(True)).count() == 0


def test_index_omits_what_cannot_reach():
    rng = np.random.default_rng(3)
    anchors, rows = (rng.integers(-60, 60, size=(n, 30)) for n in (7, 500))
    scores = anchors @ rows.T
    index = hard_negatives.Index(anchors, rows)
    for least in (np.quantile(scores, 0.99), np.quantile(scores, 0.5), -np.inf):
        near, at, score = index.above(np.arange(7), np.full(7, float(least)))
        want = np.argwhere(scores >= least)
        assert sorted(zip(near, at)) == sorted(map(tuple, want)) and (score == scores[near, at]).all()
    # Beyond doubles the arithmetic stays exact.
    large = hard_negatives.Index(anchors * 10 ** 6, rows * 10 ** 6 + 1)
    near, at, score = large.above(np.arange(7), np.full(7, -np.inf))
    assert (score == (anchors * 10 ** 6 @ (rows.T * 10 ** 6 + 1))[near, at]).all()
