"""Near duplicates of embeddings by an inverted multi-index.

Each vector is cut in two halves. A codebook for each half makes a product grid, and a
vector is filed in the cell of its nearest centroids. A query visits cells by a
multi-sequence traversal: with the centroids of each half in order of a lower bound of
their distance, cells are taken in order of the sum of both bounds, and the traversal
ends when the sum passes its reach. The bound is the distance to the plane between the
own centroid and the other one, so at target recall 1 the reach is the distance that
belongs to the threshold, and no link is missed. A smaller target recall takes the
reach from links found in the fitting sample. What is met in visited cells is verified
by its cosine.

Rows with a null vec_id, label or vector, an empty or zero vector, or a null or
non-finite component link with nothing: they come back alone. Vectors of different
length never link. Equal vectors of one label are one class: the index holds each class
once, its links count by the size of the classes. Rows that share a vec_id are vectors
of their own, but one node of a component. Other columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from mailloom.llm.common import kept
from mailloom.llm.components import components

THRESHOLD = 0.93
SAMPLE = 8_192  # classes that codebooks are fitted on
MOST_CENTROIDS = 256  # of one half
BLOCK = 2_048  # classes of one index block, fewer where vectors are long
BLOCK_VALUES = 1 << 20
CHUNK = 8  # query blocks that meet an index block in one task
ROUNDS = 8  # of the fitting
SLACK = 1e-9

RESULT = "vec_id long, n_links long, component_id long, kept boolean"
FILED = "label long, size int, digest binary, vec_id long, n long, vector binary, i int, j int"


def _usable() -> F.Column:
    parts = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(parts, lambda x: x != 0)
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(given & finite & some, F.lit(False))


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, digest, vector): vectors as bytes, known by a 128-bit digest.

    Components keep their width; a negative zero is a zero.
    """
    element = vectors.schema["embedding"].dataType
    narrow = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = "<f4" if narrow else "<f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [np.asarray(v, dtype=kind) + np.zeros(1, kind) for v in pdf["embedding"]]
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"], "label": pdf["label"],
                "size": [len(v) for v in held], "vector": [v.tobytes() for v in held],
            })

    rows = vectors.filter(_usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    out = rows.mapInPandas(run, "vec_id long, label long, size int, vector binary")
    return out.withColumn("digest", F.unhex(F.md5("vector")))


def _matrix(vectors, size: int) -> np.ndarray:
    """Unit vectors in double precision, one a row. Large ones are scaled before they are squared."""
    data = b"".join(vectors)
    kind = "<f4" if len(data) == 4 * size * len(vectors) else "<f8"
    rows = np.frombuffer(data, kind).reshape(len(vectors), size).astype("f8")
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centroids (columns)."""
    return (points * points).sum(1)[:, None] - 2 * points @ book.T + (book * book).sum(1)


def _centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced rows, which come in an order by digest; empty cells stay put."""
    if not points.shape[1]:  # half of a vector of one component
        return np.zeros((1, 0))
    book = np.unique(points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        near = _squares(points, book).argmin(axis=1)
        sums, sizes = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(sums, near, points)
        full = sizes > 0
        book[full] = sums[full] / sizes[full, None]
    return np.unique(book, axis=0)


def _bounds(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each point and centroid, a lower bound of the squared distance to what the centroid owns:
    how far the point is beyond the planes between that centroid and each other one."""
    squares = _squares(points, book)
    apart = np.sqrt(np.maximum(_squares(book, book), 0))
    low = np.zeros_like(squares)
    for k in range(len(book)):
        # Centroids that are almost one have no plane that doubles can place.
        scale = np.where(apart[k] > 1e-6, 0.5 / np.maximum(apart[k], 1e-6), 0)
        np.maximum(low, (squares - squares[:, k:k + 1]) * scale, out=low)
    return low * low


def visited(first: np.ndarray, second: np.ndarray, reach: float) -> np.ndarray:
    """The multi-sequence traversal for many queries at once: bool (query, cell of the first half,
    cell of the second half), true where the bounds of both halves together are within reach.

    Both halves are put in order; the frontier then falls in steps, one for each centroid of
    the first half, and all cells below it come before the end of the traversal.
    """
    order = np.argsort(second, axis=1)
    ranked = np.take_along_axis(second, order, axis=1)
    left = reach + SLACK - first  # what the second half may add
    steps = np.stack([np.searchsorted(r, f, side="right") for r, f in zip(ranked, left)])
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return rank[:, None, :] < steps[:, :, None]


def _reach(unit: np.ndarray, labels: np.ndarray, books, threshold: float, target_recall: float) -> float:
    """Reach of the traversal: for full recall the squared distance at the threshold, else the
    quantile of the bounds of those links that the sample holds."""
    far = 2 - 2 * threshold
    if target_recall >= 1:
        return far
    found = []
    own = [_squares(p, b).argmin(axis=1) for p, b in zip(_halves(unit), books)]
    for at in range(0, len(unit), 1024):
        some = slice(at, at + 1024)
        met = (unit[some] @ unit.T >= threshold) & (labels[some, None] == labels)
        q, x = np.nonzero(met)
        low = [_bounds(p[some], b) for p, b in zip(_halves(unit), books)]
        found.append((low[0][q, own[0][x]] + low[1][q, own[1][x]])[q + at != x])
    every = np.concatenate(found)
    return min(far, float(np.quantile(every, target_recall))) if len(every) else far


def _fitted(classes: DataFrame, total: int, threshold: float, target_recall: float) -> dict:
    """Codebooks and reach for each vector length, from the SAMPLE classes of smallest digest.

    The number of centroids grows with the fourth root of the number of classes, so that the
    number of cells grows with its square root. A length that the sample lacks has one cell.
    """
    k = int(min(MOST_CENTROIDS, max(4, 2 * total ** 0.25)))
    rows = classes.orderBy("digest").limit(SAMPLE).select("label", "size", "vector").toPandas()
    fitted = {}
    for size, pdf in rows.groupby("size"):
        unit = _matrix(list(pdf["vector"]), int(size))
        books = tuple(_centroids(h, k) for h in _halves(unit))
        fitted[int(size)] = (books, _reach(unit, pdf["label"].to_numpy(), books, threshold, target_recall))
    return fitted


def _books(fitted: dict, size: int, threshold: float):
    return fitted.get(size) or (tuple(np.zeros((1, n)) for n in (size // 2, size - size // 2)), 2 - 2 * threshold)


def _filed(classes: DataFrame, fitted: dict, threshold: float) -> DataFrame:
    """Each class with its cell (i, j)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                books, _ = _books(fitted, int(size), threshold)
                halves = _halves(_matrix(list(part["vector"]), int(size)))
                i, j = (_squares(h, b).argmin(axis=1) for h, b in zip(halves, books))
                yield part.assign(i=i, j=j)[[c.split()[0] for c in FILED.split(", ")]]

    return classes.mapInPandas(run, FILED)


def _blocked(filed: DataFrame) -> DataFrame:
    """Classes along the order of their cells, cut into blocks of at most BLOCK, none over two spaces.

    Equal cells and near ones share blocks; a full cell fills many.
    """
    along = filed.repartitionByRange("label", "size", "i", "j", "digest").sortWithinPartitions(
        "label", "size", "i", "j", "digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, space, n = TaskContext.get().partitionId() << 32, None, 0
        for pdf in batches:
            marks = np.empty(len(pdf), "int64")
            for at, here in enumerate(zip(pdf["label"], pdf["size"])):
                if here != space or n >= min(BLOCK, BLOCK_VALUES // here[1]):
                    block, space, n = block + 1, here, 0
                marks[at], n = block, n + 1
            yield pdf.assign(block=marks)

    return along.mapInPandas(run, FILED + ", block long")


def _visits(blocked: DataFrame, fitted: dict, threshold: float) -> DataFrame:
    """(label, size, i, j, asks): cells that some query of block `asks` visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, size, block), part in pdf.groupby(["label", "size", "block"]):
                books, reach = _books(fitted, int(size), threshold)
                halves = _halves(_matrix(list(part["vector"]), int(size)))
                seen = np.zeros([len(b) for b in books], bool)
                for at in range(0, len(part), 256):
                    low = [_bounds(h[at:at + 256], b) for h, b in zip(halves, books)]
                    seen |= visited(*low, reach).any(axis=0)
                i, j = np.nonzero(seen)
                yield pd.DataFrame({"label": label, "size": size, "i": i, "j": j, "asks": block})

    return blocked.select("label", "size", "block", "vector").mapInPandas(
        run, "label long, size int, i int, j int, asks long")


def _verified(fitted: dict, threshold: float):
    """One index block and some query blocks: links of each query, and the smallest vec_id that
    it reaches among them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "i", "j"], kind="stable")
        size = int(pdf["size"].iloc[0])
        books, reach = _books(fitted, size, threshold)
        unit = _matrix(list(pdf["vector"]), size)
        asked = (pdf["role"] == "query").to_numpy()
        ids, n = pdf["vec_id"].to_numpy("int64"), pdf["n"].to_numpy("int64")
        q_unit, q_ids = unit[asked], ids[asked]
        x_unit, x_ids, x_n = unit[~asked], ids[~asked], n[~asked]
        cells = (pdf["i"].to_numpy("int64") * len(books[1][:, 0]) + pdf["j"].to_numpy("int64"))[~asked]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.array([], int)
        ends = np.r_[starts[1:], len(cells)]
        links = np.zeros(len(q_ids), "int64")
        left, right = [], []
        for at in range(0, len(q_ids), 512):
            some = q_unit[at:at + 512]
            low = [_bounds(h, b) for h, b in zip(_halves(some), books)]
            seen = visited(*low, reach)
            for s, e in zip(starts, ends):
                i, j = divmod(int(cells[s]), len(books[1]))
                who = np.flatnonzero(seen[:, i, j])
                if not len(who):
                    continue
                q, x = np.nonzero(some[who] @ x_unit[s:e].T >= threshold)
                np.add.at(links, at + who[q], x_n[s + x])
                left.append(at + who[q])
                right.append(s + x)
        low = _smallest(q_ids, x_ids, left, right)
        return pd.DataFrame({
            "label": pdf["label"].to_numpy()[asked], "digest": pdf["digest"].to_numpy()[asked],
            "vec_id": q_ids, "links": links, "low": low,
        })

    return run


def _smallest(q_ids, x_ids, left, right) -> np.ndarray:
    """For each query the smallest vec_id of its component among these links."""
    nodes, at = np.unique(np.concatenate([q_ids, x_ids]), return_inverse=True)
    root = np.arange(len(nodes))
    if left:
        a, b = at[np.concatenate(left)], at[len(q_ids) + np.concatenate(right)]
        while (root[a] != root[b]).any():
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return nodes[root[at[:len(q_ids)]]]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, label, embedding).

    n_links: other rows of equal label with a cosine of at least `threshold`; component_id: the
    smallest vec_id that links reach; kept: whether that is the own one. A row that links with
    nothing has its own vec_id (a null one stays null) and is kept. An empty table gives none.
    """
    rows = kept(_packed(vectors), "vectors")
    key = ["label", "digest"]
    classes = kept(rows.groupBy("label", "size", "digest").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.any_value("vector").alias("vector")), "classes")
    fitted = _fitted(classes, classes.count(), threshold, target_recall)
    blocked = kept(_blocked(_filed(classes, fitted, threshold)), "blocks")
    directory = blocked.groupBy("label", "size", "i", "j", "block").agg(F.count("*").alias("rows"))
    met = _visits(blocked, fitted, threshold).distinct().join(directory, ["label", "size", "i", "j"]) \
        .select("block", "asks").distinct()
    # Query blocks are numbered along the grid, so neighbours share a chunk of the same index block.
    met = kept(met.withColumn("chunk", F.floor(F.col("asks") / CHUNK)), "meetings")
    index = met.select("block", "chunk").distinct().join(blocked, "block").withColumn("role", F.lit("index"))
    asked = met.join(blocked.withColumnRenamed("block", "asks"), "asks").drop("asks").withColumn(
        "role", F.lit("query"))
    found = kept(index.unionByName(asked).groupBy("block", "chunk").applyInPandas(
        _verified(fitted, threshold), "label long, digest binary, vec_id long, links long, low long"), "links")
    labels = components(found.filter("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    of_class = _of_class(found, labels, key)
    linked = rows.join(of_class, key).select("vec_id", "n_links", "component_id")
    own = F.col("vec_id").cast("long")
    alone = vectors.filter(~_usable()).select(
        own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_class(found: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Links (without the own row) and component of each class."""
    component = labels.select(F.col("node").alias("first"), F.col("label").alias("component"))
    return found.groupBy(*key).agg(
        F.sum("links").alias("links"), F.any_value("vec_id").alias("first")
    ).join(component, "first", "left").select(
        *key, (F.col("links") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
