"""Embedding near-duplicates by an epsilon grid order join.

Cosine similarity of at least ``c`` is a distance of at most ``sqrt(2 - 2c)``
between unit vectors. Vectors are turned to their principal axes and sorted by
the grid cells, of that side length, that they fall into on the leading axes.
The sequence is cut into blocks; two blocks are joined only if some of their
cells are neighbours and their bounding boxes are near enough. Within a pair of
blocks, intervals of the sequence are halved recursively, provably distant ones
are skipped, and short ones are compared by matrix products in double precision.

Equal vectors form one class before anything is joined. A pair of blocks returns,
for each class, the number of vectors that it links to and one edge of a local
spanning forest, so a dense cluster of ``n`` vectors yields ``n`` rows, not n².

Null and empty vectors, zero vectors and vectors with null, NaN or infinite
components link with nothing. Shorter vectors count as padded with zeros. Equal
rows with one ``vec_id`` are separate vectors that link to each other, and different
vectors with one id are judged each for itself. A vector without id links like any
other; its component is the smallest id there is in it, null if there is none, and it
is kept only then. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.components import components
from gritstone.runtime import materialize, share_package

MIN_COSINE = 0.95
BLOCK_VECTORS = 2048
#: Leading principal axes that order the vectors, and axes whose bounds rule out intervals.
GRID_AXES = 4
BASE = 256
#: Distances are compared with this slack before the exact comparison of cosines.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: list, dimensions: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    out = np.zeros((len(vectors), dimensions))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dimensions: int) -> np.ndarray:
    """Orthonormal axes by falling variance, from sums over partitions."""

    def sums(batches):
        total, outer, n = np.zeros(dimensions), np.zeros((dimensions, dimensions)), 0
        for batch in batches:
            x = unit(list(batch.embedding), dimensions)
            total, outer, n = total + x.sum(axis=0), outer + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": range(dimensions), "total": total, "products": list(outer), "n": n})

    parts = classes.select("embedding").mapInPandas(sums, "i int, total double, products array<double>, n long")
    rows = (
        parts.select("i", "total", "n", F.posexplode("products").alias("j", "p"))
        .groupBy("i", "j")
        .agg(F.sum("p").alias("p"), F.max("total").alias("one"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    outer, total, n = np.zeros((dimensions, dimensions)), np.zeros(dimensions), 1
    for r in rows:
        outer[r.i, r.j], total[r.i], n = r.p, r.total, max(r.n, 1)
    covariance = outer / n - np.outer(total, total) / n**2
    # Rounding keeps the axes the same whatever the order of the sums.
    values, axes = np.linalg.eigh(np.round(covariance, 10))
    return axes[:, np.argsort(-values, kind="stable")]


def _distant(low_a, high_a, low_b, high_b, reach: float) -> bool:
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > (reach + SLACK) ** 2


class _Links:
    """Link counts and a spanning forest over the classes of a pair of blocks."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.counts = np.zeros(len(sizes), np.int64)
        self.root = np.arange(len(sizes))

    def add(self, rows: np.ndarray, columns: np.ndarray) -> None:
        np.add.at(self.counts, rows, self.sizes[columns])
        np.add.at(self.counts, columns, self.sizes[rows])
        while True:
            a, b = self.root[rows], self.root[columns]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def join_intervals(x: np.ndarray, turned: np.ndarray, add: Callable, a: tuple, b: tuple, min_cosine: float) -> None:
    """Give ``add`` the links between two intervals of the sequence, or within one if they are the same."""
    reach = float(np.sqrt(2 - 2 * min_cosine))
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a[0] >= a[1] or b[0] >= b[1]:
            continue
        xa, xb = turned[a[0] : a[1]], turned[b[0] : b[1]]
        if a != b and _distant(xa.min(axis=0), xa.max(axis=0), xb.min(axis=0), xb.max(axis=0), reach):
            continue
        if a[1] - a[0] <= BASE and b[1] - b[0] <= BASE:
            near = x[a[0] : a[1]] @ x[b[0] : b[1]].T >= min_cosine
            if a == b:
                near = np.triu(near, 1)
            rows, columns = np.nonzero(near)
            if len(rows):
                add(rows + a[0], columns + b[0])
            continue
        halves_a = [(a[0], sum(a) // 2), (sum(a) // 2, a[1])] if a[1] - a[0] > BASE else [a]
        if a == b:
            todo += [(halves_a[0], halves_a[0]), (halves_a[0], halves_a[1]), (halves_a[1], halves_a[1])]
            continue
        halves_b = [(b[0], sum(b) // 2), (sum(b) // 2, b[1])] if b[1] - b[0] > BASE else [b]
        todo += [(i, j) for i in halves_a for j in halves_b]


def _grid(classes: DataFrame, axes: np.ndarray, side: float) -> DataFrame:
    """Classes with their cell on the leading axes and their turned coordinates."""
    dimensions = axes.shape[0]
    shown = min(GRID_AXES, dimensions)

    def place(batches):
        for batch in batches:
            turned = unit(list(batch.embedding), dimensions) @ axes[:, :shown]
            yield batch.assign(cell=list(np.floor(turned / side).astype(np.int32)))

    return classes.mapInPandas(place, "class_id long, copies long, embedding array<double>, cell array<int>")


def _near_blocks(placed: DataFrame, axes_shown: int) -> DataFrame:
    """Pairs of blocks ``a <= b`` that hold the same cell or neighbouring cells on the two leading axes."""
    keyed = placed.select("block", F.col("cell")[0].alias("c0"), (F.col("cell")[1] if axes_shown > 1 else F.lit(0)).alias("c1")).distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = keyed.select(F.col("block").alias("a"), "c0", "c1", F.explode(steps).alias("s")).select(
        "a", (F.col("c0") + F.col("s.i")).alias("c0"), (F.col("c1") + F.col("s.j")).alias("c1")
    )
    pairs = around.join(keyed.withColumnRenamed("block", "b"), ["c0", "c1"]).where("a <= b").select("a", "b").distinct()
    bounds = placed.groupBy("block").agg(
        *[f(F.col("cell")[i]).alias(f"{n}{i}") for i in range(axes_shown) for f, n in ((F.min, "low"), (F.max, "high"))]
    )
    left = bounds.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in bounds.columns if c != "block"])
    right = bounds.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in bounds.columns if c != "block"])
    # Cells more than one apart on any axis are farther than the side length.
    near = [
        (F.col(f"a_low{i}") <= F.col(f"b_high{i}") + 1) & (F.col(f"b_low{i}") <= F.col(f"a_high{i}") + 1) for i in range(axes_shown)
    ]
    return pairs.join(left, "a").join(right, "b").where(reduce(lambda p, q: p & q, near)).select("a", "b")


def epsilon_join(vectors: DataFrame, min_cosine: float = MIN_COSINE, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``)."""
    share_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")))
    # Ids may be null or repeated, so a class has a number of its own, and its smallest id beside it.
    equal = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    classes = materialize(equal.withColumn("class_id", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size.n:
        return alone
    side = float(np.sqrt(2 - 2 * min_cosine))
    axes = principal_axes(classes, size.d)
    shown = min(GRID_AXES, size.d)
    gridded = _grid(classes.select("class_id", "copies", "embedding"), axes, side)
    blocks = max(1, -(-size.n // block_vectors))
    placed = materialize(
        gridded.repartitionByRange(blocks, "cell", "class_id")
        .sortWithinPartitions("cell", "class_id")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("at", 33) * 1_000_000 + (F.col("at").bitwiseAND((1 << 33) - 1) / (2 * block_vectors)).cast("long"))
    )
    pairs = materialize(_near_blocks(placed, shown))
    dimensions = size.d

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        ids = group.class_id.to_numpy()
        by_id = np.argsort(ids, kind="stable")  # roots are then the smallest ids
        x = unit(list(group.embedding), dimensions)
        turned = x @ axes
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        links = _Links(group.copies.to_numpy()[by_id])
        split = int((group.block == key[0]).sum())
        a, b = (0, split), (0, split) if key[0] == key[1] else (split, len(group))

        join_intervals(x, turned, lambda rows, columns: links.add(rank[rows], rank[columns]), a, b, min_cosine)
        linked = np.flatnonzero(links.counts)
        return pd.DataFrame({"class_id": ids[by_id][linked], "n": links.counts[linked], "root": ids[by_id][links.root[linked]]})

    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    found = materialize(
        placed.select("class_id", "copies", "embedding", "at", "block")
        .join(ends, "block")
        .groupBy("a", "b")
        .applyInPandas(join, "class_id long, n long, root long")
    )
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    together = components(found.select("class_id", "root"))
    named = (
        classes.select("embedding", "class_id", "least", "copies")
        .join(counts, "class_id", "left")
        .join(together.withColumnRenamed("node", "class_id"), "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id"))
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    summary = named.join(smallest, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(summary, "embedding").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    bad = rows.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(bad)
