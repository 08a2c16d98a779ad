"""Tuning of forests and boosted trees for numbers as targets, on features in at most 32 bins.

Spark's own trainers make a job per level and model and walk over every entry of a vector, so a grid over folds is
thousands of passes over the table. Here the rows of a view are reduced to one small code per column (a bin of a number,
the index of a category) and sent to the tasks once. Rows of equal codes share a cell, and trees need only a cell's
count and sums. One forest has all points that differ in the number of trees or in depth alone: its first trees are the
smaller forest, and its upper levels the shallower trees. One boosted model has all shorter ones.

Bins, gains, stopping rules and steps are those of Spark, with bins from all rows instead of a sample. Every tree draws
its own bootstrap, seeded by its number, over rows in a fixed order, so neither tasks nor partitions change a result.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.values import quote
from gritstone.operators.preparation import FOLD, Preparation
from gritstone.runtime import discard, scratch_path, share_package, small_frame

MAX_BINS = 32
MAX_DEPTH = 30
# Codes and labels of a view that tasks may hold; larger tables are left to Spark's trainers.
MOST_BYTES = 256 << 20
# Numbers that reach the driver at once, when bins are chosen.
PIECE_BYTES = 128 << 20
# Rows that are drawn, and histogram entries that are filled, at once.
DRAWN_ROWS = 1 << 18
ENTRIES = 1 << 21
# Rows of a cell from which growing trees again is cheaper than sending every row through them.
ROWS_A_CELL = 8
# Gains below this share of a node's sum of squares are rounding.
ROUNDING = 1e-12
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint,"
    " gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>,"
    " numCategories int>>"
)


@dataclass
class Block:
    """A column of codes: a number, or a category with an entry of the vector for each of its labels."""

    cell: str
    first: int
    labels: int | None
    cuts: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.cuts) + 1 if self.labels is None else self.labels + 1

    @property
    def stored(self) -> T.DataType:
        return T.ByteType() if self.labels is None else T.IntegerType()

    def coded(self, cells: np.ndarray) -> np.ndarray:
        """Codes of cells; a label that is not known gets the last one."""
        if self.labels is None:
            return np.searchsorted(self.cuts, cells).astype(np.int8)
        return np.minimum(cells, self.labels).astype(np.int32)


@dataclass
class Cells:
    """Rows of one view by their codes. Labels have ``mean`` taken off, and rows of a cell lie together."""

    codes: list[np.ndarray]
    rows: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    mean: float
    starts: np.ndarray | None = None
    labels: np.ndarray | None = None

    def counted(self) -> Cells:
        """Without single rows, which only forests read."""
        return Cells(self.codes, self.rows, self.sums, self.squares, self.mean)

    def drawn(self, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sum and sum of squares of each cell in the bootstrap of a tree."""
        draw = np.random.default_rng([seed, tree])
        found = tuple(np.zeros(len(self.rows)) for _ in range(3))
        for low in range(0, len(self.labels), DRAWN_ROWS):
            part = self.labels[low : low + DRAWN_ROWS]
            weight = draw.poisson(1.0, len(part)).astype(np.float64)
            a = np.searchsorted(self.starts, low, "right") - 1
            b = np.searchsorted(self.starts, low + len(part), "left")
            starts = np.maximum(self.starts[a:b] - low, 0)
            for total in found:
                total[a:b] += np.add.reduceat(weight, starts)
                weight = weight * part
        return found


@dataclass
class Tree:
    """Nodes level by level; the children of a split are neighbours, right after left."""

    block: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    count: np.ndarray
    square: np.ndarray
    gain: np.ndarray

    def values(self, codes: list[np.ndarray], categories: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
        """Predictions for cells, of the tree cut at each depth."""
        place = np.zeros(len(codes[0]), np.int64)
        found = {}
        for depth in range(max(depths) + 1):
            if depth in depths:
                found[depth] = self.value[place]
            if depth < max(depths):
                going = np.flatnonzero(self.left[place] >= 0)
                at = place[going]
                if not len(at):
                    break
                right = np.zeros(len(at), bool)
                for b in np.unique(self.block[at]):
                    here = self.block[at] == b
                    cells = codes[b][going[here]]
                    cut = self.cut[at[here]]
                    right[here] = cells == cut if categories[b] else cells > cut
                place[going] = self.left[at] + right
        return {d: found[d] if d in found else self.value[place] for d in depths}


def blocks_of(view: Preparation | None, chosen: list[str]) -> list[Block] | None:
    """Columns behind the entries of a view's vectors; None if there are others."""
    if view is None:
        return [Block(f"cast({quote(c)} as double)", i, None) for i, c in enumerate(chosen)]
    if view.hashed or view.components is not None:
        return None
    blocks = [Block(f"__num_{i}", i, None) for i in range(len(view.numbers))]
    first = len(blocks)
    for i, c in enumerate(view.categories):
        blocks.append(Block(f"cast(__index_{i} as int)", first, len(view.labels[c])))
        first += len(view.labels[c])
    return blocks


def cuts_of(numbers: np.ndarray) -> np.ndarray:
    """Thresholds between the bins of a column: all of them if they are few, else at about equal numbers of rows."""
    counts = pd.Series(numbers).value_counts(sort=False).sort_index()
    values, counts = counts.index.to_numpy(), counts.to_numpy()
    most = min(MAX_BINS, len(numbers)) - 1
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2
    upto = np.cumsum(counts)
    middles = upto[:-1] + upto[1:]
    stride, cuts, at = len(numbers) / (most + 1), [], 0
    for k in range(1, most + 1):
        # The first value that lies farther from the wanted count than the one before.
        at = max(at + 1, int(np.searchsorted(middles, 2 * stride * k, "right")) + 1)
        if at >= len(values):
            break
        cuts.append((values[at - 1] + values[at]) / 2)
    return np.array(cuts)


def _set_cuts(inside: DataFrame, blocks: list[Block], rows: int) -> bool:
    """Choose the bins of all numbers; False if one of them is no finite number."""
    numbers = [b for b in blocks if b.labels is None]
    wide = max(1, PIECE_BYTES // (8 * max(rows, 1)))
    for low in range(0, len(numbers), wide):
        piece = numbers[low : low + wide]
        table = inside.select(*[F.expr(b.cell).alias(f"c{i}") for i, b in enumerate(piece)]).toArrow()
        for i, block in enumerate(piece):
            cells = table.column(i).to_numpy()
            if not np.isfinite(cells).all():
                return False
            block.cuts = cuts_of(cells)
    return True


def _coded(rows: DataFrame, blocks: list[Block]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, labels and folds of all rows."""
    fields = [T.StructField(f"c{i}", b.stored) for i, b in enumerate(blocks)]
    schema = T.StructType([*fields, T.StructField("label", T.DoubleType()), T.StructField(FOLD, T.IntegerType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [pa.array(b.coded(batch.column(i).to_numpy(zero_copy_only=False))) for i, b in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([*cells, *batch.columns[len(blocks) :]], names=schema.names)

    read = rows.select(*[F.expr(b.cell).alias(f"c{i}") for i, b in enumerate(blocks)], "label", FOLD)
    table = read.mapInArrow(coded, schema).toArrow()
    columns = [table.column(i).to_numpy() for i in range(len(blocks) + 2)]
    return columns[:-2], columns[-2], columns[-1]


def grouped(codes: list[np.ndarray], sizes: list[int], labels: np.ndarray) -> Cells:
    """Rows in the order of codes and labels, and the counts and sums of equal codes."""
    key, kinds = np.zeros(len(labels), np.int64), 1
    for column, size in zip(codes, sizes, strict=True):
        if kinds * size >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            kinds = len(known)
        key = key * size + column
        kinds *= size
    order = np.lexsort((labels, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    labels = labels[order]
    mean = float(labels.mean())
    labels = labels - mean
    firsts = order[starts]
    return Cells(
        [c[firsts] for c in codes], np.diff(np.append(starts, len(labels))).astype(np.float64),
        np.add.reduceat(labels, starts), np.add.reduceat(labels * labels, starts), mean, starts, labels,
    )


def grow(
    codes: list[np.ndarray], blocks: list[tuple[int, bool]], count: np.ndarray, total: np.ndarray, square: np.ndarray,
    depth: int, least: int,
) -> Tree:
    """One tree by variance. ``blocks`` holds the number of codes of each column and whether it is a category."""
    kept = np.flatnonzero(count > 0)
    node = np.zeros(len(kept), np.int64)
    count, total, square = count[kept], total[kept], square[kept]
    codes = [c[kept] for c in codes]
    levels: list[tuple[np.ndarray, ...]] = []
    width, base = 1, 0
    for level in range(depth + 1):
        n, s, q = (np.bincount(node, x, width) for x in (count, total, square))
        gain, at, cut = np.full(width, -1.0), np.full(width, -1), np.full(width, -1)
        if level < depth and len(node):
            for b, (size, category) in enumerate(blocks):
                step = max(1, ENTRIES // size)
                for low in range(0, width if size > 1 else 0, step):
                    high = min(low + step, width)
                    mine = slice(None) if high - low == width else np.flatnonzero((node >= low) & (node < high))
                    place = (node[mine] - low) * size + codes[b][mine]
                    ln, ls = (np.bincount(place, x[mine], (high - low) * size).reshape(-1, size)[:, :-1] for x in (count, total))
                    if not category:
                        ln, ls = ln.cumsum(axis=1), ls.cumsum(axis=1)
                    rn, rs = n[low:high, None] - ln, s[low:high, None] - ls
                    with np.errstate(divide="ignore", invalid="ignore"):
                        better = ls * ls / ln + rs * rs / rn - (s[low:high] ** 2 / n[low:high])[:, None]
                    better[~((ln >= least) & (rn >= least))] = -1.0
                    best = better.argmax(axis=1)
                    most = better[np.arange(high - low), best]
                    won = np.flatnonzero((most > ROUNDING * q[low:high]) & (most / n[low:high] > gain[low:high]))
                    gain[low + won], at[low + won], cut[low + won] = (most / n[low:high])[won], b, best[won]
        split = at >= 0
        base += width
        left = np.where(split, base + 2 * (np.cumsum(split) - 1), -1)
        levels.append((at, cut, left, s / n, n, q, gain))
        width = 2 * int(split.sum())
        if not width:
            break
        going = np.flatnonzero(split[node])
        node, count, total, square = node[going], count[going], total[going], square[going]
        codes = [c[going] for c in codes]
        right = np.zeros(len(node), np.int64)
        for b in np.unique(at[split]):
            here = np.flatnonzero(at[node] == b)
            cells, edge = codes[b][here], cut[node[here]]
            right[here] = cells == edge if blocks[b][1] else cells > edge
        node = left[node] - base + right
    return Tree(*(np.concatenate(x) for x in zip(*levels, strict=True)))


def forest_tree(cells: Cells, blocks: list[tuple[int, bool]], seed: int, tree: int, depth: int, least: int) -> Tree:
    return grow(cells.codes, blocks, *cells.drawn(seed, tree), depth, least)


def boosted(cells: Cells, blocks: list[tuple[int, bool]], trees: int, rate: float, depth: int, least: int) -> Iterator[tuple[Tree, float]]:
    """Trees and their weights; the first fits the labels, the others twice the errors left, as Spark has it."""
    categories = np.array([c for _, c in blocks])
    total, square, known = cells.sums, cells.squares, np.zeros(len(cells.rows))
    for i in range(trees):
        tree = grow(cells.codes, blocks, cells.rows, total, square, depth, least)
        weight = rate if i else 1.0
        yield tree, weight
        known = known + weight * tree.values(cells.codes, categories, [depth])[depth]
        total = 2 * (cells.sums - cells.rows * known)
        square = 4 * (cells.squares - 2 * known * cells.sums + cells.rows * known * known)


def _r2(held: Cells, offset: float, predicted: np.ndarray) -> float:
    """Score of predictions from which ``offset`` was taken off."""
    off = predicted + (offset - held.mean)
    errors = float((held.squares - 2 * off * held.sums + held.rows * off * off).sum())
    spread = float(held.squares.sum()) - float(held.sums.sum()) ** 2 / float(held.rows.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(1 - np.float64(max(errors, 0.0)) / np.float64(max(spread, 0.0)))


class Boosting(GBTRegressor):
    """Spark's estimator with the work of ``fit`` done here: what is passed is called and gives the model or its scores."""

    @classmethod
    def of(cls, estimator: GBTRegressor) -> Boosting:
        return estimator._copyValues(cls())

    def _fit_java(self, job):
        return job(self)

    def _create_model(self, made):
        return made

    def _copyValues(self, to, extra=None):
        return to


@dataclass
class TreeSearch:
    """Fits and scores trees on the views of one table."""

    spark: SparkSession
    estimators: list[Estimator]

    def _same(self, names: tuple[str, ...]) -> list[list[int]]:
        """Points that differ in nothing but these parameters."""
        groups: dict[str, list[int]] = {}
        for i, e in enumerate(self.estimators):
            rest = {p.name: v for p, v in e.extractParamMap().items() if p.name not in names}
            groups.setdefault(json.dumps(rest, sort_keys=True, default=str), []).append(i)
        return list(groups.values())

    def scores(self, inside: Cells, outside: Cells, blocks: list[Block], counted: bool = False) -> list[float]:
        """Score of every point on the rows outside, fitted on those inside; ``counted`` for rows that a fit has already seen."""
        shape = [(b.size, b.labels is not None) for b in blocks]
        categories = np.array([c for _, c in shape])
        forest = isinstance(self.estimators[0], RandomForestRegressor)
        share_package(self.spark)
        context = self.spark.sparkContext
        shared = context.broadcast((inside if forest else inside.counted(), outside.counted()))
        facts = [_facts(e) for e in self.estimators]
        try:
            if not forest:

                def boosting(group: list[int]) -> list[tuple[int, float]]:
                    fitted, held = shared.value
                    f = facts[group[0]]
                    known, found = np.zeros(len(held.rows)), []
                    for i, (tree, weight) in enumerate(boosted(fitted, shape, max(facts[p]["trees"] for p in group), f["rate"], f["depth"], f["least"]), start=1):
                        known += weight * tree.values(held.codes, categories, [f["depth"]])[f["depth"]]
                        found += [(p, _r2(held, fitted.mean, known)) for p in group if facts[p]["trees"] == i]
                    return found

                def fitted_group(group: list[int]) -> list[tuple[int, float]]:
                    longest = max(group, key=lambda p: facts[p]["trees"])
                    job = lambda _=None: context.parallelize([group], 1).flatMap(boosting).collect()
                    return job() if counted else Boosting.of(self.estimators[longest]).fit(job)

                groups = self._same(("maxIter",))
                with ThreadPool(len(groups)) as pool:
                    scored = [item for found in pool.map(fitted_group, groups, chunksize=1) for item in found]
            else:
                tasks = []
                for group in self._same(("numTrees", "maxDepth")):
                    tasks += [(group, trees) for trees in _dealt(self.spark, max(facts[p]["trees"] for p in group))]

                def growing(task: tuple[list[int], range]) -> list[tuple[int, np.ndarray]]:
                    group, trees = task
                    fitted, held = shared.value
                    f = facts[group[0]]
                    sums: dict[int, np.ndarray] = {}
                    for t in trees:
                        wanted = [p for p in group if facts[p]["trees"] > t]
                        depths = sorted({facts[p]["depth"] for p in wanted})
                        values = forest_tree(fitted, shape, f["seed"], t, depths[-1], f["least"]).values(held.codes, categories, depths)
                        for p in wanted:
                            sums[p] = sums[p] + values[facts[p]["depth"]] if p in sums else values[facts[p]["depth"]]
                    return list(sums.items())

                def scored_point(item: tuple[int, np.ndarray]) -> tuple[int, float]:
                    fitted, held = shared.value
                    return item[0], _r2(held, fitted.mean, item[1] / facts[item[0]]["trees"])

                summed = context.parallelize(tasks, len(tasks)).flatMap(growing).reduceByKey(np.add, len(facts))
                scored = summed.map(scored_point).collect()
        finally:
            shared.destroy()
        return [score for _, score in sorted(scored)]


def _facts(estimator: Estimator) -> dict:
    forest = isinstance(estimator, RandomForestRegressor)
    return {
        "trees": estimator.getNumTrees() if forest else estimator.getMaxIter(),
        "rate": None if forest else estimator.getStepSize(),
        "depth": estimator.getMaxDepth(),
        "least": estimator.getMinInstancesPerNode(),
        "seed": estimator.getSeed(),
    }


def _dealt(spark: SparkSession, trees: int) -> list[range]:
    """Trees of a forest in about three parts for every core."""
    step = max(1, trees // (3 * spark.sparkContext.defaultParallelism))
    return [range(low, min(low + step, trees)) for low in range(0, trees, step)]


def fits(estimator: Estimator, rows: int, columns: int) -> bool:
    """Whether an estimator is one of these trees and its table fits the tasks."""
    if not isinstance(estimator, RandomForestRegressor | GBTRegressor):
        return False
    facts = _facts(estimator)
    return 1 <= facts["depth"] <= MAX_DEPTH and facts["trees"] >= 1 and facts["least"] >= 1 and rows * (8 + columns) <= MOST_BYTES


def view_cells(rows: DataFrame, blocks: list[Block], fold: int | None, count: int) -> tuple[Cells, Cells | None] | None:
    """The cells of the rows inside and outside of a fold's complement; None where Spark's trainers would refuse or fail."""
    share_package(rows.sparkSession)
    if not _set_cuts(rows if fold is None else rows.where(f"{FOLD} <> {fold}"), blocks, count):
        return None
    codes, labels, folds = _coded(rows, blocks)
    if not np.isfinite(labels).all():
        return None
    sizes = [b.size for b in blocks]
    if fold is None:
        return grouped(codes, sizes, labels), None
    held = folds == fold
    if held.all() or not held.any():
        return None
    inside, outside = (grouped([c[part] for c in codes], sizes, labels[part]) for part in (~held, held))
    return inside, outside


def search_folds(estimators: list[Estimator], views: list[tuple[DataFrame, list[Block]]], count: int) -> list[list[float]] | None:
    """Scores by fold and point; None where Spark's trainers would refuse or fail."""
    found = []
    for fold, (rows, blocks) in enumerate(views):
        cells = view_cells(rows, blocks, fold, count)
        if cells is None:
            return None
        found.append(TreeSearch(rows.sparkSession, estimators).scores(*cells, blocks))
    return found


def _node_rows(tree: Tree, number: int, blocks: list[Block], mean: float) -> pa.RecordBatch:
    """Nodes of a tree as Spark stores them."""
    size = len(tree.left)
    split = tree.left >= 0
    value = tree.value + mean
    total = tree.count * value
    square = tree.square + 2 * mean * tree.count * tree.value + tree.count * mean * mean
    impurity = np.maximum(tree.square / tree.count - tree.value**2, 0.0)
    category = np.array([b.labels is not None for b in blocks])
    first = np.array([b.first for b in blocks])
    feature = np.where(split, first[tree.block] + np.where(category[tree.block], tree.cut, 0), -1)
    threshold = [0.5 if category[b] else blocks[b].cuts[c] for b, c in zip(tree.block[split], tree.cut[split], strict=True)]
    ints = lambda x: pa.array(np.asarray(x), pa.int32())
    upto = np.concatenate([[0], np.cumsum(split)])
    stats = pa.ListArray.from_arrays(ints(np.arange(size + 1) * 3), pa.array(np.column_stack([tree.count, total, square]).ravel()))
    splits = pa.StructArray.from_arrays(
        [ints(feature), pa.ListArray.from_arrays(ints(upto), pa.array(np.array(threshold, np.float64))), ints(np.full(size, -1))],
        names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    nodes = pa.StructArray.from_arrays(
        [
            ints(np.arange(size)), pa.array(value), pa.array(impurity), stats, pa.array(tree.count.astype(np.int64)),
            pa.array(tree.gain), ints(tree.left), ints(np.where(split, tree.left + 1, -1)), splits,
        ],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )
    return pa.RecordBatch.from_arrays([ints(np.full(size, number)), nodes], names=["treeID", "nodeData"])


def fit_trees(estimator: Estimator, rows: DataFrame, blocks: list[Block], count: int) -> tuple[Model | None, float | None]:
    """The estimator's model, fitted on all rows, and its score on them where cells are few enough to grow the trees again.

    No model where Spark's trainers would refuse or fail.
    """
    spark = rows.sparkSession
    found = view_cells(rows, blocks, None, count)
    if found is None:
        return None, None
    cells = found[0]
    few = len(cells.rows) * ROWS_A_CELL <= count
    own = TreeSearch(spark, [estimator]).scores(cells, cells, blocks, counted=True)[0] if few else None
    if isinstance(estimator, GBTRegressor):
        return Boosting.of(estimator).fit(lambda _: _fitted(estimator, spark, cells, blocks)), own
    return _fitted(estimator, spark, cells, blocks), own


def _fitted(estimator: Estimator, spark: SparkSession, cells: Cells, blocks: list[Block]) -> Model:
    forest = isinstance(estimator, RandomForestRegressor)
    f = _facts(estimator)
    shape = [(b.size, b.labels is not None) for b in blocks]
    parts = _dealt(spark, f["trees"]) if forest else [range(f["trees"])]
    shared = spark.sparkContext.broadcast(cells if forest else cells.counted())

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                fitted = shared.value
                if forest:
                    for t in parts[part]:
                        yield _node_rows(forest_tree(fitted, shape, f["seed"], t, f["depth"], f["least"]), t, blocks, fitted.mean)
                else:
                    for t, (tree, _) in enumerate(boosted(fitted, shape, f["trees"], f["rate"], f["depth"], f["least"])):
                        yield _node_rows(tree, t, blocks, 0.0 if t else fitted.mean)

    path = scratch_path(spark, "trees")
    features = blocks[-1].first + (blocks[-1].labels if blocks[-1].labels is not None else 1)
    given = {p.name: v for p, v in estimator._paramMap.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {"impurity": "variance"}}
    kind = "RandomForestRegressionModel" if forest else "GBTRegressionModel"
    whole = {
        **head, "class": f"org.apache.spark.ml.regression.{kind}", "uid": estimator.uid, "paramMap": given,
        "numFeatures": features, "numTrees": f["trees"],
    }
    kept = {k: v for k, v in given.items() if k in ("maxDepth", "minInstancesPerNode", "seed")}
    single = {**head, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": kept}
    weights = [1.0 if forest or t == 0 else f["rate"] for t in range(f["trees"])]
    trees = [(t, json.dumps({**single, "uid": f"{estimator.uid}_{t}"}), w) for t, w in enumerate(weights)]
    try:
        spark.range(0, len(parts), 1, len(parts)).mapInArrow(grown, NODES).write.parquet(f"{path}/data")
        small_frame(spark, [(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        small_frame(spark, trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        return (RandomForestRegressionModel if forest else GBTRegressionModel).load(path)
    finally:
        shared.destroy()
        discard(spark, path)
