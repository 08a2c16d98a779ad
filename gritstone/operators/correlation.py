"""Pearson, Spearman and covariance matrices in long form (x, y, value)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.values import quote
from gritstone.operators.distribution import average_ranks
from gritstone.operators.gramian import gramian
from gritstone.operators.normalize import normalize, numeric_columns
from gritstone.runtime import materialize, small_frame

MATRIX_SCHEMA = "x_position int, y_position int, x string, y string, value double"
# A variance below this share of the squared mean is rounding noise of a constant column.
NOISE = 1e-20
# A value that fills one in so many rows is looked up in a small table instead of being shuffled.
HOT_SHARE = 1_000
# Values, of all rankings together, whose ranks every task holds to look them up; rankings of few values come first.
KNOWN_VALUES = 500_000
# Rankings up to which the ranks of a row are gathered in a column each, not in a list.
GATHERED_COLUMNS = 64


def pair_moments(flat: DataFrame, names: list[str]) -> dict[tuple[int, int], tuple]:
    """(n, cov_pop, var_x, var_y) of every pair over its complete rows, from one scan."""
    sums = gramian(flat.selectExpr(*[f"cast({quote(n)} as double) as v{i}" for i, n in enumerate(names)]), len(names))
    moments = {}
    for i in range(len(names)):
        for j in range(i, len(names)):
            n = int(sums.n[i, j])
            if n == 0:
                moments[i, j] = (0, None, None, None)
                continue
            mx, my = sums.first[i, j] / n, sums.first[j, i] / n
            variances = (sums.second[i, j] / n - mx * mx, sums.second[j, i] / n - my * my)
            quiet = [0.0 if v <= NOISE * sums.shift[k] ** 2 else float(v) for v, k in zip(variances, (i, j))]
            moments[i, j] = (n, float(sums.product[i, j] / n - mx * my), *quiet)
    return moments


def _matrix(df: DataFrame, names: list[str], values: dict[tuple[int, int], float | None]) -> DataFrame:
    position = {n: i for i, n in enumerate(df.columns)}
    rows = []
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            value = values[(min(i, j), max(i, j))]
            kept = None if value is None or not math.isfinite(value) else round(value, 4)
            rows.append((position[x], position[y], x, y, kept))
    return small_frame(df.sparkSession, rows, MATRIX_SCHEMA)


def _ratio(cov: float | None, vx: float | None, vy: float | None) -> float | None:
    if cov is None or vx <= 0 or vy <= 0:
        return None
    return max(-1.0, min(1.0, cov / math.sqrt(vx * vy)))


def correlation(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None
) -> DataFrame:
    """Matrix over numeric columns, pairwise complete; empty below two columns."""
    if method not in {"pearson", "spearman", "cov"}:
        raise ValueError(f"Unsupported method '{method}'.")
    flat = normalize(df)
    names = numeric_columns(flat) if columns is None else columns
    if len(names) < 2:
        return small_frame(df.sparkSession, [], MATRIX_SCHEMA)
    if method == "spearman":
        return _matrix(flat, names, _spearman(flat, names))
    values: dict[tuple[int, int], float | None] = {}
    for pair, (n, cov, vx, vy) in pair_moments(flat, names).items():
        if method == "pearson":
            values[pair] = _ratio(cov, vx, vy)
        else:
            values[pair] = cov * n / (n - 1) if n > 1 else None
    return _matrix(flat, names, values)


def _masks(n: np.ndarray) -> dict[tuple[int, int], int]:
    """Number of the ranking of column i among the rows that column j fills as well, for every pair.

    Columns with equal null patterns share their rankings: where j fills all rows of i, it is that of i alone.
    """
    size = len(n)
    alike = {j: next(k for k in range(size) if n[j, k] == n[j, j] == n[k, k]) for j in range(size)}
    numbers: dict[tuple[int, int], int] = {}
    return {(i, j): numbers.setdefault((i, i if n[i, j] == n[i, i] else alike[j]), len(numbers)) for i in range(size) for j in range(size)}


def _filled_pairs(rows: DataFrame, size: int) -> np.ndarray:
    """Rows that both columns of a pair fill; only pairs of columns with gaps need products."""
    total, *counts = rows.agg(F.count(F.lit(1)), *[F.count(f"v{i}") for i in range(size)]).first()
    n = np.minimum.outer(counts, counts).astype(np.float64)
    gaps = [i for i in range(size) if counts[i] < total]
    if len(gaps) > 1:
        n[np.ix_(gaps, gaps)] = gramian(rows.select(*[f"v{i}" for i in gaps]), len(gaps)).n
    return n


def _gathered(rows: DataFrame, placed: DataFrame, many: list[int]) -> DataFrame:
    """The rows with the ranks (``id, cell, rank``) that were joined: ``r<cell>`` for each ranking, or lists of ``cells`` and ``ranks``."""
    names = [c for c in rows.columns if c != "id"]
    if len(many) > GATHERED_COLUMNS:
        lists = placed.groupBy("id").agg(F.collect_list("cell").alias("cells"), F.collect_list("rank").alias("ranks"))
        joined = rows.join(lists, "id", "left")
        return joined.select(*names, F.coalesce("cells", F.array().cast("array<int>")).alias("cells"), F.coalesce("ranks", F.array().cast("array<double>")).alias("ranks"))
    columns = [F.when(F.col("cell") == c, F.col("rank")).alias(f"r{c}") for c in many]
    both = rows.unionByName(placed.select("id", *columns), allowMissingColumns=True)
    # Sent by row first, so that nothing is grouped before the shuffle, where a row's cells are apart.
    return both.repartition("id").groupBy("id").agg(*[F.max(c).alias(c) for c in both.columns if c != "id"]).drop("id")


def _spearman(flat: DataFrame, names: list[str]) -> dict[tuple[int, int], float | None]:
    """Pearson correlation of average ranks over the rows that both columns of a pair fill.

    All rankings are made in one long table of cells, which is counted by value and ranked by range. Tasks look up
    the ranks of rankings with few values, and of hot values, where they read the rows; only the other cells are
    joined with their ranks and gathered by row again. Jobs do not grow with the columns or their pairs.
    """
    size = len(names)
    numbered = flat.select(F.monotonically_increasing_id().alias("id"), *[F.expr(f"cast({quote(n)} as double)").alias(f"v{i}") for i, n in enumerate(names)])
    rows = materialize(numbered)
    values: dict[tuple[int, int], float | None] = {(i, j): None for i in range(size) for j in range(i, size)}
    n = _filled_pairs(rows, size)
    masks = _masks(n)
    cells = {cell: pair for pair, cell in reversed(masks.items())}
    made = {
        cell: F.when(F.col(f"v{j}").isNotNull(), F.struct(F.lit(cell).alias("cell"), F.col(f"v{i}").alias("value")))
        for cell, (i, j) in sorted(cells.items())
    }

    def cells_of(chosen: list[int]) -> DataFrame:
        exploded = rows.select("id", F.explode(F.array(*[made[c] for c in chosen])).alias("c"))
        return exploded.where("c.value is not null").select("id", "c.cell", "c.value")

    counted = cells_of(list(made)).groupBy("cell", "value").agg(F.count("*").alias("n"))
    ranks = materialize(average_ranks(counted, "cell"))
    few, held = [], 0
    distinct = {r.cell: r["count"] for r in ranks.groupBy("cell").count().collect()}
    for cell in sorted(distinct, key=distinct.get):
        held += distinct[cell]
        if held > KNOWN_VALUES:
            break
        few.append(cell)
    many = sorted(distinct.keys() - few)
    # At most HOT_SHARE values of a ranking are hot; the others are shuffled evenly.
    total = {cell: int(n[i, j]) for cell, (i, j) in cells.items()}
    of_cell = F.element_at(F.array(*[F.lit(total[c]) for c in range(len(cells))]), F.col("cell") + 1)
    hot = ranks.where(F.col("cell").isin(many) & (F.col("n") * HOT_SHARE >= of_cell))
    known = ranks.where(F.col("cell").isin(few)).unionByName(hot).select("cell", "value", "rank").toArrow()
    of_known = {name: known.column(name).to_numpy() for name in known.column_names}
    order = np.lexsort((of_known["value"], of_known["cell"]))
    of_known = {name: column[order] for name, column in of_known.items()}
    tables = {}
    for cell in distinct:
        own = slice(*np.searchsorted(of_known["cell"], [cell, cell + 1]))
        tables[cell] = (of_known["value"][own], of_known["rank"][own])
    base = rows.drop("id")
    if many:
        cold = cells_of(many).join(F.broadcast(hot.select("cell", "value")), ["cell", "value"], "left_anti")
        placed = cold.join(ranks.where(F.col("cell").isin(many)).select("cell", "value", "rank"), ["cell", "value"])
        base = _gathered(rows, placed, many)
    width = len(cells)

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((batch.num_rows, width), np.nan)
        columns = [batch.column(f"v{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(size)]
        for cell, (values_of, ranks_of) in tables.items():
            if len(values_of):
                i, j = cells[cell]
                at = np.minimum(np.searchsorted(values_of, columns[i]), len(values_of) - 1)
                hit = (values_of[at] == columns[i]) & ~np.isnan(columns[j])
                out[hit, cell] = ranks_of[at[hit]]
        if many and "cells" in batch.schema.names:
            lists = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            out[row, lists.flatten().to_numpy()] = batch.column("ranks").flatten().to_numpy()
        elif many:
            for cell in many:
                rank = batch.column(f"r{cell}").to_numpy(zero_copy_only=False).astype(np.float64)
                out[:, cell] = np.where(np.isnan(rank), out[:, cell], rank)
        return out

    sums = gramian(base, width, dense)
    for i in range(size):
        for j in range(i, size):
            a, b = masks[i, j], masks[j, i]
            if n[i, j]:
                # Both rankings cover the same rows, so each is centred on its own mean.
                value = _ratio(sums.product[a, b], sums.second[a, a], sums.second[b, b])
                values[i, j] = None if value is None else float(value)
    return values
