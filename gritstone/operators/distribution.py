"""Histograms and exact ranks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.values import number_literal as lit
from gritstone.functions.values import quote
from gritstone.operators.normalize import normalize, numeric_columns
from gritstone.operators.per_column import per_column
from gritstone.runtime import chunks, reliable_checkpoint, small_frame

HISTOGRAM_SCHEMA = (
    "position int, column string, bin int, label string, low double, high double, count bigint"
)
COLUMNS_PER_PASS = 4


def default_bins(n: int) -> int:
    return min(12, max(4, math.isqrt(n)))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def bin_guess(cell: str, low: float, high: float, bins: int) -> str:
    return f"least(cast(floor(({cell} - {lit(low)}) / {lit((high - low) / bins)}) as int), {bins - 1})"


def bin_index(cell: str, guess: str, low: float, high: float, bins: int) -> str:
    """Bin of a value among edges ``low + i * step``, corrected from a guess; the last bin is closed."""
    step = lit((high - low) / bins)
    start = lit(low)
    # least() skips nulls, so a missing cell has to be kept out of the last bin.
    return (
        f"if({cell} is null, null, {guess} - if({cell} < {start} + {guess} * {step}, 1, 0)"
        f" + if({cell} >= {start} + ({guess} + 1) * {step} and {guess} < {bins - 1}, 1, 0))"
    )


def ranges(flat: DataFrame, names: list[str]) -> list:
    """(position, column, n, low, high) of numeric columns."""
    measured = per_column(
        flat,
        names,
        {
            "n": lambda c: f"count({quote(c)})",
            "low": lambda c: f"cast(min({quote(c)}) as double)",
            "high": lambda c: f"cast(max({quote(c)}) as double)",
        },
    )
    return sorted(measured.collect(), key=lambda r: r.position)


def histograms(
    df: DataFrame, columns: list[str] | None = None, bins: int | None = None, limit: int | None = None
) -> DataFrame:
    """Equal-width histogram of the numeric columns; of the first ``limit`` if given (say 8)."""
    flat = normalize(df)
    names = (numeric_columns(flat) if columns is None else columns)[:limit]
    if not names:
        return small_frame(df.sparkSession, [], HISTOGRAM_SCHEMA)
    return small_frame(df.sparkSession, histogram_rows(flat, ranges(flat, names), bins), HISTOGRAM_SCHEMA)


def histogram_rows(flat: DataFrame, measured: list, bins: int | None = None) -> list[tuple]:
    """Histogram rows for known column ranges from one job."""
    measured = [r for r in measured if r.n]
    sizes = {
        r.position: bins or default_bins(r.n)
        for r in measured
        if math.isfinite(r.low) and math.isfinite(r.high) and r.low < r.high
    }
    counts: dict[tuple[int, int], int] = {}
    parts = []
    for chunk in chunks([r for r in measured if r.position in sizes], COLUMNS_PER_PASS):
        # Cells and guesses are columns of their own, so that generated code holds each once.
        cells = flat.selectExpr(*[f"cast({quote(r.column)} as double) as c{r.position}" for r in chunk])
        guessed = cells.selectExpr("*", *[f"{bin_guess(f'c{r.position}', r.low, r.high, sizes[r.position])} as g{r.position}" for r in chunk])
        wide = guessed.selectExpr(
            *[f"{bin_index(f'c{r.position}', f'g{r.position}', r.low, r.high, sizes[r.position])} as `{r.position}`" for r in chunk]
        )
        cells = wide.unpivot([], wide.columns, "key", "bin")
        parts.append(cells.where("bin is not null").groupBy("key", "bin").count())
    if parts:
        for row in reduce(DataFrame.union, parts).collect():
            counts[(int(row["key"]), row["bin"])] = row["count"]
    rows = []
    for r in measured:
        if r.position not in sizes:
            rows.append((r.position, r.column, 0, str(round(r.low, 4)), r.low, r.high, r.n))
            continue
        cuts = bin_edges(r.low, r.high, sizes[r.position])
        for i in range(len(cuts) - 1):
            label = f"{cuts[i]:.3g}-{cuts[i + 1]:.3g}"
            n = counts.get((r.position, i), 0)
            rows.append((r.position, r.column, i, label, cuts[i], cuts[i + 1], n))
    return rows


def average_ranks(counted: DataFrame, by: str | None = None) -> DataFrame:
    """Add ``rank``, the average rank of each value, to a table (value, n) or, for each ``by``, (by, value, n).

    Values are range partitioned and written to reliable storage; each part then
    ranks its own values and adds the total of the parts before it.
    """
    keys = [by] if by else []
    ordered = counted.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id())
    fixed = reliable_checkpoint(ordered)
    group = f"partition by {by} " if by else ""
    before = f"sum(total) over ({group}order by part rows between unbounded preceding and 1 preceding)"
    totals = fixed.groupBy(*keys, "part").agg(F.sum("n").alias("total"))
    # At most one row per range partition and key, so this side is as small as the partition count.
    offsets = totals.selectExpr(*keys, "part", f"coalesce({before}, 0) as offset")
    placed = fixed.selectExpr("*", f"sum(n) over (partition by {', '.join([*keys, 'part'])} order by value) as running")
    joined = placed.join(F.broadcast(offsets), [*keys, "part"])
    return joined.selectExpr(*keys, "value", "n", "running + offset - (n - 1) / 2D as rank")
