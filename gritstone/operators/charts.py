"""Data behind charts: saved charts and exploratory plots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.values import as_text, number_literal, quote, stable_hash
from gritstone.operators import frequency, stats
from gritstone.operators.aggregate import query
from gritstone.operators.correlation import correlation
from gritstone.operators.distribution import histograms
from gritstone.operators.filters import Filter
from gritstone.operators.normalize import normalize, numeric_columns, text_columns, types_of
from gritstone.operators.order_stats import quantiles
from gritstone.operators.per_column import per_column
from gritstone.runtime import small_frame

# Bins of a plot and the values that make a column small. Limits are parameters and off by default;
# usual ones are 30 bars, 100 heatmap cells, 100 chart rows (200 in a preview), 8 plots, 8 slices, 6 boxes, 300 pairs.
PLOT_BINS = 24
SHARE_VALUES = 12
QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


@dataclass(frozen=True)
class ChartConfig:
    """What a saved chart shows."""

    chart_type: str
    x_field: str | None = None
    y_field: str | None = None
    groupby: list[str] = field(default_factory=list)
    agg: str = "count"
    filters: list[Filter] = field(default_factory=list)
    title: str = ""


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def chart_missingness(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(column, value): columns by falling share of nulls."""
    return _first(stats.missingness(df), limit).selectExpr("column", "null_percentage as value")


def chart_heatmap(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(x, y, value): known correlations in column order."""
    cells = correlation(df, "pearson").orderBy("x_position", "y_position")
    return _first(cells.where("value is not null"), limit).select("x", "y", "value")


def chart_data(df: DataFrame, chart: ChartConfig, preview: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of a chart. A preview of a histogram, or without a value, counts."""
    if chart.chart_type == "missingness":
        return chart_missingness(df, limit)
    if chart.chart_type == "heatmap":
        return chart_heatmap(df, limit)
    groups = list(chart.groupby) or ([chart.x_field] if chart.x_field else [])
    agg, value = chart.agg, chart.y_field
    if preview and (chart.chart_type == "histogram" or not chart.y_field):
        agg, value = "count", None
    return query(df, groups, agg, value, list(chart.filters), limit)


def eda_hist(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Histograms with 24 bins of the numeric columns, or of the first few."""
    return histograms(df, bins=PLOT_BINS, limit=columns)


def eda_share(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Groups by falling size of the first text column, else of the last small column, else quartiles."""
    flat = normalize(df)
    texts = text_columns(flat)
    chosen = texts[0] if texts else None
    if chosen is None:
        values = frequency.values_up_to(flat, flat.columns, SHARE_VALUES)  # an estimate rules out the others
        small = [c for c in flat.columns if len(values.get(c, {})) > 1]
        if not small:
            return eda_quartile(flat)
        chosen = small[-1]
    label = f"coalesce({as_text(quote(chosen), types_of(flat)[chosen])}, 'nan') as label"
    grouped = flat.selectExpr(label).groupBy("label").count()
    return _first(grouped.orderBy(F.col("count").desc(), "label"), slices)


def eda_quartile(df: DataFrame, column: str | None = None) -> DataFrame:
    """(bucket, low, high, count): rows per quartile interval, lowest edge included."""
    flat = normalize(df)
    name = column or numeric_columns(flat)[0]
    cell = f"cast({quote(name)} as double)"
    edges = sorted(set(quantiles(flat, {name: cell}, QUARTERS)[name]))
    if len(edges) < 2:
        edges = [edges[0], edges[0]] if edges else [0.0, 0.0]
    tests = " ".join(f"when {cell} <= {number_literal(high)} then {i}" for i, high in enumerate(edges[1:]))
    bounds = small_frame(
        df.sparkSession,
        [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)],
        "bucket int, low double, high double",
    )
    counted = flat.selectExpr(f"case {tests} end as bucket").where("bucket is not null").groupBy("bucket").count()
    return bounds.join(counted, "bucket").select("bucket", "low", "high", "count")


def eda_scatter(df: DataFrame) -> DataFrame:
    """(x, y, hue): the first two numeric columns, coloured by the first text column."""
    numbers, texts = numeric_columns(df), text_columns(df)
    if len(numbers) < 2:
        raise ValueError("A scatter plot needs two numeric columns.")
    hue = quote(texts[0]) if texts else "cast(null as string)"
    return normalize(df).selectExpr(f"{quote(numbers[0])} as x", f"{quote(numbers[1])} as y", f"{hue} as hue")


def eda_box(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Five-number summary of the numeric columns, or of the first few."""
    flat = normalize(df)
    names = numeric_columns(flat)[:columns]
    ends = per_column(
        flat,
        names,
        {
            "n": lambda c: f"count({quote(c)})",
            "low": lambda c: f"cast(min({quote(c)}) as double)",
            "high": lambda c: f"cast(max({quote(c)}) as double)",
        },
    ).collect()
    counts = {r.column: r.n for r in ends}
    quartiles = quantiles(flat, {c: f"cast({quote(c)} as double)" for c in names}, stats.QUARTILES, counts)
    rows = [(r.column, r.n, r.low, *quartiles[r.column], r.high) for r in ends if r.n]
    return small_frame(
        df.sparkSession,
        rows,
        "feature string, n bigint, minimum double, q25 double, median double, q75 double, maximum double",
    )


def eda_pairs(
    df: DataFrame, key: list[str] | None = None, rows: int | None = None, columns: int | None = None
) -> DataFrame:
    """Numeric columns, all or the first few; all rows, or the ``rows`` ones with the smallest seeded hash."""
    flat = normalize(df)
    names = numeric_columns(flat)[:columns]
    if rows is None:
        return flat.selectExpr(*[quote(c) for c in names])
    place = stable_hash("'42'", *[quote(k) for k in (key or flat.columns)])
    ordered = flat.selectExpr(*[quote(c) for c in names], f"{place} as __place").orderBy("__place")
    return ordered.limit(rows).drop("__place")


def eda_missing(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(column, missing): columns by falling number of missing cells."""
    counted = _first(stats.null_stats(df).orderBy(F.col("null_count").desc(), "position"), limit)
    return counted.selectExpr("column", "null_count as missing")
