"""Filtered group-by queries over one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.values import numeric, quote, text_literal
from gritstone.operators.filters import Filter, apply_filters
from gritstone.operators.normalize import normalize, require_columns, types_of

AGGREGATIONS = {"count": "count", "sum": "sum", "mean": "avg", "min": "min", "max": "max"}


def _aggregate(agg: str, cell: str) -> str:
    """The sum of nothing is zero; other aggregates of nothing are null."""
    return f"coalesce(sum({cell}), 0D)" if agg == "sum" else f"{AGGREGATIONS[agg]}({cell})"


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(max(int(limit), 1))


def query(
    df: DataFrame,
    groupby: list[str] | None = None,
    agg: str = "count",
    value_field: str | None = None,
    filters: list[Filter] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Group, aggregate and order by falling value; keep the first ``limit`` if given (say 500).

    Null group keys form a group. Result: the group columns and ``value``, or
    (metric, value) without grouping, or the first rows when neither applies.
    """
    groups = [g for g in groupby or [] if g]
    require_columns(df, groups + ([value_field] if value_field else []))
    if agg not in AGGREGATIONS:
        raise ValueError(f"No aggregate is called '{agg}'; choose from {', '.join(AGGREGATIONS)}.")
    kept = apply_filters(df, filters or [])
    if not groups and agg != "count" and not value_field:
        flat = normalize(kept)
        return _first(flat.orderBy(*[quote(c) for c in flat.columns]), limit)
    if agg == "count":
        measure = "count(*)"
    elif not value_field:
        raise ValueError(f"The aggregate '{agg}' needs a value_field.")
    else:
        measure = _aggregate(agg, numeric(quote(value_field), types_of(df)[value_field]))
    if not groups:
        metric = "count" if agg == "count" else f"{agg}_{value_field}"
        return kept.selectExpr(f"{text_literal(metric)} as metric", f"{measure} as value")
    keys = list(dict.fromkeys(groups))
    grouped = normalize(kept).groupBy(*[quote(k) for k in keys]).agg(F.expr(measure).alias("value"))
    order = [F.col("value").desc_nulls_last(), *[F.col(quote(k)) for k in keys]]
    return _first(grouped.orderBy(*order), limit)
