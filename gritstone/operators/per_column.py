"""Whole-table aggregates reported as one row per column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from gritstone.functions.values import quote, text_literal
from gritstone.runtime import chunks

# Generated code holds about 100 aggregation buffers; four per measure is typical.
MEASURES_PER_PASS = 24


def per_column(
    df: DataFrame,
    names: list[str],
    fields: dict[str, Callable[[str], str]],
    order: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Aggregate every named column and report (position, column, fields...).

    ``fields`` maps an output field to a function from column name to SQL
    aggregate. The passes over a wide table read disjoint columns, so a columnar
    source still reads every column only once.
    """
    positions = {name: i for i, name in enumerate(order or df.columns)}
    parts = []
    for chunk in chunks(names, width or max(1, MEASURES_PER_PASS // len(fields))):
        wide = df.selectExpr(
            *[
                f"{build(name)} as {field}_{i}"
                for i, name in enumerate(chunk)
                for field, build in fields.items()
            ]
        )
        rows = ", ".join(
            f"named_struct('position', {positions[name]}, 'column', {text_literal(name)}, "
            + ", ".join(f"'{field}', {field}_{i}" for field in fields)
            + ")"
            for i, name in enumerate(chunk)
        )
        parts.append(wide.selectExpr(f"inline(array({rows}))"))
    return reduce(DataFrame.unionByName, parts)


