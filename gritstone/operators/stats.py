"""Per-column statistics, each from one pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gritstone.functions.values import (
    as_text,
    is_email,
    is_moment,
    is_number,
    is_text,
    number_literal,
    numeric,
    parse_date,
    quote,
    strip,
    text_literal,
)
from gritstone.operators.normalize import normalize, types_of
from gritstone.operators.order_stats import quantiles
from gritstone.operators.per_column import per_column
from gritstone.runtime import small_frame

# A text column is a date or e-mail column above these match rates.
DATE_RATE = 0.8
EMAIL_RATE = 0.6
# Outlier fences lie this many inter-quartile ranges outside the quartiles.
FENCE_WIDTH = 1.5
QUARTILES = [0.25, 0.5, 0.75]
# A column is categorical up to this many values or this share of rows.
CATEGORY_VALUES = 20
CATEGORY_SHARE = 0.05


def measurable(df: DataFrame) -> list[str]:
    """Columns that can carry numeric statistics: numbers and text, not booleans."""
    return [f.name for f in df.schema.fields if is_number(f.dataType) or is_text(f.dataType)]


def readings(flat: DataFrame, names: list[str]) -> DataFrame:
    """The table with stripped texts and numeric readings, each evaluated once per cell.

    Adds ``text_<position>`` for text columns and ``number_<position>`` for every
    named column; see :func:`text_of` and :func:`number_of`.
    """
    types = types_of(flat)
    texts = [n for n in names if is_text(types[n])]
    base = flat.selectExpr("*", *[f"{strip(quote(n))} as {text_of(flat, n)}" for n in texts])
    numbers = []
    for n in names:
        cell = text_of(flat, n) if n in texts else quote(n)
        numbers.append(f"{numeric(cell, types[n], stripped=True)} as {number_of(flat, n)}")
    return base.selectExpr("*", *numbers)


def text_of(flat: DataFrame, name: str) -> str:
    return f"text_{flat.columns.index(name)}"


def number_of(flat: DataFrame, name: str) -> str:
    return f"number_{flat.columns.index(name)}"


def numeric_view(flat: DataFrame, names: list[str]) -> DataFrame:
    """The numeric reading of some columns under their own names."""
    base = readings(flat.select(*[quote(n) for n in names]), names)
    return base.selectExpr(*[f"number_{i} as {quote(n)}" for i, n in enumerate(names)])


def null_percentage(nulls: str, rows: str) -> str:
    return f"round(coalesce({nulls} * 100D / nullif({rows}, 0), 0D), 2)"


def null_stats(df: DataFrame) -> DataFrame:
    """(position, column, null_count, null_percentage)."""
    flat = normalize(df)
    counted = per_column(
        flat,
        flat.columns,
        {"row_count": lambda n: "count(*)", "null_count": lambda n: f"count_if({quote(n)} is null)"},
    )
    share = null_percentage("null_count", "row_count")
    return counted.selectExpr("position", "column", "null_count", f"{share} as null_percentage")


def missingness(df: DataFrame) -> DataFrame:
    """Columns by share of nulls, largest first."""
    return null_stats(df).orderBy("null_percentage", "position", ascending=[False, True])


def profile_shape(df: DataFrame) -> DataFrame:
    """(position, column, original_type, row_count, column_count)."""
    labels = ", ".join(text_literal(f.dataType.simpleString()) for f in df.schema.fields)
    names = ", ".join(text_literal(c) for c in df.columns)
    rows = df.selectExpr("count(*) as row_count")
    exploded = rows.selectExpr("row_count", f"posexplode(array({names})) as (position, column)")
    return exploded.selectExpr(
        "position",
        "column",
        f"array({labels})[position] as original_type",
        "row_count",
        f"cast({len(df.columns)} as bigint) as column_count",
    )


def min_max(df: DataFrame) -> DataFrame:
    """Smallest and largest value as text; numeric where any cell reads as a number."""
    flat = normalize(df)
    types = types_of(flat)
    texts = [n for n in flat.columns if is_text(types[n])]
    base = readings(flat, texts)

    def bound(pick: str):
        def build(name: str) -> str:
            native = as_text(f"{pick}({quote(name)})", types[name])
            if name not in texts:
                return native
            number = as_text(f"{pick}({number_of(flat, name)})", T.DoubleType())
            return f"coalesce({number}, {native})"

        return build

    return per_column(base, flat.columns, {"minimum": bound("min"), "maximum": bound("max")})


def corrected_skewness(v: str) -> str:
    """Bias-corrected skewness; 0 for a constant, null below 3 values."""
    n = f"cast(count({v}) as double)"
    return (
        f"case when {n} < 3 then null when var_samp({v}) = 0 then 0D"
        f" else skewness({v}) * sqrt({n} * ({n} - 1)) / ({n} - 2) end"
    )


def corrected_kurtosis(v: str) -> str:
    """Bias-corrected excess kurtosis; 0 for a constant, null below 4 values."""
    n = f"cast(count({v}) as double)"
    return (
        f"case when {n} < 4 then null when var_samp({v}) = 0 then 0D"
        f" else ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({v}) + 6) end"
    )


MOMENTS = {
    "numeric_count": lambda v: f"count({v})",
    "mean": lambda v: f"round(avg({v}), 4)",
    "std": lambda v: f"round(sqrt(var_samp({v})), 4)",
    "variance": lambda v: f"round(var_samp({v}), 4)",
    "skewness": lambda v: f"round({corrected_skewness(v)}, 4)",
    "kurtosis": lambda v: f"round({corrected_kurtosis(v)}, 4)",
}


def moment_rows(flat: DataFrame, names: list[str], extra: dict | None = None) -> DataFrame:
    numbers = numeric_view(flat, names)
    fields = {f: (lambda n, b=build: b(quote(n))) for f, build in {**MOMENTS, **(extra or {})}.items()}
    return per_column(numbers, names, fields, flat.columns)


def numeric_stats(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and shape of every column's numeric cells, 4 decimals."""
    flat = normalize(df)
    return moment_rows(flat, measurable(flat)).where("numeric_count > 0")


def quartile_values(
    flat: DataFrame, names: list[str], counts: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    numbers = numeric_view(flat, names) if names else flat
    return quantiles(numbers, {n: quote(n) for n in names}, QUARTILES, counts)


def quantile_table(df: DataFrame) -> DataFrame:
    """Exact quartiles of every column with numeric cells."""
    flat = normalize(df)
    values = quartile_values(flat, measurable(flat))
    rows = [
        (i, name, *values[name])
        for i, name in enumerate(flat.columns)
        if name in values and values[name][0] is not None
    ]
    return small_frame(
        df.sparkSession, rows, "position int, column string, q25 double, median double, q75 double"
    )


def fences(quartiles: dict[str, list[float | None]]) -> dict[str, tuple[float, float]]:
    """Outlier fences of columns whose inter-quartile range is positive."""
    limits = {}
    for name, (q1, _, q3) in quartiles.items():
        if q1 is not None and q3 - q1 > 0:
            width = FENCE_WIDTH * (q3 - q1)
            limits[name] = (q1 - width, q3 + width)
    return limits


def outside(cell: str, limits: tuple[float, float]) -> str:
    low, high = map(number_literal, limits)
    return f"({cell} < {low} or {cell} > {high})"


def outlier_rows(flat: DataFrame, names: list[str], limits: dict) -> DataFrame:
    numbers = numeric_view(flat, names)

    def build(name: str) -> str:
        if name not in limits:
            return "count(null)"
        return f"count_if({outside(quote(name), limits[name])})"

    return per_column(numbers, names, {"outlier_count": build}, flat.columns)


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells strictly outside the fences, per column with numeric cells."""
    flat = normalize(df)
    quartiles = quartile_values(flat, measurable(flat) if columns is None else columns)
    known = [n for n, q in quartiles.items() if q[0] is not None]
    if not known:
        return small_frame(df.sparkSession, [], "position int, column string, outlier_count bigint")
    return outlier_rows(flat, known, fences(quartiles))


def match_fields(flat: DataFrame) -> dict:
    """Counts of text cells that read as dates and as e-mails, over :func:`readings`."""
    types = types_of(flat)

    def counted(test):
        return lambda n: f"count_if({test(text_of(flat, n))})" if is_text(types[n]) else "count(null)"

    return {
        "date_count": counted(lambda c: f"{parse_date(c, stripped=True)} is not null"),
        "email_count": counted(lambda c: is_email(c, stripped=True)),
    }


def logical_type(
    dtype: T.DataType, rows: int, filled: int, dates: int, emails: int, distinct: int
) -> str:
    """Logical type of a column from whole-column match rates."""
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return "numeric"
    if is_moment(dtype):
        return "datetime"
    if filled and dates / filled > DATE_RATE:
        return "datetime"
    if filled and emails / filled > EMAIL_RATE:
        return "email"
    return "categorical" if distinct <= max(CATEGORY_VALUES, rows * CATEGORY_SHARE) else "string"


def cell_bytes(df: DataFrame) -> str:
    """Bytes of one row: fixed width per typed cell, encoded length per text."""
    sizes = [
        f"coalesce(octet_length({quote(f.name)}), 0)" if is_text(f.dataType) else str(_width(f.dataType))
        for f in df.schema.fields
    ]
    return f"cast({' + '.join(sizes)} as bigint)"


def byte_size(df: DataFrame) -> DataFrame:
    flat = normalize(df)
    return flat.selectExpr(f"coalesce(sum({cell_bytes(flat)}), 0) as byte_size")


def _width(dtype: T.DataType) -> int:
    if isinstance(dtype, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dtype, T.ShortType):
        return 2
    if isinstance(dtype, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    return 16 if isinstance(dtype, T.DecimalType) else 8
