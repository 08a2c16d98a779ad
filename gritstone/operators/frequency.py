"""Value frequencies of all columns, one shuffle per data type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gritstone.functions.values import as_text, is_number, quote, text_literal
from gritstone.operators.long_text import SHOWN, Pick, by_count, has_text, key_of, native, pick
from gritstone.operators.normalize import normalize
from gritstone.operators.per_column import per_column
from gritstone.runtime import small_frame

# Distinct-count estimates evaluated together.
ESTIMATES_PER_PASS = 50

MODE = Pick("mode", 1, "n desc, real, whole, ", native)
# Ascending native order of one column's values within a frequency table.
NATIVE_ORDER = "real, whole, value"


def _family(dtype: T.DataType) -> T.DataType:
    """Columns of one family share a shuffle; whole numbers share 64 bits."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    return T.StringType() if isinstance(dtype, (T.CharType, T.VarcharType)) else dtype


def frequency_table(df: DataFrame, columns: list[str] | None = None, keyed: bool = True) -> DataFrame:
    """Long table (position, column, value, whole, real, n, hashed) of non-null values.

    Cells are counted in their own type and only distinct values become text. Unless ``keyed`` is off, a long text is
    counted by its key, see ``long_text``; such rows are ``hashed``.
    Counts are combined before the shuffle, so a value that fills a third of the
    rows leaves each task as one record. ``real`` and ``whole`` carry the native
    sort order of numbers.
    """
    df = normalize(df)
    names = df.columns if columns is None else columns
    if not names:
        return small_frame(
            df.sparkSession,
            [],
            "position int, column string, value string, whole bigint, real double, n bigint, hashed boolean",
        )
    position = {name: i for i, name in enumerate(df.columns)}
    families: dict[T.DataType, list[str]] = {}
    for field in df.schema.fields:
        if field.name in names:
            families.setdefault(_family(field.dataType), []).append(field.name)
    parts = []
    for dtype, members in families.items():
        kind = dtype.simpleString()
        whole = "cell" if isinstance(dtype, T.LongType) else "null"
        real = "cell" if is_number(dtype) and not isinstance(dtype, T.LongType) else "null"
        wide = df.selectExpr(*[f"cast({quote(n)} as {kind}) as `{position[n]}`" for n in members])
        cells = wide.unpivot([], wide.columns, "key", "cell")
        short = keyed and isinstance(dtype, T.StringType)
        if short:
            cells = cells.selectExpr("key", f"{key_of('cell')} as cell")
        counted = cells.where("cell is not null").groupBy("key", "cell").count()
        label = " ".join(f"when '{position[n]}' then {text_literal(n)}" for n in members)
        parts.append(
            counted.selectExpr(
                "cast(key as int) as position",
                f"case key {label} end as column",
                f"{as_text('cell', dtype)} as value",
                f"cast({whole} as bigint) as whole",
                f"cast({real} as double) as real",
                "count as n",
                f"length(cell) > {SHOWN} as hashed" if short else "false as hashed",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def top_pick(k: int) -> Pick:
    return Pick("top", k, "n desc, ", by_count)


def rare_pick(k: int) -> Pick:
    return Pick("rare", k, where="n = 1")


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """Distinct non-null values per column, exact unless ``approx``."""
    names = df.columns if columns is None else columns
    if approx:
        estimate = {"distinct_count": lambda n: f"approx_count_distinct({quote(n)})"}
        return per_column(normalize(df), names, estimate)
    return distinct_from(frequency_table(df, names), df, names)


def near_distinct(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Estimated distinct counts (2 % error) from one pass without a shuffle of values."""
    counts: dict[str, int] = {}
    for start in range(0, len(names), ESTIMATES_PER_PASS):
        chunk = names[start : start + ESTIMATES_PER_PASS]
        row = df.selectExpr(
            *[f"approx_count_distinct({quote(c)}, 0.02) as c{i}" for i, c in enumerate(chunk)]
        ).first()
        counts.update({c: row[f"c{i}"] for i, c in enumerate(chunk)})
    return counts


def values_up_to(df: DataFrame, columns: list[str], limit: int) -> dict[str, dict[str, int]]:
    """Sorted values with their counts, for the columns that hold at most ``limit`` of them.

    An estimate rules out columns that hold far more, so near-unique text is
    never shuffled; the rest is counted exactly.
    """
    if not columns:
        return {}
    estimates = near_distinct(df, columns)
    likely = [c for c in columns if estimates[c] <= 2 * limit + 50]
    values: dict[str, dict[str, int]] = {c: {} for c in likely}
    if likely:
        for _, column, _, value, n in pick(df, frequency_table(df, likely), [Pick("few", limit + 1)])["few"]:
            values[column][value] = n
    return {c: v for c, v in values.items() if len(v) <= limit}


def column_list(df: DataFrame, names: list[str]) -> DataFrame:
    """(position, column) metadata rows."""
    position = {name: i for i, name in enumerate(df.columns)}
    return small_frame(
        df.sparkSession, [(position[n], n) for n in names], "position int, column string"
    )


def distinct_from(freq: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct counts of ``names`` from a frequency table; 0 for empty columns."""
    listed = column_list(df, names).selectExpr("position", "column", "cast(0 as bigint) as one")
    counted = freq.selectExpr("position", "column", "cast(1 as bigint) as one")
    return (
        listed.unionByName(counted)
        .groupBy("position", "column")
        .sum("one")
        .withColumnRenamed("sum(one)", "distinct_count")
    )


def modes(
    df: DataFrame, columns: list[str] | None = None, freq: DataFrame | None = None
) -> DataFrame:
    """Most frequent value per column; the smallest in native order among ties."""
    freq = frequency_table(df, columns) if freq is None else freq
    if has_text(df, columns or df.columns):
        rows = [(p, c, value, n) for p, c, _, value, n in pick(df, freq, [MODE])["mode"]]
        return small_frame(df.sparkSession, rows, "position int, column string, mode string, mode_count bigint")
    ranked = freq.selectExpr("position", "column", f"struct(-n as rank, {NATIVE_ORDER}) as entry")
    best = ranked.groupBy("position", "column").agg({"entry": "min"})
    return best.selectExpr(
        "position", "column", "`min(entry)`.value as mode", "-`min(entry)`.rank as mode_count"
    )


def ranked_values(freq: DataFrame, k: int, order: str) -> DataFrame:
    """First ``k`` rows per column; each task keeps only ``k`` before the shuffle."""
    window = f"row_number() over (partition by position order by {order}) as rank"
    return freq.selectExpr("*", window).where(f"rank <= {k}")


def top_values(
    df: DataFrame, k: int = 8, columns: list[str] | None = None, freq: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value."""
    freq = frequency_table(df, columns) if freq is None else freq
    if has_text(df, columns or df.columns):
        found = pick(df, freq, [top_pick(k)])["top"]
        return small_frame(df.sparkSession, found, "position int, column string, rank int, value string, n bigint")
    top = ranked_values(freq, k, "n desc, value")
    return top.select("position", "column", "rank", "value", "n")


def rare_values(
    df: DataFrame, k: int = 8, columns: list[str] | None = None, freq: DataFrame | None = None
) -> DataFrame:
    """Up to ``k`` values per column that occur exactly once, smallest first."""
    freq = frequency_table(df, columns) if freq is None else freq
    if has_text(df, columns or df.columns):
        found = [row[:4] for row in pick(df, freq, [rare_pick(k)])["rare"]]
        return small_frame(df.sparkSession, found, "position int, column string, rank int, value string")
    return ranked_values(freq.where("n = 1"), k, "value").select("position", "column", "rank", "value")
