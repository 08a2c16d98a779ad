"""Whole-row measures: duplicates, empty rows, fingerprint, sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gritstone.functions.values import as_text, is_text, quote
from gritstone.operators.normalize import normalize

# Texts longer than this are compared by their SHA-256 digest (64 characters).
DIGEST_ABOVE = 48


def row_copies(df: DataFrame) -> DataFrame:
    """(k0..., count) per distinct row; long texts travel as digests."""
    flat = normalize(df)
    keys = []
    for i, field in enumerate(flat.schema.fields):
        cell = quote(field.name)
        if is_text(field.dataType):
            cell = f"if(length({cell}) > {DIGEST_ABOVE}, sha2({cell}, 256), {cell})"
        keys.append(f"{cell} as k{i}")
    keyed = flat.selectExpr(*keys)
    return keyed.groupBy(*keyed.columns).count()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, as (duplicate_rows).

    Copies are combined before the shuffle, so a row repeated a billion times
    leaves each task once.
    """
    return row_copies(df).selectExpr("cast(coalesce(sum(count - 1), 0) as bigint) as duplicate_rows")


def all_null(df: DataFrame) -> str:
    return " and ".join(f"{quote(c)} is null" for c in df.columns)


def empty_row_count(df: DataFrame) -> DataFrame:
    """Rows in which every cell is null, as (empty_rows)."""
    flat = normalize(df)
    return flat.selectExpr(f"count_if({all_null(flat)}) as empty_rows")


def row_text(df: DataFrame) -> str:
    cells = [
        f"coalesce({as_text(quote(f.name), f.dataType)}, '\\u0000')" for f in df.schema.fields
    ]
    return f"concat_ws('\\u001f', {', '.join(cells)})"


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count and the sum of 48-bit row hashes."""
    flat = normalize(df)
    texts = flat.selectExpr(f"{row_text(flat)} as line")
    hashes = texts.selectExpr("cast(conv(left(md5(line), 12), 16, 10) as bigint) as hash")
    # Halves add up in 64 bits for 2^39 rows; decimals are far slower to add.
    sums = hashes.selectExpr(
        "count(*) as n", "coalesce(sum(shiftright(hash, 24)), 0) as high", f"coalesce(sum(hash & {(1 << 24) - 1}), 0) as low"
    )
    total = f"cast(high as decimal(20,0)) * {1 << 24} + cast(low as decimal(20,0))"
    return sums.selectExpr(f"concat(cast(n as string), '-', cast({total} as string)) as fingerprint")


def sample_rows(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows under an explicit order (all columns by default)."""
    flat = normalize(df)
    return flat.orderBy(*[quote(c) for c in order_by or flat.columns]).limit(n)
