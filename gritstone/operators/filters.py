"""Row filters as column predicates, so they reach the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gritstone.functions.values import as_text, is_number, is_text, number_literal, numeric, quote, text_literal
from gritstone.operators.normalize import require_columns, types_of
from gritstone.operators.plan_guard import check_condition

COMPARISONS = {"=": "=", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


@dataclass(frozen=True)
class Filter:
    """One condition: column, operator and literal."""

    column: str
    operator: str
    value: Any = None


def literal_number(value: Any) -> float | None:
    """The number a literal spells, if any."""
    if isinstance(value, bool):
        return float(value)
    try:
        number = float(str(value).strip().replace("_", "x"))
    except ValueError:
        return None
    return None if number != number else number


def _number_side(cell: str, dtype: T.DataType, number: float) -> tuple[str, str]:
    """Both sides of a numeric comparison; whole columns stay bare for pushdown."""
    if isinstance(dtype, T.IntegralType) and number.is_integer() and abs(number) < 2**53:
        return cell, str(int(number))
    return numeric(cell, dtype), number_literal(number)


def _contains(cell: str, dtype: T.DataType, value: Any) -> str:
    pattern = "(?i)" + str(value or "")
    return f"coalesce({as_text(cell, dtype)} rlike {text_literal(pattern)}, false)"


def predicate(item: Filter, types: dict[str, T.DataType]) -> str:
    """SQL predicate of one filter."""
    cell, dtype, op = quote(item.column), types[item.column], item.operator
    missing = f"({cell} is null or isnan({cell}))" if isinstance(dtype, (T.FloatType, T.DoubleType)) else f"{cell} is null"
    if op == "is_null":
        return missing
    if op == "not_null":
        return f"not {missing}"
    if op == "contains":
        return _contains(cell, dtype, item.value)
    if op == "not_contains":
        return f"not {_contains(cell, dtype, item.value)}"
    if op not in COMPARISONS:
        raise ValueError(f"No comparison is named '{op}'.")
    number = literal_number(item.value)
    if number is not None:
        left, right = _number_side(cell, dtype, number)
    else:
        left, right = as_text(cell, dtype), text_literal(str(item.value))
    # A missing cell differs from every literal.
    return f"not ({left} <=> {right})" if op == "!=" else f"{left} {op} {right}"


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Keep the rows that satisfy every filter."""
    require_columns(df, [f.column for f in filters])
    types = types_of(df)
    for item in filters:
        df = df.where(predicate(item, types))
    return df


def filter_hint(df: DataFrame, column: str, op: str, value: Any) -> DataFrame:
    """Filter from a structured hint; text equality ignores case.

    Unknown columns and comparisons without a numeric literal keep all rows.
    """
    types = types_of(df)
    if column not in types:
        return df
    cell, dtype = quote(column), types[column]
    number = literal_number(value)
    if op in {">", ">=", "<", "<="} and number is not None:
        left, right = _number_side(cell, dtype, number)
        return df.where(f"{left} {op} {right}")
    if op in {"=", "=="}:
        return df.where(f"lower({as_text(cell, dtype)}) = {text_literal(str(value).lower())}")
    if op == "contains":
        return df.where(_contains(cell, dtype, str(value)))
    return df


_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")


def filter_expression(df: DataFrame, text: str) -> DataFrame:
    """Keep rows for which a boolean expression holds, e.g. ``a > 1 & b in ['x']``."""
    if not text.strip():
        return df
    parts, last = [], 0
    for found in _LITERAL.finditer(text):
        parts += [_respell(text[last : found.start()]), found.group()]
        last = found.end()
    parts.append(_respell(text[last:]))
    try:
        found = df.where("".join(parts))
    except Exception as error:
        raise ValueError(f"The condition cannot be read: {error}") from error
    check_condition(found)
    return found


def _respell(text: str) -> str:
    text = text.replace("[", "(").replace("]", ")")
    text = re.sub(r"&&?", " and ", text)
    text = re.sub(r"\|\|?", " or ", text)
    return re.sub(r"~", " not ", text)
