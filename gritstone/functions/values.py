"""SQL expressions for reading messy cell values: text, numbers, dates, e-mails.

Every helper takes and returns Spark SQL expression text. One parsed expression
replaces dozens of single calls when a plan covers many columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Markers that cleaning turns into null (exact match after trimming).
BLANK_MARKERS = ("", "na", "n/a", "null", "none")

# Cell texts a CSV reader treats as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Patterns for e-mail addresses and numbers.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = r"^[+-]?(inf|infinity)$"

# Display formats of numbers too large or small for plain text conversion.
PLAIN_FORMAT = "0.0####################"
EXPONENT_FORMAT = "0.################E00"

# Date spellings that count as parseable.
CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T]" + CLOCK + r")?$"
SLASH_YEAR_FIRST_PATTERN = r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"
SLASH_YEAR_LAST_PATTERN = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
COMPACT_DATE_PATTERN = r"^[0-9]{8}$"
YEAR_PATTERN = r"^[0-9]{4}$"
MONTH_FIRST_PATTERN = r"^[A-Za-z]{3,9}\.? [0-9]{1,2},? [0-9]{4}$"
DAY_FIRST_PATTERN = r"^[0-9]{1,2} [A-Za-z]{3,9}\.?,? [0-9]{4}$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def quote(name: str) -> str:
    """A column's name as an SQL identifier, whatever characters it contains."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quote(name))


def text_literal(text: str) -> str:
    """An SQL string literal for any text."""
    escaped = "".join(
        f"\\u{ord(c):04x}" if ord(c) < 32 or 126 < ord(c) < 0x10000 else "\\" + c if c in "\\'" else c
        for c in text
    )
    return f"'{escaped}'"


def number_literal(value: float) -> str:
    """An SQL double literal for any float."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_real(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def matches(cell: str, pattern: str) -> str:
    return f"({cell} rlike {text_literal(pattern)})"


def strip(cell: str) -> str:
    """Trim every kind of white space at both ends."""
    return f"trim(both {text_literal(WHITESPACE)} from {cell})"


def blank_to_null(cell: str, markers: tuple[str, ...] = BLANK_MARKERS) -> str:
    """Trim, then turn blank markers into null."""
    listed = ", ".join(text_literal(m) for m in markers)
    return f"case when {strip(cell)} not in ({listed}) then {strip(cell)} end"


def numeric(cell: str, dtype: T.DataType, stripped: bool = False) -> str:
    """Double value of a cell, null where it does not read as a number.

    ``stripped`` marks text that a projection below has trimmed already.
    """
    if is_real(dtype):
        return f"nanvl(cast({cell} as double), null)"
    if is_number(dtype):
        return f"cast({cell} as double)"
    if isinstance(dtype, T.BooleanType):
        return f"cast(cast({cell} as int) as double)"
    if not is_text(dtype):
        return "cast(null as double)"
    text = cell if stripped else strip(cell)
    return (
        f"case when {matches(text, NUMBER_PATTERN)} then try_cast({text} as double)"
        f" when {matches(f'lower({text})', INFINITY_PATTERN)}"
        f" then if({text} like '-%', double('-inf'), double('inf')) end"
    )


def coerce_numeric(name: str, dtype: T.DataType) -> Column:
    """Column form of :func:`numeric`."""
    return F.expr(numeric(quote(name), dtype))


def _real_text(cell: str, dtype: T.DataType) -> str:
    text = f"cast({cell} as string)"
    # A 32-bit value is widened through its text, which keeps its own digits.
    wide = cell if isinstance(dtype, T.DoubleType) else f"cast({text} as double)"
    size = f"abs({wide})"
    return (
        f"case when {size} >= 1e-3D and {size} < 1e7D or {size} = 0 then {text}"
        f" when {size} >= 1e-4D and {size} < 1e16D then format_number({wide}, '{PLAIN_FORMAT}')"
        f" when {size} = double('inf') then replace({text}, 'Infinity', 'inf')"
        f" else regexp_replace(lower(format_number({wide}, '{EXPONENT_FORMAT}')), 'e([0-9])', 'e+$1') end"
    )


def as_text(cell: str, dtype: T.DataType) -> str:
    """Display text of a cell, independent of the engine's number formatting."""
    if is_real(dtype):
        return _real_text(cell, dtype)
    if isinstance(dtype, T.BooleanType):
        return f"case when {cell} then 'True' when not {cell} then 'False' end"
    if isinstance(dtype, T.BinaryType):
        return f"base64({cell})"
    if isinstance(dtype, T.VariantType):
        return f"try_cast({cell} as string)"
    if is_nested(dtype):
        return f"to_json({cell})"
    return f"cast({cell} as string)"


def is_email(cell: str, stripped: bool = False) -> str:
    return matches(cell if stripped else strip(cell), EMAIL_PATTERN)


def _ymd(year: str, month: str, day: str) -> str:
    return f"try_cast(concat_ws('-', lpad({year}, 4, '0'), lpad({month}, 2, '0'), lpad({day}, 2, '0')) as date)"


def parse_date(cell: str, stripped: bool = False) -> str:
    """Calendar date of a text cell in any accepted spelling, else null."""
    value = cell if stripped else strip(cell)
    words = f"split(translate({value}, '.,', ''), ' ')"
    names = ", ".join(text_literal(m) for m in MONTHS)

    def part(i: int) -> str:
        return f"split({value}, '/')[{i}]"

    def month(i: int) -> str:
        place = f"array_position(array({names}), lower(left({words}[{i}], 3)))"
        return f"cast(nullif({place}, 0) as string)"

    compact = (f"substring({value}, 1, 4)", f"substring({value}, 5, 2)", f"substring({value}, 7, 2)")
    spellings = [
        (ISO_DATE_PATTERN, f"try_cast(left({value}, 10) as date)"),
        (
            SLASH_YEAR_LAST_PATTERN,
            f"coalesce({_ymd(part(2), part(0), part(1))}, {_ymd(part(2), part(1), part(0))})",
        ),
        (SLASH_YEAR_FIRST_PATTERN, _ymd(part(0), part(1), part(2))),
        (COMPACT_DATE_PATTERN, _ymd(*compact)),
        (YEAR_PATTERN, _ymd(value, "'1'", "'1'")),
        (MONTH_FIRST_PATTERN, f"if({month(0)} is null, null, {_ymd(f'{words}[2]', month(0), f'{words}[1]')})"),
        (DAY_FIRST_PATTERN, f"if({month(1)} is null, null, {_ymd(f'{words}[2]', month(1), f'{words}[0]')})"),
    ]
    cases = " ".join(f"when {matches(value, pattern)} then {date}" for pattern, date in spellings)
    # Every accepted spelling holds four digits in a row; most text fails this cheap test.
    return f"case when not {matches(value, '[0-9]{4}')} then null {cases} end"


def stable_hash(*cells: str) -> str:
    """52-bit hash of the keys, exact in a double and computable by any SQL engine."""
    parts = ", ".join(f"coalesce(cast({c} as string), '~')" for c in cells)
    return f"cast(conv(left(md5(concat_ws('|', {parts})), 13), 16, 10) as bigint)"
