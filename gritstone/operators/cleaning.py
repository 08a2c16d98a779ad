"""Cleaning steps and the two audited cleaning runs built from them.

Every run measures first and then applies one projection with the measured
literals, so the table is rewritten once however many steps apply.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gritstone.functions.values import (
    BLANK_MARKERS,
    EMAIL_PATTERN,
    blank_to_null,
    is_moment,
    is_number,
    is_text,
    matches,
    number_literal,
    numeric,
    parse_date,
    quote,
    text_literal,
)
from gritstone.operators import frequency, stats
from gritstone.operators.filters import Filter, filter_hint
from gritstone.operators.normalize import normalize, types_of
from gritstone.operators.order_stats import quantiles
from gritstone.operators.rows import duplicate_count
from gritstone.runtime import materialize, small_frame
from gritstone.sources.reader import export

# Decision rates of the cleaning runs.
NUMERIC_RATE = 0.85
DATE_COLUMN_RATE = 0.5
KEPT_ROW_SHARE = 0.5
# Name parts of date columns and the text they are rewritten to.
DATE_NAMES = ("date", "time", "created", "updated")
DATE_FORMAT = "%Y-%m-%d"
UNKNOWN = "unknown"

MANIFEST_SCHEMA = "id string, operation string, columns string, affected_rows bigint, parameters string"
CHECK_SCHEMA = "name string, passed boolean, status string"


def duplicates_of(df: DataFrame) -> int:
    return duplicate_count(df).first()["duplicate_rows"]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each group of identical rows."""
    maps = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()]
    if not maps:
        return df.dropDuplicates()
    keyed = df.selectExpr("*", *[f"to_json({quote(m)}) as __key_{i}" for i, m in enumerate(maps)])
    keys = [c for c in keyed.columns if c not in maps]
    return keyed.dropDuplicates(keys).select(*[quote(c) for c in df.columns])


def _replace(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Rewrite some columns in place; unknown names are appended."""
    columns = [f"{exprs[c]} as {quote(c)}" if c in exprs else quote(c) for c in df.columns]
    extra = [f"{e} as {quote(c)}" for c, e in exprs.items() if c not in df.columns]
    return df.selectExpr(*columns, *extra)


def _texts(df: DataFrame, columns: list[str] | None) -> list[str]:
    types = types_of(df)
    return [c for c in (columns or df.columns) if is_text(types[c])]


def normalize_text(
    df: DataFrame, columns: list[str] | None = None, markers: tuple[str, ...] = BLANK_MARKERS
) -> DataFrame:
    """Trim text and turn blank markers into null."""
    return _replace(df, {c: blank_to_null(quote(c), markers) for c in _texts(df, columns)})


def changed_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, changed): text cells that normalisation would alter."""
    names = _texts(df, columns)
    wide = df.selectExpr(
        *[f"count_if(not ({quote(c)} <=> {blank_to_null(quote(c))})) as c{i}" for i, c in enumerate(names)]
    )
    rows = ", ".join(f"struct({text_literal(c)} as column, c{i} as changed)" for i, c in enumerate(names))
    return wide.selectExpr(f"inline(array({rows}))")


def _filled(df: DataFrame, exprs: dict[str, str]) -> tuple[int, dict[str, int]]:
    """Row count and number of non-null results of each expression, in one pass."""
    row = df.selectExpr(
        "count(*) as n", *[f"count({e}) as c{i}" for i, e in enumerate(exprs.values())]
    ).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(exprs)}


def _readable(df: DataFrame) -> dict[str, str]:
    """Numeric reading of the columns that cleaning may treat as numbers."""
    types = types_of(df)
    kept = [c for c in df.columns if is_number(types[c]) or is_text(types[c])]
    return {c: numeric(quote(c), types[c]) for c in kept}


def fill_numeric_median(df: DataFrame, always: bool = False) -> DataFrame:
    """Fill missing cells of mostly numeric columns with the exact median.

    ``always`` also converts complete columns and falls back to 0.
    """
    df = normalize(df, nested_as_text=False)
    return _replace(df, _median_fills(df, always)[0])


def _median_fills(df: DataFrame, always: bool) -> tuple[dict[str, str], dict[str, tuple[int, float]]]:
    """Fill expressions, and (missing, median) of the columns that have gaps."""
    readings = _readable(df)
    types = types_of(df)
    total, filled = _filled(df, readings)
    numeric_ones = [c for c in readings if total and filled[c] / total > NUMERIC_RATE]
    gaps = {c: readings[c] for c in numeric_ones if filled[c] < total}
    medians = {c: q[0] for c, q in quantiles(df, gaps, [0.5], filled).items()}
    fills, facts = {}, {}
    for c in numeric_ones:
        if c in gaps:
            value = 0.0 if medians[c] is None else medians[c]
            fills[c] = f"coalesce({readings[c]}, {number_literal(value)})"
            facts[c] = (total - filled[c], value)
        elif always and is_text(types[c]):
            fills[c] = readings[c]
    return fills, facts


def mode_literals(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """SQL literal of each column's mode, typed like the column."""
    types = types_of(df)
    found = {r.column: r["mode"] for r in frequency.modes(df, columns).collect()} if columns else {}
    literals = {}
    for c in columns:
        kind = types[c].simpleString()
        if c in found:
            literals[c] = f"cast({text_literal(found[c])} as {kind})"
        elif is_text(types[c]):
            literals[c] = text_literal(UNKNOWN)
    return literals


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill missing cells with the column's mode, or 'unknown' for an empty text column."""
    df = normalize(df, nested_as_text=False)
    names = [c for c in columns or df.columns]
    total, filled = _filled(df, {c: quote(c) for c in names})
    literals = mode_literals(df, [c for c in names if filled[c] < total])
    return _replace(df, {c: f"coalesce({quote(c)}, {v})" for c, v in literals.items()})


def email_flag(cell: str) -> str:
    return matches(f"coalesce({cell}, '')", EMAIL_PATTERN)


def flag_emails(df: DataFrame) -> DataFrame:
    """Add ``<column>_is_valid`` for every text column whose name contains 'email'."""
    names = [c for c in _texts(df, None) if "email" in c.lower()]
    return _replace(df, {f"{c}_is_valid": email_flag(quote(c)) for c in names})


def date_text(cell: str, dtype: T.DataType) -> str | None:
    """ISO date text of a text or date-time cell; other types have none."""
    if is_text(dtype):
        return f"date_format({parse_date(cell)}, 'yyyy-MM-dd')"
    return f"date_format({cell}, 'yyyy-MM-dd')" if is_moment(dtype) else None


def _date_columns(df: DataFrame) -> dict[str, str]:
    types = types_of(df)
    named = [c for c in df.columns if any(t in c.lower() for t in DATE_NAMES)]
    texts = {c: date_text(quote(c), types[c]) for c in named}
    return {c: e for c, e in texts.items() if e}


def standardize_dates(df: DataFrame) -> DataFrame:
    """Rewrite date columns, recognised by name and content, as ISO text."""
    texts = _date_columns(df)
    if not texts:
        return df
    total, filled = _filled(df, texts)
    return _replace(df, {c: e for c, e in texts.items() if filled[c] > total * DATE_COLUMN_RATE})


def _caps(df: DataFrame) -> tuple[dict[str, str], list[tuple]]:
    """Capping expressions and (column, capped, low, high) of columns with outliers."""
    types = types_of(df)
    readings = {c: numeric(quote(c), types[c]) for c in df.columns if is_number(types[c])}
    limits = stats.fences(quantiles(df, readings, stats.QUARTILES))
    if not limits:
        return {}, []
    counts = {r.column: r.outlier_count for r in stats.outlier_rows(df, list(limits), limits).collect()}
    caps, facts = {}, []
    for c in limits:
        low, high = map(number_literal, limits[c])
        if counts[c]:
            # greatest and least skip nulls, which a cap must keep.
            caps[c] = f"if({quote(c)} is null, null, least(greatest({readings[c]}, {low}), {high}))"
            facts.append((c, counts[c], *limits[c]))
    return caps, facts


def cap_outliers(df: DataFrame) -> DataFrame:
    """Clip numeric columns to their outlier fences."""
    df = normalize(df, nested_as_text=False)
    return _replace(df, _caps(df)[0])


@dataclass
class CleanResult:
    """A cleaned table with its audit trail. Validation runs when first read."""

    before: DataFrame
    df: DataFrame
    operations: list[tuple]
    staged: bool = False
    run_id: str | None = None
    error: str | None = None

    @cached_property
    def manifest(self) -> DataFrame:
        """One row per operation that changed something."""
        rows = [
            (f"op_{i:03d}", name, ",".join(columns), affected, json.dumps(parameters))
            for i, (name, columns, affected, parameters) in enumerate(self.operations, start=1)
        ]
        return small_frame(self.df.sparkSession, rows, MANIFEST_SCHEMA)

    @cached_property
    def measures(self) -> dict:
        """Counts before and after, from one pass and one row grouping per side."""
        before, after = normalize(self.before), normalize(self.df)
        rows_before, filled_before = _filled(before, {c: quote(c) for c in before.columns})
        rows_after, filled_after = _filled(after, {c: quote(c) for c in after.columns})
        return {
            "rows_before": rows_before,
            "rows_after": rows_after,
            "nulls_before": {c: rows_before - n for c, n in filled_before.items()},
            "nulls_after": {c: rows_after - n for c, n in filled_after.items()},
            "duplicates_before": duplicates_of(before),
            "duplicates_after": duplicates_of(after),
        }

    @property
    def transformed_values(self) -> int:
        if not self.staged:
            return sum(op[2] for op in self.operations)
        after = self.measures["nulls_after"]
        return sum(max(0, n - after.get(c, 0)) for c, n in self.measures["nulls_before"].items())

    @cached_property
    def checks(self) -> list[tuple[str, bool]]:
        if self.error:
            return [("batches_succeeded", False)]
        m = self.measures
        if self.staged:
            return [
                ("local_dataset_loaded", m["rows_before"] >= 0),
                ("cleaned_dataset_written", m["rows_after"] >= 0),
                ("columns_available", len(self.df.columns) > 0),
            ]
        least = max(1, int(m["rows_before"] * KEPT_ROW_SHARE)) if m["rows_before"] else 0
        return [
            ("dataset_exists", True),
            ("row_count_reasonable", m["rows_after"] >= least),
            ("columns_preserved", len(self.df.columns) >= len(self.before.columns)),
            ("duplicates_not_increased", m["duplicates_after"] <= m["duplicates_before"]),
        ]

    @property
    def status(self) -> str:
        if all(passed for _, passed in self.checks):
            return "passed"
        return "failed" if self.staged or self.error else "warning"

    @cached_property
    def validation(self) -> DataFrame:
        rows = [(name, passed, self.status) for name, passed in self.checks]
        return small_frame(self.df.sparkSession, rows, CHECK_SCHEMA)

    @cached_property
    def metrics(self) -> DataFrame:
        """(metric, column, value): nulls per column, duplicates and transformed values."""
        m = self.measures
        rows = [("nulls_before", c, n) for c, n in m["nulls_before"].items()]
        rows += [("nulls_after", c, n) for c, n in m["nulls_after"].items()]
        rows += [(k, None, m[k]) for k in ("duplicates_before", "duplicates_after")]
        rows.append(("transformed_values", None, self.transformed_values))
        return small_frame(self.df.sparkSession, rows, "metric string, column string, value bigint")

    @cached_property
    def comparison(self) -> DataFrame:
        m = self.measures
        row = (
            m["rows_before"], m["rows_after"], len(self.before.columns), len(self.df.columns),
            m["duplicates_before"], m["duplicates_after"], sum(m["nulls_before"].values()),
            sum(m["nulls_after"].values()), self.transformed_values, self.status,
        )
        return small_frame(self.df.sparkSession, [row], COMPARISON_SCHEMA)

    def approve(self, store, dataset_id: str, label: str | None = None):
        """Promote the cleaned table to the next version if validation did not fail."""
        if self.status == "failed":
            raise ValueError("Only a successful run can be approved." + (f" {self.error}" if self.error else ""))
        return store.promote(self.df, dataset_id, label or "Approved cleaning run")

    def write(self, path: str) -> None:
        """Write the cleaned table as Parquet and CSV, with manifest and validation."""
        root = path.rstrip("/")
        self.df.write.parquet(f"{root}/cleaned.parquet")
        export(normalize(self.df), f"{root}/cleaned.csv", "csv")
        self.manifest.write.json(f"{root}/cleaning_manifest")
        self.validation.write.json(f"{root}/validation_report")


COMPARISON_SCHEMA = (
    "rows_before bigint, rows_after bigint, columns_before int, columns_after int,"
    " duplicates_before bigint, duplicates_after bigint, null_cells_before bigint,"
    " null_cells_after bigint, transformed_values bigint, validation_status string"
)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before/after comparison of two tables."""
    return CleanResult(before, after, [], staged=True).comparison


def _without_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """The table without copies, and how many went; the shuffle of rows runs only if needed."""
    copies = duplicates_of(df)
    return (materialize(drop_duplicates(df)), copies) if copies else (df, 0)


def clean(df: DataFrame) -> CleanResult:
    """Rule-based run: duplicates, then per column text, e-mail flag, median, dates."""
    source = normalize(df, nested_as_text=False)
    base, copies = _without_duplicates(source)
    operations: list[tuple] = [("remove_duplicate_rows", [], copies, {})] if copies else []
    types = types_of(base)
    texts = [c for c in base.columns if is_text(types[c])]
    trimmed = normalize_text(base)
    changed = {r.column: r.changed for r in changed_cells(base).collect()} if texts else {}
    fills, medians = _median_fills(trimmed, always=False)
    dates = {c: e for c, e in _date_columns(trimmed).items() if c not in fills}
    flags = {c: f"not {email_flag(quote(c))}" for c in texts if "email" in c.lower()}
    measured = {**{f"date {c}": e for c, e in dates.items()}}
    measured.update({f"flag {c}": f"if({e}, 1, null)" for c, e in flags.items()})
    total, counts = _filled(trimmed, measured) if measured else (0, {})
    final: dict[str, str] = {}
    for c in base.columns:
        if changed.get(c):
            operations.append(("trim_and_normalize_empty_text", [c], changed[c], {}))
        if c in flags:
            flag = f"{c}_is_valid"
            final[flag] = email_flag(quote(c))
            operations.append(
                ("flag_invalid_email", [c, flag], counts[f"flag {c}"], {"flag_column": flag})
            )
        if c in medians:
            missing, median = medians[c]
            final[c] = fills[c]
            operations.append(("fill_missing_numeric_median", [c], missing, {"median": median}))
        if c in dates and counts[f"date {c}"] > total * DATE_COLUMN_RATE:
            final[c] = dates[c]
            operations.append(
                ("standardize_date_format", [c], counts[f"date {c}"], {"format": DATE_FORMAT})
            )
    return CleanResult(source, _replace(trimmed, final), operations)


def clean_staged(df: DataFrame, row_filter: Filter | None = None, outliers: bool = True) -> CleanResult:
    """Staged run: row filter, duplicates, text, median or mode fill, outlier caps."""
    source = normalize(df, nested_as_text=False)
    operations: list[tuple] = []
    kept = source
    if row_filter is not None and row_filter.column in source.columns:
        kept = filter_hint(source, row_filter.column, row_filter.operator, row_filter.value)
        rows = source.count() - kept.count()
        operations.append(
            ("filter_rows", [row_filter.column], rows, {"op": row_filter.operator, "value": row_filter.value})
        )
    base, copies = _without_duplicates(kept)
    if copies:
        operations.append(("remove_duplicates", [], copies, {}))
    trimmed = normalize_text(base)
    fills, _ = _median_fills(trimmed, always=True)
    rest = [c for c in trimmed.columns if c not in fills]
    total, filled = _filled(trimmed, {c: quote(c) for c in rest}) if rest else (0, {})
    gaps = [c for c in rest if filled[c] < total]
    fills.update({c: f"coalesce({quote(c)}, {v})" for c, v in mode_literals(trimmed, gaps).items()})
    result = _replace(trimmed, fills)
    if outliers:
        caps, facts = _caps(result)
        result = _replace(result, caps)
        for c, affected, low, high in facts:
            operations.append(("cap_outliers", [c], affected, {"lower": low, "upper": high}))
    operations.append(("clean_and_preprocess", [], 0, {"columns": len(result.columns)}))
    return CleanResult(source, result, operations, staged=True)


def apply_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> CleanResult:
    """Run a caller's transformation and validate its result like a cleaning run."""
    return CleanResult(df, df.transform(fn), [("custom_transform", [], 0, {})])


def apply_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, columns: list[str] | None = None
) -> CleanResult:
    """Run a caller's function on Arrow batches of the rows, in tasks, and validate the result like a cleaning run.

    The function gets the named columns and returns those of ``schema``, in any order; other types are cast if nothing
    is lost. The result is written before it is validated, so the function runs once. A batch that fails makes the run
    a failed one, which cannot be approved; its error names the run and the batch.
    """
    run = f"run_{uuid.uuid4().hex[:10]}"
    struct = T.StructType.fromDDL(schema)
    wanted = to_arrow_schema(struct)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            try:
                made = fn(batch)
                table = made if isinstance(made, pa.Table) else pa.Table.from_batches([made])
                table = table.select(wanted.names).cast(wanted)
            except Exception as error:
                part = TaskContext.get().partitionId()
                raise ValueError(f"{run}: batch {number} of part {part} failed: {type(error).__name__}: {error}") from error
            yield from table.to_batches()

    source = df if columns is None else df.select(*[quote(c) for c in columns])
    operations: list[tuple] = [("custom_transform", list(columns or []), 0, {"run": run})]
    try:
        made = materialize(source.mapInArrow(per_batch, struct))
    except PySparkException as error:
        told = re.search(rf"{run}: .*", str(error))
        return CleanResult(df, small_frame(df.sparkSession, [], struct), operations, run_id=run, error=told.group() if told else f"{run}: {error}")
    return CleanResult(df, made, operations, run_id=run)
