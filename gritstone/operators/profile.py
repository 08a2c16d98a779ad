"""Dataset profile: every per-column statistic, quality score and detected problems."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.values import is_email, is_real, is_text, numeric, parse_date, quote, strip, text_literal
from gritstone.operators import distribution, frequency, rows, stats
from gritstone.operators.correlation import correlation
from gritstone.operators.long_text import long_cells, pick
from gritstone.operators.normalize import normalize, numeric_columns, text_columns, types_of
from gritstone.operators.per_column import per_column
from gritstone.runtime import materialize, small_frame

# Quality penalties per unit rate.
NULL_PENALTY = 45
DUPLICATE_PENALTY = 35
EMPTY_PENALTY = 20
# Name parts of sensitive columns and their scores.
SENSITIVE_NAMES = ("email", "phone", "ssn", "passport", "address")
SENSITIVE_NAME_SCORE = 0.7
EMAIL_SCORE = 0.85
TEXT_KINDS = ("categorical", "string", "email")

COLUMN_SCHEMA = (
    "position int, column string, original_type string, inferred_type string, null_count bigint,"
    " null_percentage double, unique_count bigint, minimum string, maximum string, mean double,"
    " median double, mode string, std double, variance double, q25 double, q50 double, q75 double,"
    " skewness double, kurtosis double, outlier_count bigint,"
    " top_values array<struct<value: string, count: bigint>>, rare_values array<string>,"
    " invalid_count bigint, invalid_values array<string>, category_cardinality bigint,"
    " sensitive_data_probability double"
)
DATASET_SCHEMA = (
    "row_count bigint, column_count bigint, byte_size bigint, duplicate_rows bigint,"
    " empty_rows bigint, null_cells bigint, data_quality_score double, fingerprint string"
)


def sensitivity_score(name: str, kind: str) -> float:
    score = SENSITIVE_NAME_SCORE if any(t in name.lower() for t in SENSITIVE_NAMES) else 0.0
    return max(score, EMAIL_SCORE) if kind == "email" else score


def quality(row_count: int, column_count: int, nulls: int, duplicates: int, empty: int) -> float:
    """Quality score from null, duplicate and empty-row rates, 0 to 100."""
    size = max(row_count, 1)
    score = 100.0 - nulls / max(row_count * column_count, 1) * NULL_PENALTY
    score = score - duplicates / size * DUPLICATE_PENALTY - empty / size * EMPTY_PENALTY
    return round(max(0.0, min(100.0, score)), 1)


def dataset_facts(df: DataFrame) -> dict[str, int]:
    """Row, null-cell, empty-row and byte counts of a table from one pass."""
    flat = normalize(df)
    nulls = " + ".join(f"if({quote(c)} is null, 1, 0)" for c in flat.columns)
    row = flat.selectExpr(
        "count(*) as row_count",
        f"cast(coalesce(sum({nulls}), 0) as bigint) as null_cells",
        f"count_if({rows.all_null(flat)}) as empty_rows",
        f"coalesce(sum({stats.cell_bytes(flat)}), 0) as byte_size",
    ).first()
    return row.asDict()


def dataset_summary(df: DataFrame) -> dict:
    """The one-row part of a profile, without any per-column statistics."""
    with ThreadPoolExecutor(2) as pool:
        copies = pool.submit(lambda: rows.duplicate_count(df).first()["duplicate_rows"])
        marks = pool.submit(lambda: rows.fingerprint(df).first()["fingerprint"])
        facts = dataset_facts(df)
        duplicates, fingerprint = copies.result(), marks.result()
    score = quality(
        facts["row_count"], len(df.columns), facts["null_cells"], duplicates, facts["empty_rows"]
    )
    return {
        **facts,
        "column_count": len(df.columns),
        "duplicate_rows": duplicates,
        "data_quality_score": score,
        "fingerprint": fingerprint,
    }


def quality_score(df: DataFrame) -> DataFrame:
    facts = dataset_facts(df)
    duplicates = rows.duplicate_count(df).first()["duplicate_rows"]
    row = (
        facts["row_count"], len(df.columns), facts["null_cells"], duplicates, facts["empty_rows"],
    )
    return small_frame(
        df.sparkSession,
        [(*row, quality(*row))],
        "row_count bigint, column_count bigint, null_cells bigint, duplicate_rows bigint,"
        " empty_rows bigint, data_quality_score double",
    )


def _type_evidence(flat: DataFrame) -> dict[str, dict]:
    """Counts that decide the logical type, plus exact distinct counts of text columns."""
    names = flat.columns
    fields = {
        "row_count": lambda n: "count(*)",
        "filled": lambda n: f"count({quote(n)})",
        **stats.match_fields(flat),
    }
    base = stats.readings(flat, names)
    return {r.column: r.asDict() for r in per_column(base, names, fields).collect()}


def infer_kinds(df: DataFrame) -> dict[str, str]:
    """Logical type per column: numeric, datetime, email, categorical or string."""
    flat = normalize(df)
    types = types_of(flat)
    texts = [n for n in flat.columns if is_text(types[n])]
    evidence = _type_evidence(flat.select(*[quote(n) for n in texts])) if texts else {}
    distinct = frequency.near_distinct(flat, texts) if texts else {}
    rows_ = max((e["row_count"] for e in evidence.values()), default=0)
    limit = max(stats.CATEGORY_VALUES, rows_ * stats.CATEGORY_SHARE)
    # Only counts near the limit have to be exact to place a column.
    unsure = [n for n in texts if 0.8 * limit <= distinct[n] <= 1.25 * limit]
    if unsure:
        distinct.update({r.column: r.distinct_count for r in frequency.distinct_counts(flat, unsure).collect()})
    kinds = {}
    for n in flat.columns:
        e = evidence.get(n, {"row_count": 0, "filled": 0, "date_count": 0, "email_count": 0})
        kinds[n] = stats.logical_type(
            types[n], e["row_count"], e["filled"], e["date_count"], e["email_count"], distinct.get(n, 0)
        )
    return kinds


def infer_types(df: DataFrame) -> DataFrame:
    """(position, column, inferred_type)."""
    rows_ = [(i, n, k) for i, (n, k) in enumerate(infer_kinds(df).items())]
    return small_frame(df.sparkSession, rows_, "position int, column string, inferred_type string")


def sensitivity(df: DataFrame) -> DataFrame:
    """(position, column, sensitive_data_probability)."""
    kinds = infer_kinds(df)
    rows_ = [(i, n, sensitivity_score(n, k)) for i, (n, k) in enumerate(kinds.items())]
    return small_frame(
        df.sparkSession, rows_, "position int, column string, sensitive_data_probability double"
    )


def invalid_emails(df: DataFrame, columns: list[str] | None = None, examples: int = 10) -> DataFrame:
    """Count and up to ``examples`` distinct malformed addresses per e-mail column."""
    if columns is None:
        columns = [n for n, k in infer_kinds(df).items() if k == "email"]
    freq = frequency.frequency_table(df, columns, keyed=False)
    bad = freq.where(f"not {is_email('value')}")
    totals = bad.groupBy("position", "column").sum("n").withColumnRenamed("sum(n)", "invalid_count")
    shown = frequency.ranked_values(bad, examples, "value")
    listed = shown.groupBy("position").agg({"value": "collect_list"})
    return totals.join(listed, "position").selectExpr(
        "position", "column", "invalid_count", "sort_array(`collect_list(value)`) as examples"
    )


@dataclass
class Profile:
    """Profile of one table. ``columns`` holds one dict per column in table order."""

    df: DataFrame
    summary: dict
    columns: list[dict]
    ranges: list = field(default_factory=list)

    @cached_property
    def dataset(self) -> DataFrame:
        schema = T.StructType.fromDDL(DATASET_SCHEMA)
        row = tuple(self.summary[n] for n in schema.names)
        return small_frame(self.df.sparkSession, [row], schema)

    @cached_property
    def column_table(self) -> DataFrame:
        schema = T.StructType.fromDDL(COLUMN_SCHEMA)
        rows_ = [tuple(c[n] for n in schema.names) for c in self.columns]
        return small_frame(self.df.sparkSession, rows_, schema)

    @cached_property
    def pearson(self) -> DataFrame:
        return correlation(self.df, "pearson")

    @cached_property
    def spearman(self) -> DataFrame:
        return correlation(self.df, "spearman")

    @cached_property
    def covariance(self) -> DataFrame:
        return correlation(self.df, "cov")

    @cached_property
    def histograms(self) -> DataFrame:
        numeric_names = numeric_columns(self.df)
        measured = [SimpleNamespace(**r) for r in self.ranges if r["column"] in numeric_names]
        bins = distribution.histogram_rows(self.df, measured)
        return small_frame(self.df.sparkSession, bins, distribution.HISTOGRAM_SCHEMA)

    @cached_property
    def missingness(self) -> DataFrame:
        ordered = sorted(self.columns, key=lambda c: (-c["null_percentage"], c["position"]))
        rows_ = [(c["position"], c["column"], c["null_count"], c["null_percentage"]) for c in ordered]
        return small_frame(
            self.df.sparkSession,
            rows_,
            "position int, column string, null_count bigint, null_percentage double",
        )

    @cached_property
    def category_distributions(self) -> DataFrame:
        rows_ = []
        shown = [c for c in self.columns if c["inferred_type"] in TEXT_KINDS and c["top_values"]]
        for c in shown:
            for k, entry in enumerate(c["top_values"]):
                rows_.append((c["position"], c["column"], k + 1, entry["value"], entry["count"]))
        return small_frame(
            self.df.sparkSession,
            rows_,
            "position int, column string, rank int, label string, count bigint",
        )

    @property
    def problems(self) -> list[str]:
        return list_problems(self.summary, self.columns)

    def sample(self, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
        return rows.sample_rows(self.df, n, order_by)


def list_problems(summary: dict, columns: list[dict], limit: int | None = None) -> list[str]:
    """Problem texts in report order: dataset first, then column by column; the first ``limit`` if given (say 30)."""
    found = []
    if summary["duplicate_rows"]:
        found.append(f"{summary['duplicate_rows']} duplicate rows")
    if summary["empty_rows"]:
        found.append(f"{summary['empty_rows']} fully empty rows")
    for c in columns:
        if c["null_count"]:
            found.append(f"{c['column']} has {c['null_percentage']}% nulls")
        if c["invalid_count"]:
            found.append(f"{c['column']} has invalid {c['inferred_type']} values")
        if c["outlier_count"]:
            found.append(f"{c['column']} has {c['outlier_count']} statistical outliers")
    return found[:limit]


def _text_facts(flat: DataFrame, freq: DataFrame) -> dict[str, dict]:
    """What plain aggregation tells about text columns, read from their distinct values instead of every cell.

    Long texts stand in the frequency table as keys; their cells are read one by one.
    """
    types = types_of(flat)
    places = {i: n for i, n in enumerate(flat.columns) if is_text(types[n])}
    facts = {
        n: {"position": i, "column": n, "filled": 0, "n": 0, "low_text": None, "high_text": None, "low": None, "high": None,
            "date_count": 0, "email_count": 0, **{k: None for k in stats.MOMENTS if k != "numeric_count"}}
        for i, n in places.items()
    }
    if not places:
        return facts
    texts = freq.where(F.col("position").isin(list(places)))
    cells = texts.where("not hashed").select("position", "value", "n")
    if not texts.where("hashed").isEmpty():
        cells = cells.unionByName(long_cells(flat, places).selectExpr("position", "cell as value", "1L as n"))
    read = cells.selectExpr("*", f"{strip('value')} as text")
    read = read.selectExpr(
        "position", "value", "n", f"{numeric('text', T.StringType(), stripped=True)} as number",
        f"{parse_date('text', stripped=True)} is not null as is_date", f"{is_email('text', stripped=True)} as is_email",
    )
    found = read.groupBy("position").agg(
        F.sum("n").alias("filled"), F.expr("sum(if(number is null, 0, n))").alias("n"),
        F.min("value").alias("low_text"), F.max("value").alias("high_text"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.expr("sum(if(is_date, n, 0))").alias("date_count"), F.expr("sum(if(is_email, n, 0))").alias("email_count"),
    )
    for r in found.collect():
        facts[places[r.position]].update(r.asDict())
    numbers = [n for n in facts if facts[n]["n"]]
    for r in stats.moment_rows(flat, numbers).collect() if numbers else ():
        facts[r.column].update({k: r[k] for k in stats.MOMENTS if k != "numeric_count"})
    return facts


def _value_facts(flat: DataFrame) -> tuple[dict[str, dict], dict[str, dict]]:
    """Distinct count, mode, top and rare values per column from one frequency table, written once; and facts of texts."""
    freq = materialize(frequency.frequency_table(flat))
    facts = {n: {"distinct": 0, "mode": None, "top": [], "rare": []} for n in flat.columns}
    for r in freq.groupBy("column").count().collect():
        facts[r.column]["distinct"] = r["count"]
    found = pick(flat, freq, [frequency.MODE, frequency.top_pick(8), frequency.rare_pick(8)])
    for _, column, _, value, _ in found["mode"]:
        facts[column]["mode"] = value
    for _, column, _, value, n in found["top"]:
        facts[column]["top"].append({"value": value, "count": n})
    for _, column, _, value, _ in found["rare"]:
        facts[column]["rare"].append(value)
    return facts, _text_facts(flat, freq)


def _first_pass(flat: DataFrame) -> dict[str, dict]:
    """Everything plain aggregation can tell about each column that is not text."""
    types = types_of(flat)
    names = [n for n in flat.columns if not is_text(types[n])]
    if not names:
        return {}
    measured = set(stats.measurable(flat)) & set(names)
    base = stats.readings(flat, [n for n in names if n in measured])

    def bound(pick: str):
        return lambda n: f"cast({pick}({quote(n)}) as string)"

    def number(build):
        return lambda n: build(stats.number_of(flat, n)) if n in measured else "cast(null as double)"

    moments = {k: b for k, b in stats.MOMENTS.items() if k != "numeric_count"}
    fields = {
        "row_count": lambda n: "count(*)",
        "null_count": lambda n: f"count_if({quote(n)} is null)",
        "n": lambda n: f"count({stats.number_of(flat, n)})" if n in measured else "count(null)",
        "low_text": bound("min"),
        "high_text": bound("max"),
        "low": number(lambda v: f"min({v})"),
        "high": number(lambda v: f"max({v})"),
        "date_count": lambda n: "count(null)",
        "email_count": lambda n: "count(null)",
        **{k: number(b) for k, b in moments.items()},
    }
    return {r.column: r.asDict() for r in per_column(base, names, fields, flat.columns, width=3).collect()}


def profile(df: DataFrame) -> Profile:
    """Profile a table in a handful of jobs; only per-column results reach the driver."""
    flat = normalize(df)
    types = types_of(flat)
    original = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # The three parts share nothing, so their jobs run side by side.
    with ThreadPoolExecutor(3) as pool:
        parts = [pool.submit(part, flat) for part in (_first_pass, _value_facts, dataset_summary)]
        first, (facts, texts), summary = [part.result() for part in parts]
    for found in texts.values():
        found.update(row_count=summary["row_count"], null_count=summary["row_count"] - found["filled"])
    first = {n: (texts if n in texts else first)[n] for n in flat.columns}
    counts = {n: first[n]["n"] for n in flat.columns if first[n]["n"]}
    quartiles = stats.quartile_values(flat, list(counts), counts)
    outliers = {}
    if counts:
        limits = stats.fences(quartiles)
        found = stats.outlier_rows(flat, list(counts), limits).collect()
        outliers = {r.column: r.outlier_count for r in found}
    kinds = {
        n: stats.logical_type(
            types[n],
            first[n]["row_count"],
            first[n]["row_count"] - first[n]["null_count"],
            first[n]["date_count"],
            first[n]["email_count"],
            facts[n]["distinct"],
        )
        for n in flat.columns
    }
    emails = [n for n in flat.columns if kinds[n] == "email"]
    invalid = {}
    if emails:
        invalid = {r.column: r for r in invalid_emails(flat, emails).collect()}
    columns = []
    for i, n in enumerate(flat.columns):
        r = first[n]
        has_numbers = n in counts
        bounds = (r["low_text"], r["high_text"])
        if has_numbers and (is_text(types[n]) or is_real(types[n])):
            bounds = (_shown(r["low"], types[n]), _shown(r["high"], types[n]))
        q = quartiles.get(n, [None, None, None])
        columns.append(
            {
                "position": i,
                "column": n,
                "original_type": original[n],
                "inferred_type": kinds[n],
                "null_count": r["null_count"],
                "null_percentage": round(r["null_count"] * 100.0 / r["row_count"], 2) if r["row_count"] else 0.0,
                "unique_count": facts[n]["distinct"],
                "minimum": bounds[0],
                "maximum": bounds[1],
                "mean": r["mean"] if has_numbers else None,
                "median": round(q[1], 4) if q[1] is not None else None,
                "mode": facts[n]["mode"],
                "std": r["std"],
                "variance": r["variance"],
                "q25": q[0],
                "q50": q[1],
                "q75": q[2],
                "skewness": r["skewness"],
                "kurtosis": r["kurtosis"],
                "outlier_count": outliers.get(n, 0),
                "top_values": facts[n]["top"],
                "rare_values": facts[n]["rare"],
                "invalid_count": invalid[n].invalid_count if n in invalid else 0,
                "invalid_values": invalid[n].examples if n in invalid else [],
                "category_cardinality": facts[n]["distinct"] if kinds[n] == "categorical" else None,
                "sensitive_data_probability": sensitivity_score(n, kinds[n]),
            }
        )
    return Profile(flat, summary, columns, list(first.values()))


def _shown(value: float | None, dtype: T.DataType) -> str | None:
    """Display text of a number, with the digits its own width needs."""
    if value is None:
        return None
    return str(np.float32(value)) if isinstance(dtype, T.FloatType) else repr(value)


def detected_problems(df: DataFrame) -> DataFrame:
    """(position, problem) for a table, from a full profile."""
    found = profile(df).problems
    return small_frame(df.sparkSession, list(enumerate(found)), "position int, problem string")


def category_distributions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Top values of the text-like columns; of the first ``limit`` filled ones if given (say 8)."""
    kinds = infer_kinds(df)
    names = [n for n, k in kinds.items() if k in TEXT_KINDS]
    if limit is not None and len(names) > limit:
        missing = {r.column: r.null_percentage for r in stats.null_stats(df).collect()}
        names = [n for n in names if missing[n] < 100][:limit]
    return frequency.top_values(df, 8, names).selectExpr("position", "column", "rank", "value as label", "n as count")


def profile_summary(df: DataFrame) -> DataFrame:
    """Light profile: (position, column, kind, missing, outliers) with dataset counts."""
    flat = normalize(df)
    numbers = set(numeric_columns(flat))
    texts = set(text_columns(flat))
    facts = dataset_facts(flat)
    duplicates = rows.duplicate_count(flat).first()["duplicate_rows"]
    missing = {r.column: r.null_count for r in stats.null_stats(flat).collect()}
    ordered = [n for n in flat.columns if n in numbers]
    limits = stats.fences(stats.quartile_values(flat, ordered))
    flagged = stats.outlier_rows(flat, list(limits), limits).collect() if limits else []
    outliers = {r.column: r.outlier_count for r in flagged}
    rows_ = [
        (
            i,
            n,
            "numeric" if n in numbers else "categorical" if n in texts else "other",
            missing[n],
            outliers.get(n),
            facts["row_count"],
            len(flat.columns),
            duplicates,
        )
        for i, n in enumerate(flat.columns)
    ]
    return small_frame(
        df.sparkSession,
        rows_,
        "position int, column string, kind string, missing_values bigint, outliers_iqr bigint,"
        " row_count bigint, column_count bigint, duplicate_rows bigint",
    )
