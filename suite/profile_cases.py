"""Profiling queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.operators import distribution, frequency, profile, rows, stats
from gritstone.operators.correlation import correlation
from suite.base import (
    CUSTOMER_SQL,
    DIRTY_CUSTOMER_COLUMNS,
    DIRTY_LINEITEM_COLUMNS,
    DUCK_DATE,
    DUCK_EMAIL,
    DUCK_NUMBER,
    LINEITEM_COLUMNS,
    LINEITEM_SQL,
    NUMERIC_KINDS,
    case,
    dirty_customer,
    dirty_lineitem,
    duck_number,
    numbers,
    per_column_sql,
    table,
    union,
)

COLUMN = '"column"'


@case(
    "profile_shape",
    per_column_sql(
        "lineitem",
        LINEITEM_COLUMNS,
        lambda n, k: f"'{k}' as original_type, count(*) as row_count,"
        f" cast({len(LINEITEM_COLUMNS)} as bigint) as column_count",
    ),
)
def _(spark, sf_dir):
    return stats.profile_shape(table(spark, sf_dir, "lineitem"))


def distinct_sql(n: str) -> str:
    return f"count(distinct {n})"


def kind_sql(n: str, k: str) -> str:
    """Logical type by whole-column rates; the dirty tables only hold ISO dates."""
    if k in NUMERIC_KINDS:
        return "any_value('numeric')"
    if k == "timestamp_ntz":
        return "any_value('datetime')"
    dates = f"avg(case when regexp_matches(trim({n}), '{DUCK_DATE}') and try_cast({n} as date) is not null then 1.0 else 0 end) filter (where {n} is not null)"
    emails = f"avg(case when regexp_matches(trim({n}), '{DUCK_EMAIL}') then 1.0 else 0 end) filter (where {n} is not null)"
    return (
        f"case when {dates} > 0.8 then 'datetime' when {emails} > 0.6 then 'email'"
        f" when {distinct_sql(n)} <= greatest(20, count(*) * 0.05) then 'categorical' else 'string' end"
    )


@case(
    "infer_types",
    per_column_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"{kind_sql(n, k)} as inferred_type"),
)
def _(spark, sf_dir):
    return profile.infer_types(dirty_customer(spark, sf_dir))


@case(
    "null_stats",
    per_column_sql(
        CUSTOMER_SQL,
        DIRTY_CUSTOMER_COLUMNS,
        lambda n, k: f"count(*) - count({n}) as null_count,"
        f" round((count(*) - count({n})) * 100.0::double / count(*), 2) as null_percentage",
    ),
)
def _(spark, sf_dir):
    return stats.null_stats(dirty_customer(spark, sf_dir))


@case(
    "distinct_counts",
    per_column_sql("lineitem", LINEITEM_COLUMNS, lambda n, k: f"{distinct_sql(n)} as distinct_count"),
)
def _(spark, sf_dir):
    return frequency.distinct_counts(table(spark, sf_dir, "lineitem"))


def text_sql(n: str, k: str) -> str:
    return f"cast({n} as varchar)"


@case(
    "min_max",
    per_column_sql(
        "lineitem",
        LINEITEM_COLUMNS,
        lambda n, k: f"{text_sql(f'min({n})', k)} as minimum, {text_sql(f'max({n})', k)} as maximum",
    ),
)
def _(spark, sf_dir):
    return stats.min_max(table(spark, sf_dir, "lineitem"))


def shape_sql(v: str, which: str) -> str:
    least = 3 if which == "skewness" else 4
    return (
        f"case when count({v}) < {least} then null when var_samp({v}) = 0 then 0.0"
        f" else round({which}({v}), 4) end"
    )


def moments_sql(source: str, columns: dict[str, str], digits: int) -> str:
    def build(n, k):
        v = f"({duck_number(n, k)})"
        return (
            f"count({v}) as numeric_count, round(avg({v}), {digits}) as mean,"
            f" round(stddev_samp({v}), {digits}) as std, round(var_samp({v}), 2) as variance,"
            f" {shape_sql(v, 'skewness')} as skewness, {shape_sql(v, 'kurtosis')} as kurtosis"
        )

    return f"select * from ({per_column_sql(source, columns, build)}) where numeric_count > 0"


# The sums run in another order than DuckDB's, so large variances are compared to 2 decimals.
def rounded_variance(df):
    return df.withColumn("variance", F.round("variance", 2))


@case(
    "numeric_stats",
    moments_sql("lineitem", {n: LINEITEM_COLUMNS[n] for n in numbers(LINEITEM_COLUMNS)}, 4),
)
def _(spark, sf_dir):
    return rounded_variance(stats.numeric_stats(table(spark, sf_dir, "lineitem")))


@case(
    "shape_stats",
    f"select position, \"column\", skewness, kurtosis from ({moments_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS | {'l_shipdate': 'string'}, 4).replace('trim(l_shipdate)', 'cast(null as varchar)')})",
)
def _(spark, sf_dir):
    found = stats.numeric_stats(dirty_lineitem(spark, sf_dir))
    return found.select("position", "column", "skewness", "kurtosis")


def quantile_sql(v: str, p: float) -> str:
    return f"quantile_cont({v}, {p})"


@case(
    "quantiles",
    per_column_sql(
        "lineitem",
        {n: LINEITEM_COLUMNS[n] for n in numbers(LINEITEM_COLUMNS)},
        lambda n, k: f"round(quantile_cont(cast({n} as double), 0.25), 4) as q25,"
        f" round(quantile_cont(cast({n} as double), 0.5), 4) as median,"
        f" round(quantile_cont(cast({n} as double), 0.75), 4) as q75",
    ),
)
def _(spark, sf_dir):
    found = stats.quantile_table(table(spark, sf_dir, "lineitem"))
    return found.select("position", "column", *[F.round(c, 4).alias(c) for c in ("q25", "median", "q75")])


def outlier_sql(v: str) -> str:
    """Count outside the fences around the quartiles q1 and q3 of the same row set."""
    return (
        f"(select count(*) from src s2 where q3 > q1 and ({v} < q1 - 1.5 * (q3 - q1)"
        f" or {v} > q3 + 1.5 * (q3 - q1)))"
    )


def outliers_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (n, k) in enumerate(columns.items()):
        if k == "timestamp_ntz":
            continue
        v = f"({duck_number(n, k)})"
        parts.append(
            f"select cast({i} as int) as position, '{n}' as \"column\", {outlier_sql(v)} as outlier_count"
            f" from (select quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.75) as q3 from src)"
            f" where q1 is not null"
        )
    return f"with src as (select * from {source}) {union(parts)}"


@case("outlier_counts", outliers_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS))
def _(spark, sf_dir):
    return stats.outlier_counts(dirty_customer(spark, sf_dir))


def frequency_sql(source: str, columns: dict[str, str], order: str, keep: str) -> str:
    parts = []
    for i, (n, k) in enumerate(columns.items()):
        parts.append(
            f"select cast({i} as int) as position, '{n}' as \"column\", value, n,"
            f" row_number() over (order by {order}) as rank from"
            f" (select {n} as native, {text_sql(n, k)} as value, count(*) as n from src"
            f" where {n} is not null group by all) where {keep}"
        )
    return f"with src as (select * from {source}), freq as ({union(parts)})"


@case(
    "modes",
    frequency_sql("lineitem", LINEITEM_COLUMNS, "n desc, native", "true")
    + ' select position, "column", value as mode, n as mode_count from freq where rank = 1',
)
def _(spark, sf_dir):
    return frequency.modes(table(spark, sf_dir, "lineitem"))


@case(
    "top_values",
    frequency_sql("lineitem", LINEITEM_COLUMNS, "n desc, value", "true")
    + ' select position, "column", cast(rank as int) as rank, value, n from freq where rank <= 8',
)
def _(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "lineitem"))


@case(
    "rare_values",
    frequency_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, "value", "n = 1")
    + ' select position, "column", cast(rank as int) as rank, value from freq where rank <= 8',
)
def _(spark, sf_dir):
    return frequency.rare_values(dirty_customer(spark, sf_dir))


@case(
    "invalid_emails",
    f"""with src as (select email from {CUSTOMER_SQL}),
    bad as (select email, count(*) as n from src
            where email is not null and not regexp_matches(trim(email), '{DUCK_EMAIL}') group by email)
    select cast(4 as int) as position, 'email' as "column", cast(sum(n) as bigint) as invalid_count,
      (select string_agg(email, '|' order by email) from (select email from bad order by email limit 10)) as examples
    from bad""",
)
def _(spark, sf_dir):
    found = profile.invalid_emails(dirty_customer(spark, sf_dir))
    return found.withColumn("examples", F.concat_ws("|", "examples"))


@case(
    "sensitivity",
    f"""with t as ({per_column_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"{kind_sql(n, k)} as kind")})
    select position, "column", cast(case when kind = 'email' then 0.85
      when regexp_matches(lower("column"), 'email|phone|ssn|passport|address') then 0.7 else 0.0 end as double)
      as sensitive_data_probability from t""",
)
def _(spark, sf_dir):
    return profile.sensitivity(dirty_customer(spark, sf_dir))


DUPLICATES = "select coalesce(sum(n - 1), 0) as d from (select count(*) as n from src group by all)"


def duplicates_sql(columns: dict[str, str]) -> str:
    listed = ", ".join(columns)
    return f"(select cast(coalesce(sum(n - 1), 0) as bigint) from (select {listed}, count(*) as n from src group by {listed}))"


def empties_sql(columns: dict[str, str]) -> str:
    return f"(select count(*) from src where coalesce({', '.join(f'cast({c} as varchar)' for c in columns)}) is null)"


def null_cells_sql(columns: dict[str, str]) -> str:
    return "(select cast(" + " + ".join(f"(count(*) - count({c}))" for c in columns) + " as bigint) from src)"


@case(
    "duplicate_count",
    f"with src as (select * from {CUSTOMER_SQL}) select {duplicates_sql(DIRTY_CUSTOMER_COLUMNS)} as duplicate_rows",
)
def _(spark, sf_dir):
    return rows.duplicate_count(dirty_customer(spark, sf_dir))


@case(
    "duplicate_texts",
    "select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows from"
    " (select text, lang, source, n_chars, count(*) as n from documents group by text, lang, source, n_chars)",
)
def _(spark, sf_dir):
    return rows.duplicate_count(table(spark, sf_dir, "documents").drop("doc_id"))


@case(
    "empty_rows",
    f"with src as (select * from {CUSTOMER_SQL}) select {empties_sql(DIRTY_CUSTOMER_COLUMNS)} as empty_rows",
)
def _(spark, sf_dir):
    return rows.empty_row_count(dirty_customer(spark, sf_dir))


def fingerprint_sql(source: str, columns: list[str]) -> str:
    cells = ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in columns)
    return (
        f"select cast(count(*) as varchar) || '-' || cast(coalesce(sum(cast(('0x' || left(md5(concat_ws(chr(31), {cells})), 12))"
        f" as bigint)), 0) as varchar) as fingerprint from {source}"
    )


@case("fingerprint", fingerprint_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def _(spark, sf_dir):
    return rows.fingerprint(table(spark, sf_dir, "orders"))


def quality_sql(columns: dict[str, str]) -> str:
    return (
        "round(greatest(0, least(100, 100 - null_cells * 45.0::double / (row_count * column_count)"
        " - duplicate_rows * 35.0::double / row_count - empty_rows * 20.0::double / row_count)), 1)"
    )


def dataset_sql(columns: dict[str, str]) -> str:
    return (
        f"select count(*) as row_count, cast({len(columns)} as bigint) as column_count,"
        f" {null_cells_sql(columns)} as null_cells, {duplicates_sql(columns)} as duplicate_rows,"
        f" {empties_sql(columns)} as empty_rows from src"
    )


QUALITY = (
    f"with src as (select * from {CUSTOMER_SQL}), d as ({dataset_sql(DIRTY_CUSTOMER_COLUMNS)})"
    f" select *, {quality_sql(DIRTY_CUSTOMER_COLUMNS)} as data_quality_score from d"
)


@case("quality_score", QUALITY)
def _(spark, sf_dir):
    return profile.quality_score(dirty_customer(spark, sf_dir))


# Position of each problem source within the report: nulls, invalid values, outliers per column.
PROBLEMS = f"""
with src as (select * from {CUSTOMER_SQL}),
nulls as ({per_column_sql("src", DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"count(*) - count({n}) as nulls, round((count(*) - count({n})) * 100.0::double / count(*), 2) as share")}),
outliers as ({outliers_sql("src", DIRTY_CUSTOMER_COLUMNS)}),
found as (
  select -2 as p, 0 as o, {duplicates_sql(DIRTY_CUSTOMER_COLUMNS)} || ' duplicate rows' as problem
  union all select -1, 0, {empties_sql(DIRTY_CUSTOMER_COLUMNS)} || ' fully empty rows'
  union all select position, 0, "column" || ' has ' || cast(share as varchar) || '% nulls' from nulls where nulls > 0
  union all select 4, 1, 'email has invalid email values'
  union all select position, 2, "column" || ' has ' || outlier_count || ' statistical outliers' from outliers where outlier_count > 0)
select cast(row_number() over (order by p, o) - 1 as int) as position, problem from found
qualify position < 30
"""


@case("detected_problems", PROBLEMS)
def _(spark, sf_dir):
    return profile.detected_problems(dirty_customer(spark, sf_dir))


def matrix_sql(source: str, columns: dict[str, str], value) -> str:
    names = [(i, n) for i, (n, k) in enumerate(columns.items()) if k in NUMERIC_KINDS]
    parts = [
        f"select cast({i} as int) as x_position, cast({j} as int) as y_position, '{x}' as x, '{y}' as y,"
        f" {value(x, y)} as value from src"
        for i, x in names
        for j, y in names
    ]
    return f"with src as (select * from {source}) {union(parts)}"


def pearson_sql(x: str, y: str) -> str:
    on = f"filter (where {x} is not null and {y} is not null)"
    return f"case when var_pop({x}) {on} > 0 and var_pop({y}) {on} > 0 then round(corr({y}, {x}), 4) end"


@case("pearson", matrix_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS, pearson_sql))
def _(spark, sf_dir):
    return correlation(dirty_lineitem(spark, sf_dir), "pearson")


@case(
    "covariance",
    matrix_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS, lambda x, y: f"round(covar_samp({y}, {x}), 2)"),
)
def _(spark, sf_dir):
    found = correlation(dirty_lineitem(spark, sf_dir), "cov")
    return found.withColumn("value", F.round("value", 2))


def spearman_sql() -> str:
    """Each pair is ranked on its complete rows; ties get the average rank."""
    parts = []
    position = list(DIRTY_LINEITEM_COLUMNS).index
    for x in numbers(DIRTY_LINEITEM_COLUMNS):
        for y in numbers(DIRTY_LINEITEM_COLUMNS):
            parts.append(
                f"select cast({position(x)} as int) as x_position, cast({position(y)} as int) as y_position,"
                f" '{x}' as x, '{y}' as y, case when min(rx) < max(rx) and min(ry) < max(ry) then round(corr(rx, ry), 4) end as value from (select"
                f" rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as rx,"
                f" rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0 as ry"
                f" from src where {x} is not null and {y} is not null)"
            )
    return f"with src as (select * from {LINEITEM_SQL}) {union(parts)}"


@case("spearman", spearman_sql())
def _(spark, sf_dir):
    return correlation(dirty_lineitem(spark, sf_dir), "spearman")


@case(
    "missingness",
    per_column_sql(
        LINEITEM_SQL,
        DIRTY_LINEITEM_COLUMNS,
        lambda n, k: f"count(*) - count({n}) as null_count,"
        f" round((count(*) - count({n})) * 100.0::double / count(*), 2) as null_percentage",
    ),
)
def _(spark, sf_dir):
    return stats.missingness(dirty_lineitem(spark, sf_dir))


def histogram_sql(source: str, columns: list[tuple[int, str]], bins: str) -> str:
    parts = []
    for i, n in columns:
        parts.append(
            f"select cast({i} as int) as position, '{n}' as \"column\", b.bin,"
            f" format('{{:.3g}}', b.low) || '-' || format('{{:.3g}}', b.high) as label, b.low, b.high,"
            f" (select count(*) from src where v{i} >= b.low and (v{i} < b.high or b.bin = b.bins - 1)) as \"count\""
            f" from (select cast(k as int) as bin, bins, lo + k * ((hi - lo) / bins) as low,"
            f" case when k = bins - 1 then hi else lo + (k + 1) * ((hi - lo) / bins) end as high"
            f" from (select min(v{i}) as lo, max(v{i}) as hi, {bins.format(n=f'count(v{i})')} as bins from src) r,"
            f" range(40) t(k) where k < bins) b"
        )
    values = ", ".join(f"cast({n} as double) as v{i}" for i, n in columns)
    return f"with src as (select {values} from {source}) {union(parts)}"


BINS = "cast(least(12, greatest(4, floor(sqrt({n})))) as int)"
HISTOGRAM_COLUMNS = [(i, n) for i, n in enumerate(LINEITEM_COLUMNS) if LINEITEM_COLUMNS[n] in NUMERIC_KINDS][:8]


@case("histograms", histogram_sql("lineitem", HISTOGRAM_COLUMNS, BINS))
def _(spark, sf_dir):
    return distribution.histograms(table(spark, sf_dir, "lineitem"))


DIRTY_HISTOGRAM_COLUMNS = [
    (i, n) for i, (n, k) in enumerate(DIRTY_LINEITEM_COLUMNS.items()) if k in NUMERIC_KINDS and n != "const_col"
]


@case("histograms_with_nulls", histogram_sql(LINEITEM_SQL, DIRTY_HISTOGRAM_COLUMNS, BINS))
def _(spark, sf_dir):
    names = [n for _, n in DIRTY_HISTOGRAM_COLUMNS]
    return distribution.histograms(dirty_lineitem(spark, sf_dir), names)


@case(
    "category_distributions",
    frequency_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, "n desc, value", "true")
    + ' select position, "column", cast(rank as int) as rank, value as label, n as "count" from freq'
    " where rank <= 8 and \"column\" in ('c_name', 'c_mktsegment', 'email', 'age_text')",
)
def _(spark, sf_dir):
    return profile.category_distributions(dirty_customer(spark, sf_dir))


@case(
    "sample_rows",
    "select * from orders order by o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority limit 20",
)
def _(spark, sf_dir):
    return rows.sample_rows(table(spark, sf_dir, "orders"), 20)


@case(
    "byte_size",
    f"select cast(sum(8 + coalesce(strlen(c_name), 0) + 8 + coalesce(strlen(c_mktsegment), 0)"
    f" + coalesce(strlen(email), 0) + coalesce(strlen(age_text), 0) + coalesce(strlen(created_at), 0)) as bigint)"
    f" as byte_size from {CUSTOMER_SQL}",
)
def _(spark, sf_dir):
    return stats.byte_size(dirty_customer(spark, sf_dir))


@case(
    "coerce_numeric",
    f"""select count(v) as parsed, round(sum(v), 4) as total, count(*) - count(v) as rejected from (
    select case when regexp_matches(trim(t), '{DUCK_NUMBER}') then try_cast(trim(t) as double) end as v from (
      select unnest([age_text, c_mktsegment, created_at, cast(c_acctbal as varchar), ' ' || age_text || ' ']) as t
      from {CUSTOMER_SQL}))""",
)
def _(spark, sf_dir):
    from gritstone.functions.values import coerce_numeric

    cells = dirty_customer(spark, sf_dir).selectExpr(
        "explode(array(age_text, c_mktsegment, created_at, cast(c_acctbal as string), concat(' ', age_text, ' '))) as t"
    )
    parsed = cells.select("t", coerce_numeric("t", cells.schema["t"].dataType).alias("v"))
    return parsed.agg(
        F.count("v").alias("parsed"),
        F.round(F.sum("v"), 4).alias("total"),
        (F.count("*") - F.count("v")).alias("rejected"),
    )


SCALARS = [
    "position", "column", "original_type", "inferred_type", "null_count", "null_percentage", "unique_count",
    "minimum", "maximum", "mean", "median", "mode", "std", "variance", "skewness", "kurtosis", "outlier_count",
    "invalid_count", "category_cardinality", "sensitive_data_probability",
]


def profile_sql() -> str:
    """The full column profile of lineitem, column by column."""
    parts = []
    for i, (n, k) in enumerate(LINEITEM_COLUMNS.items()):
        number = k in NUMERIC_KINDS
        v = f"cast({n} as double)"

        def measure(text: str) -> str:
            return text if number else "cast(null as double)"

        kind = "numeric" if number else "datetime" if k == "timestamp_ntz" else "categorical"
        outliers = (
            f"(select count(*) from lineitem s2, (select quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.75) as q3"
            f" from lineitem) where {v} < q1 - 1.5 * (q3 - q1) or {v} > q3 + 1.5 * (q3 - q1))"
            if number
            else "cast(0 as bigint)"
        )
        mode = f"(select {text_sql(n, k)} from (select {n}, count(*) as c from lineitem group by {n} order by c desc, {n} limit 1))"
        parts.append(
            f"select cast({i} as int) as position, '{n}' as \"column\", '{k}' as original_type, '{kind}' as inferred_type,"
            f" count(*) - count({n}) as null_count, cast(0 as double) as null_percentage, count(distinct {n}) as unique_count,"
            f" {text_sql(f'min({n})', k)} as minimum, {text_sql(f'max({n})', k)} as maximum,"
            f" {measure(f'round(avg({v}), 4)')} as mean, {measure(f'round(quantile_cont({v}, 0.5), 4)')} as median,"
            f" {mode} as mode, {measure(f'round(stddev_samp({v}), 4)')} as std, {measure(f'round(var_samp({v}), 2)')} as variance,"
            f" {measure(f'round(skewness({v}), 4)')} as skewness, {measure(f'round(kurtosis({v}), 4)')} as kurtosis,"
            f" {outliers} as outlier_count, cast(0 as bigint) as invalid_count,"
            f" {'count(distinct ' + n + ')' if kind == 'categorical' else 'cast(null as bigint)'} as category_cardinality,"
            f" cast(0 as double) as sensitive_data_probability from lineitem"
        )
    return union(parts)


@case("profile_columns", profile_sql())
def _(spark, sf_dir):
    found = profile.profile(table(spark, sf_dir, "lineitem")).column_table.select(*SCALARS)
    return found.withColumn("variance", F.round("variance", 2)).withColumn("median", F.round("median", 4))


@case(
    "profile_dataset",
    f"with src as (select * from {CUSTOMER_SQL}), d as ({dataset_sql(DIRTY_CUSTOMER_COLUMNS)})"
    f" select d.*, {quality_sql(DIRTY_CUSTOMER_COLUMNS)} as data_quality_score from d",
)
def _(spark, sf_dir):
    found = profile.profile(dirty_customer(spark, sf_dir)).dataset
    return found.drop("byte_size", "fingerprint")


@case(
    "profile_nested",
    "select cast(1 as int) as position, 'embedding' as \"column\", count(distinct embedding) as unique_count,"
    " count(*) - count(embedding) as null_count from embeddings",
)
def _(spark, sf_dir):
    found = profile.profile(table(spark, sf_dir, "embeddings")).column_table
    return found.where("column = 'embedding'").select("position", "column", "unique_count", "null_count")


@case(
    "profile_documents",
    "select cast(1 as int) as position, 'text' as \"column\", 'string' as inferred_type,"
    " count(distinct text) as unique_count from documents union all"
    " select 2, 'lang', 'categorical', count(distinct lang) from documents union all"
    " select 3, 'source', 'categorical', count(distinct source) from documents",
)
def _(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    found = profile.infer_types(texts).join(frequency.distinct_counts(texts), ["position", "column"])
    kept = found.where("column in ('text', 'lang', 'source')")
    return kept.selectExpr("position", "column", "inferred_type", "distinct_count as unique_count")


@case(
    "profile_summary",
    f"""with src as (select * from {LINEITEM_SQL}), outliers as ({outliers_sql("src", {n: k for n, k in DIRTY_LINEITEM_COLUMNS.items() if k in NUMERIC_KINDS or k == "timestamp_ntz"})}),
    m as ({per_column_sql("src", DIRTY_LINEITEM_COLUMNS, lambda n, k: f"'{'numeric' if k in NUMERIC_KINDS else 'categorical' if k == 'string' else 'other'}' as kind, count(*) - count({n}) as missing_values, count(*) as row_count, cast({len(DIRTY_LINEITEM_COLUMNS)} as bigint) as column_count")})
    select m.*, case when m."column" = 'const_col' then null else o.outlier_count end as outliers_iqr,
      {duplicates_sql(DIRTY_LINEITEM_COLUMNS)} as duplicate_rows
    from m left join outliers o on o."column" = m."column" """,
)
def _(spark, sf_dir):
    return profile.profile_summary(dirty_lineitem(spark, sf_dir))
