"""Cleaning steps and runs over the dirty tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gritstone.operators import cleaning
from gritstone.operators.filters import Filter
from gritstone.operators.profile import profile
from gritstone.plans.cleaning_plan import plan_cleaning
from suite.base import (
    CUSTOMER_SQL,
    DIRTY_CUSTOMER_COLUMNS,
    DUCK_EMAIL,
    LINEITEM_SQL,
    case,
    dirty_customer,
    dirty_lineitem,
    duck_number,
    table,
)
from suite.profile_cases import duplicates_sql, null_cells_sql

TEXTS = [c for c, k in DIRTY_CUSTOMER_COLUMNS.items() if k == "string"]


def blank_sql(c: str) -> str:
    return f"case when trim({c}) not in ('', 'na', 'n/a', 'null', 'none') then trim({c}) end"


def replaced(exprs: dict[str, str]) -> str:
    return ", ".join(f"{exprs[c]} as {c}" if c in exprs else c for c in DIRTY_CUSTOMER_COLUMNS)


TRIMMED = replaced({c: blank_sql(c) for c in TEXTS})
STEPS = f"""with src as (select * from {CUSTOMER_SQL}), base as (select distinct * from src),
trimmed as (select {TRIMMED} from base)"""


def number_of(c: str) -> str:
    return f"({duck_number(c, DIRTY_CUSTOMER_COLUMNS[c])})"


def median_of(c: str, source: str = "trimmed") -> str:
    return f"(select quantile_cont({number_of(c)}, 0.5) from {source})"


def mostly_numbers(c: str, source: str = "trimmed") -> str:
    return f"(select count({number_of(c)}) > 0.85 * count(*) from {source})"


def filled(c: str, source: str = "trimmed", otherwise: str | None = None) -> str:
    """Median fill of a mostly numeric column; others keep their number or take ``otherwise``."""
    kept = number_of(c) if otherwise is None else otherwise
    return f"case when {mostly_numbers(c, source)} then coalesce({number_of(c)}, {median_of(c, source)}) else {kept} end"


ISO = "case when regexp_matches(created_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then strftime(try_cast(created_at as date), '%Y-%m-%d') end"


@case("clean_dedup", f"select distinct * from {CUSTOMER_SQL}")
def _(spark, sf_dir):
    return cleaning.drop_duplicates(dirty_customer(spark, sf_dir))


@case("clean_text", f"with base as (select * from {CUSTOMER_SQL}) select {TRIMMED} from base")
def _(spark, sf_dir):
    return cleaning.normalize_text(dirty_customer(spark, sf_dir))


@case(
    "clean_text_changes",
    " union all ".join(
        f"select '{c}' as \"column\", count(*) filter (where {c} is distinct from {blank_sql(c)}) as changed from {CUSTOMER_SQL}"
        for c in TEXTS
    ),
)
def _(spark, sf_dir):
    return cleaning.changed_cells(dirty_customer(spark, sf_dir))


@case(
    "clean_median",
    f"with base as (select * from {CUSTOMER_SQL}) select "
    + replaced({c: f"round({filled(c, 'base')}, 6)" for c in ("c_custkey", "c_acctbal", "age_text")})
    + " from base",
)
def _(spark, sf_dir):
    found = cleaning.fill_numeric_median(dirty_customer(spark, sf_dir))
    for c in ("c_custkey", "c_acctbal", "age_text"):
        found = found.withColumn(c, F.round(c, 6))
    return found


def mode_of(c: str, source: str) -> str:
    return f"(select {c} from {source} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@case(
    "clean_mode",
    f"with base as (select * from {CUSTOMER_SQL}) select "
    + replaced({c: f"coalesce({c}, {mode_of(c, 'base')})" for c in DIRTY_CUSTOMER_COLUMNS})
    + " from base",
)
def _(spark, sf_dir):
    return cleaning.fill_mode(dirty_customer(spark, sf_dir))


@case(
    "clean_email_flag",
    f"select *, regexp_matches(coalesce(email, ''), '{DUCK_EMAIL}') as email_is_valid from {CUSTOMER_SQL}",
)
def _(spark, sf_dir):
    return cleaning.flag_emails(dirty_customer(spark, sf_dir))


@case("clean_dates", f"with base as (select * from {CUSTOMER_SQL}) select {replaced({'created_at': ISO})} from base")
def _(spark, sf_dir):
    return cleaning.standardize_dates(dirty_customer(spark, sf_dir))


@case("clean_dates_typed", "select * exclude (o_orderdate), strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders")
def _(spark, sf_dir):
    from suite.base import table

    return cleaning.standardize_dates(table(spark, sf_dir, "orders"))


def cap_sql(v: str, source: str) -> str:
    """Clip a numeric expression to the fences of the same expression over ``source``."""
    q1, q3 = (f"(select quantile_cont({v}, {p}) from {source})" for p in (0.25, 0.75))
    return (
        f"case when {q3} > {q1} and {v} is not null then"
        f" least(greatest({v}, {q1} - 1.5 * ({q3} - {q1})), {q3} + 1.5 * ({q3} - {q1})) else {v} end"
    )


@case(
    "clean_cap",
    f"with src as (select * from {LINEITEM_SQL}) select * replace (round({cap_sql('l_extendedprice', 'src')}, 4) as l_extendedprice) from src",
)
def _(spark, sf_dir):
    found = cleaning.cap_outliers(dirty_lineitem(spark, sf_dir))
    return found.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


RULE = STEPS + (
    " select "
    + replaced(
        {c: f"round({filled(c)}, 6)" for c in ("c_custkey", "c_acctbal", "age_text")} | {"created_at": ISO}
    )
    + f", regexp_matches(coalesce(email, ''), '{DUCK_EMAIL}') as email_is_valid from trimmed"
)


def rounded(df, columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@case("clean_rule", RULE)
def _(spark, sf_dir):
    found = cleaning.clean(dirty_customer(spark, sf_dir)).df
    return rounded(found, ["c_custkey", "c_acctbal", "age_text"])


STAGED = STEPS + (
    ", filled as (select "
    + replaced(
        {c: filled(c) for c in ("c_custkey", "age_text")}
        | {"c_acctbal": filled("c_acctbal", otherwise=f"coalesce(c_acctbal, {mode_of('c_acctbal', 'trimmed')})")}
        | {c: f"coalesce({c}, {mode_of(c, 'trimmed')})" for c in ("c_name", "c_mktsegment", "email", "created_at")}
    )
    + " from trimmed) select "
    + replaced({c: f"round({cap_sql(c, 'filled')}, 6)" for c in ("c_custkey", "c_acctbal", "age_text")})
    + " from filled"
)


@case("clean_staged", STAGED)
def _(spark, sf_dir):
    found = cleaning.clean_staged(dirty_customer(spark, sf_dir)).df
    return rounded(found, ["c_custkey", "c_acctbal", "age_text"])


@case(
    "clean_staged_filter",
    f"""with src as (select * from {CUSTOMER_SQL} where c_acctbal > 0)
    select count(*) as n, count(c_mktsegment) as segments from (select distinct * from src)""",
)
def _(spark, sf_dir):
    found = cleaning.clean_staged(dirty_customer(spark, sf_dir), Filter("c_acctbal", ">", 0), outliers=False).df
    return found.agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("segments"))


FINAL_COLUMNS = ", ".join([*DIRTY_CUSTOMER_COLUMNS, "email_is_valid"])


def changed_sql(c: str) -> str:
    return f"(select count(*) from base where {c} is distinct from {blank_sql(c)})"


def gaps_sql(c: str) -> str:
    """Cells that the median fills: none unless the column is mostly numbers."""
    return f"(select case when {mostly_numbers(c)} then count(*) - count({number_of(c)}) else 0 end from trimmed)"


MANIFEST_ROWS = [
    ("remove_duplicate_rows", "''", duplicates_sql(DIRTY_CUSTOMER_COLUMNS)),
    ("fill_missing_numeric_median", "'c_custkey'", gaps_sql("c_custkey")),
    ("trim_and_normalize_empty_text", "'c_name'", changed_sql("c_name")),
    ("fill_missing_numeric_median", "'c_acctbal'", gaps_sql("c_acctbal")),
    ("trim_and_normalize_empty_text", "'c_mktsegment'", changed_sql("c_mktsegment")),
    ("flag_invalid_email", "'email,email_is_valid'", f"(select count(*) from trimmed where not regexp_matches(coalesce(email, ''), '{DUCK_EMAIL}'))"),
    ("fill_missing_numeric_median", "'age_text'", gaps_sql("age_text")),
    ("standardize_date_format", "'created_at'", f"(select count({ISO}) from trimmed)"),
]
MANIFEST = (
    STEPS
    + ", steps as ("
    + " union all ".join(
        f"select {i} as o, '{name}' as operation, {columns} as columns, {n} as affected_rows"
        for i, (name, columns, n) in enumerate(MANIFEST_ROWS)
    )
    + ") select format('op_{:03d}', row_number() over (order by o)) as id, operation, columns, affected_rows"
    + " from steps where affected_rows > 0 or operation = 'flag_invalid_email'"
)


@case("clean_manifest", MANIFEST)
def _(spark, sf_dir):
    found = cleaning.clean(dirty_customer(spark, sf_dir)).manifest
    return found.select("id", "operation", "columns", "affected_rows")


@case(
    "clean_validation",
    f"""{STEPS}, after_d as (select cast(coalesce(sum(n - 1), 0) as bigint) as d from (select count(*) as n from ({RULE.split(STEPS)[1]}) group by {FINAL_COLUMNS}))
    select name, passed, case when bool_and(passed) over () then 'passed' else 'warning' end as status from (
      select 'dataset_exists' as name, true as passed
      union all select 'row_count_reasonable', (select count(*) from base) >= greatest(1, floor((select count(*) from src) * 0.5))
      union all select 'columns_preserved', true
      union all select 'duplicates_not_increased', (select d from after_d) <= {duplicates_sql(DIRTY_CUSTOMER_COLUMNS)})""",
)
def _(spark, sf_dir):
    return cleaning.clean(dirty_customer(spark, sf_dir)).validation


FINAL = f"final as ({RULE.split(STEPS)[1]})"
METRICS = (
    STEPS
    + f", {FINAL} "
    + " union all ".join(
        [f"select 'nulls_before' as metric, '{c}' as \"column\", count(*) - count({c}) as value from src" for c in DIRTY_CUSTOMER_COLUMNS]
        + [f"select 'nulls_after', '{c}', count(*) - count({c}) from final" for c in [*DIRTY_CUSTOMER_COLUMNS, "email_is_valid"]]
        + [
            f"select 'duplicates_before', null, {duplicates_sql(DIRTY_CUSTOMER_COLUMNS)}",
            "select 'duplicates_after', null, cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from final group by " + FINAL_COLUMNS + ")",
            "select 'transformed_values', null, cast(" + " + ".join(n for _, _, n in MANIFEST_ROWS) + " as bigint)",
        ]
    )
)


@case("clean_metrics", METRICS)
def _(spark, sf_dir):
    return cleaning.clean(dirty_customer(spark, sf_dir)).metrics


@case(
    "compare_versions",
    f"""with src as (select * from {CUSTOMER_SQL}), after as (select distinct * from src)
    select (select count(*) from src) as rows_before, (select count(*) from after) as rows_after,
      cast(7 as int) as columns_before, cast(7 as int) as columns_after, {duplicates_sql(DIRTY_CUSTOMER_COLUMNS)} as duplicates_before,
      cast(0 as bigint) as duplicates_after, {null_cells_sql(DIRTY_CUSTOMER_COLUMNS)} as null_cells_before,
      {null_cells_sql(DIRTY_CUSTOMER_COLUMNS).replace('from src', 'from after')} as null_cells_after,
      cast({' + '.join(f"greatest(0, (select count(*) - count({c}) from src) - (select count(*) - count({c}) from after))" for c in DIRTY_CUSTOMER_COLUMNS)} as bigint) as transformed_values,
      'passed' as validation_status""",
)
def _(spark, sf_dir):
    before = dirty_customer(spark, sf_dir)
    return cleaning.compare(before, cleaning.drop_duplicates(before))


@case(
    "custom_transform",
    f"select c_custkey, c_acctbal * 2 as doubled, upper(c_mktsegment) as segment from {CUSTOMER_SQL} where c_acctbal is not null",
)
def _(spark, sf_dir):
    def change(df):
        kept = df.where("c_acctbal is not null")
        return kept.selectExpr("c_custkey", "c_acctbal * 2 as doubled", "upper(c_mktsegment) as segment")

    return cleaning.apply_transform(dirty_customer(spark, sf_dir), change).df


@case(
    "custom_transform_batches",
    "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem",
)
def _(spark, sf_dir):
    def per_batch(batch):
        net = pc.multiply(batch["l_extendedprice"], pc.subtract(1.0, batch["l_discount"]))
        return pa.RecordBatch.from_arrays([net, batch["l_orderkey"], batch["l_linenumber"]], ["net", "l_orderkey", "l_linenumber"])

    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]
    schema = "l_orderkey bigint, l_linenumber int, net double"
    return cleaning.apply_batches(table(spark, sf_dir, "lineitem"), per_batch, schema, columns).df


PLAN_ROWS = [
    ("remove_duplicates", "", True, 0.92),
    ("fill_missing_median", "c_custkey", False, 0.78),
    ("trim_normalize_text", "c_name", False, 0.84),
    ("fill_missing_median", "c_acctbal", False, 0.78),
    ("trim_normalize_text", "c_mktsegment", False, 0.84),
    ("trim_normalize_text", "email", False, 0.84),
    ("validate_email", "email", False, 0.86),
    ("trim_normalize_text", "age_text", False, 0.84),
    ("parse_dates", "created_at", False, 0.76),
]


def needed(kind: str, column: str) -> str:
    if kind == "remove_duplicates":
        return f"{duplicates_sql(DIRTY_CUSTOMER_COLUMNS)} > 0"
    if kind == "fill_missing_median":
        return f"(select count(*) - count({column}) from src) > 0"
    return "true"


@case(
    "clean_plan",
    f"""with src as (select * from {CUSTOMER_SQL}), steps as ({" union all ".join(
        f"select {i} as o, '{k}' as operation_type, '{c}' as columns, {str(d).lower()} as destructive, cast({p} as double) as confidence where {needed(k, c)}"
        for i, (k, c, d, p) in enumerate(PLAN_ROWS))})
    select format('operation_{{:03d}}', row_number() over (order by o)) as id, operation_type, columns, destructive, confidence from steps""",
)
def _(spark, sf_dir):
    found = plan_cleaning(profile(dirty_customer(spark, sf_dir))).operations
    return found.select("id", "operation_type", "columns", "destructive", "confidence")
