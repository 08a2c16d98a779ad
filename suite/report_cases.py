"""Report tables, chart data and the staged workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.operators import charts
from gritstone.operators.filters import Filter
from gritstone.operators.profile import profile
from gritstone.operators.report import report
from gritstone.plans.stages import SHORT_FLOW, run_stages
from gritstone.runtime import scratch_path, small_frame
from gritstone.sources.versions import VersionStore
from suite.base import (
    CUSTOMER_SQL,
    DIRTY_CUSTOMER_COLUMNS,
    DIRTY_LINEITEM_COLUMNS,
    DUCK_EMAIL,
    LINEITEM_COLUMNS,
    LINEITEM_SQL,
    NUMERIC_KINDS,
    case,
    dirty_customer,
    dirty_lineitem,
    per_column_sql,
    table,
)
from suite.profile_cases import (
    dataset_sql,
    duplicates_sql,
    histogram_sql,
    kind_sql,
    matrix_sql,
    null_cells_sql,
    outliers_sql,
    pearson_sql,
    quality_sql,
)

# Shared parts of the report SQL: nulls, outliers, invalid e-mails and the findings they lead to.
BASE = f"""with src as (select * from {CUSTOMER_SQL}),
d as ({dataset_sql(DIRTY_CUSTOMER_COLUMNS)}),
nulls as ({per_column_sql("src", DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"count(*) - count({n}) as n, round((count(*) - count({n})) * 100.0::double / count(*), 2) as share")}),
outliers as ({outliers_sql("src", DIRTY_CUSTOMER_COLUMNS)}),
invalid as (select count(*) as n from src where email is not null and not regexp_matches(trim(email), '{DUCK_EMAIL}')),
found as (
  select position as p, 0 as o, case when share >= 50 then 'Critical' else 'Medium' end as severity, "column", cast(share as varchar) || '% missing values' as problem, n, share as percentage, 'Review or impute missing values' as action from nulls where n > 0
  union all select 4, 1, 'High', 'email', n || ' invalid email values', n, round(n * 100.0::double / (select row_count from d), 2), 'Flag invalid values and replace only after review' from invalid where n > 0
  union all select position, 2, 'Low', "column", outlier_count || ' statistical outlier candidates', outlier_count, round(outlier_count * 100.0::double / (select row_count from d), 2), 'Review outliers before removal' from outliers where outlier_count > 0
  union all select 99, 3, 'Medium', 'Dataset', duplicate_rows || ' duplicate rows', duplicate_rows, round(duplicate_rows * 100.0::double / row_count, 2), 'Deduplicate only after confirming record identity' from d where duplicate_rows > 0),
placed as (select cast(row_number() over (order by list_position(['Critical', 'High', 'Medium', 'Low'], severity), p, o) as int) as place, * from found)"""


def reported(spark, sf_dir):
    return report(profile(dirty_customer(spark, sf_dir)))


@case(
    "report_metrics",
    f"""{BASE}, m as (select row_count, column_count, null_cells, duplicate_rows, {quality_sql(DIRTY_CUSTOMER_COLUMNS)} as quality,
      (select n from invalid) as invalid, (select sum(outlier_count) from outliers) as outliers, (select count(*) from placed) as issues from d)
    select cast(place as int) as place, label, value, status from (
    select 1 as place, 'Quality score' as label, format('{{:.1f}}%', quality) as value, case when quality >= 85 then 'success' else 'warning' end as status from m
    union all select 2, 'Rows', format('{{:,}}', row_count), 'neutral' from m
    union all select 3, 'Columns', cast(column_count as varchar), 'neutral' from m
    union all select 4, 'Missing values', format('{{:.1f}}%', null_cells * 100.0::double / (row_count * column_count)), case when null_cells > 0 then 'warning' else 'success' end from m
    union all select 5, 'Duplicate rows', format('{{:,}}', duplicate_rows), case when duplicate_rows > 0 then 'warning' else 'success' end from m
    union all select 6, 'Invalid values', format('{{:,}}', invalid), case when invalid > 0 then 'warning' else 'success' end from m
    union all select 7, 'Outliers', format('{{:,}}', cast(outliers as bigint)), case when outliers > 0 then 'warning' else 'success' end from m
    union all select 8, 'Detected issues', cast(issues as varchar), case when issues > 0 then 'warning' else 'success' end from m)""",
)
def _(spark, sf_dir):
    return reported(spark, sf_dir).metrics.select("place", "label", "value", "status")


@case(
    "report_findings",
    f'{BASE} select place, severity, "column", problem, n as affected_rows, percentage, action as suggested_action from placed where place <= 30',
)
def _(spark, sf_dir):
    found = reported(spark, sf_dir).findings
    return found.select("place", "severity", "column", "problem", "affected_rows", "percentage", "suggested_action")


@case(
    "report_columns",
    f"""{BASE}, kinds as ({per_column_sql("src", DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"{kind_sql(n, k)} as inferred_type, count(*) - count({n}) as null_count")}),
    firsts as (select "column", min_by(problem, place) as issue, min_by(action, place) as act from placed group by "column")
    select k.position, k."column", inferred_type, null_count, issue, coalesce(act, 'No action required') as suggested_action,
      case when issue is null then 'ready' else 'review' end as status from kinds k left join firsts f on f."column" = k."column" """,
)
def _(spark, sf_dir):
    found = reported(spark, sf_dir).columns
    return found.select("position", "column", "inferred_type", "null_count", "issue", "suggested_action", "status")


@case(
    "report_completeness",
    f'{BASE} select cast(row_number() over (order by share desc, position) as int) as place, "column", round(100 - share, 2) as percent from nulls',
)
def _(spark, sf_dir):
    return reported(spark, sf_dir).completeness


@case(
    "report_types",
    f"""with t as ({per_column_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"{kind_sql(n, k)} as inferred_type")})
    select inferred_type, count(*) as columns from t group by inferred_type""",
)
def _(spark, sf_dir):
    return reported(spark, sf_dir).types


@case("report_severity", f"{BASE} select severity, count(*) as findings from placed where place <= 30 group by severity")
def _(spark, sf_dir):
    return reported(spark, sf_dir).severity


@case(
    "report_summary",
    f"""{BASE} select format('{{:,}} rows in {{}} columns were profiled: {{}} findings, {{:,}} missing cells, {{:,}} invalid values.',
      row_count, column_count, (select count(*) from placed where place <= 30), null_cells, (select n from invalid)) as summary from d""",
)
def _(spark, sf_dir):
    return reported(spark, sf_dir).summary


@case(
    "chart_missingness",
    f"""with t as ({per_column_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS, lambda n, k: f"round((count(*) - count({n})) * 100.0::double / count(*), 2) as value")})
    select "column", value from t""",
)
def _(spark, sf_dir):
    return charts.chart_missingness(dirty_lineitem(spark, sf_dir))


@case(
    "chart_heatmap",
    f"with cells as ({matrix_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS, pearson_sql)}) select x, y, value from cells where value is not null order by x_position, y_position limit 100",
)
def _(spark, sf_dir):
    return charts.chart_heatmap(dirty_lineitem(spark, sf_dir))


@case(
    "chart_data",
    "select o_orderpriority, round(avg(o_totalprice), 4) as value from orders where o_orderstatus is distinct from 'P' group by o_orderpriority",
)
def _(spark, sf_dir):
    chart = charts.ChartConfig("bar", "o_orderpriority", "o_totalprice", agg="mean", filters=[Filter("o_orderstatus", "!=", "P")])
    return charts.chart_data(table(spark, sf_dir, "orders"), chart).withColumn("value", F.round("value", 4))


@case("chart_preview", "select p_brand, count(*) as value from part group by p_brand")
def _(spark, sf_dir):
    chart = charts.ChartConfig("histogram", "p_brand", "p_size", agg="sum")
    return charts.chart_data(table(spark, sf_dir, "part"), chart, preview=True)


PLOTTED = [(i, n) for i, n in enumerate(LINEITEM_COLUMNS) if LINEITEM_COLUMNS[n] in NUMERIC_KINDS]


@case("eda_hist", histogram_sql("lineitem", PLOTTED, "24"))
def _(spark, sf_dir):
    return charts.eda_hist(table(spark, sf_dir, "lineitem"))


@case(
    "eda_share",
    f"select coalesce(l_returnflag, 'nan') as label, count(*) as \"count\" from {LINEITEM_SQL} group by 1 order by 2 desc, 1 limit 8",
)
def _(spark, sf_dir):
    return charts.eda_share(dirty_lineitem(spark, sf_dir))


@case(
    "eda_quartile",
    """with q as (select quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) as e from lineitem),
    b as (select cast(k as int) as bucket, e[k + 1] as low, e[k + 2] as high from q, range(4) t(k))
    select bucket, round(low, 4) as low, round(high, 4) as high, (select count(*) from lineitem where l_extendedprice <= high and (bucket = 0 or l_extendedprice > low)) as "count" from b""",
)
def _(spark, sf_dir):
    found = charts.eda_quartile(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select("bucket", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


@case("eda_scatter", "select p_partkey as x, p_size as y, p_name as hue from part")
def _(spark, sf_dir):
    return charts.eda_scatter(table(spark, sf_dir, "part"))


@case(
    "eda_box",
    " union all ".join(
        f"select '{n}' as feature, count({n}) as n, cast(min({n}) as double) as minimum, round(quantile_cont({n}::double, 0.25), 4) as q25,"
        f" round(quantile_cont({n}::double, 0.5), 4) as median, round(quantile_cont({n}::double, 0.75), 4) as q75, cast(max({n}) as double) as maximum from lineitem"
        for _, n in PLOTTED
    ),
)
def _(spark, sf_dir):
    found = charts.eda_box(table(spark, sf_dir, "lineitem"))
    rounded = [F.round(c, 4).alias(c) for c in ("q25", "median", "q75")]
    return found.select("feature", "n", "minimum", *rounded, "maximum")


@case(
    "eda_pairs",
    """select o_orderkey, o_custkey, o_totalprice from orders
    order by cast(('0x' || left(md5(concat_ws('|', '42', cast(o_orderkey as varchar))), 13)) as bigint) limit 300""",
)
def _(spark, sf_dir):
    return charts.eda_pairs(table(spark, sf_dir, "orders"), ["o_orderkey"], rows=300)


@case(
    "eda_missing",
    per_column_sql(LINEITEM_SQL, DIRTY_LINEITEM_COLUMNS, lambda n, k: f"count(*) - count({n}) as missing"),
)
def _(spark, sf_dir):
    found = charts.eda_missing(dirty_lineitem(spark, sf_dir))
    positions = list(DIRTY_LINEITEM_COLUMNS)
    place = F.expr("case column " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(positions)) + " end")
    return found.select(place.alias("position"), "column", "missing")


def flow(spark, sf_dir, stages):
    store = VersionStore(spark, scratch_path(spark, "flow"))
    source = table(spark, sf_dir, "customer").drop("c_name")
    return run_stages(
        source, store, stages, "c_acctbal", "c_custkey", row_filter=Filter("c_nationkey", "<", 20),
        models_root=scratch_path(spark, "models"),
    )


def status_rows(spark, results):
    rows = [(i, r.stage, r.status, r.version, r.error and str(r.error)) for i, r in enumerate(results)]
    return small_frame(spark, rows, "place int, stage string, status string, version int, error string")


@case("workflow")
def _(spark, sf_dir):
    stages = [
        "load_data", "explore_data", "visualize_data", "clean_data", "feature_engineering", "prepare_data",
        "split_data", "train_model", "tune_evaluate", "save_predict",
    ]
    return status_rows(spark, flow(spark, sf_dir, stages))


@case("workflow_short")
def _(spark, sf_dir):
    return status_rows(spark, flow(spark, sf_dir, list(SHORT_FLOW)))
