"""Read-only SQL cell: what a caller can write over ``dataset``."""

from __future__ import annotations

from gritstone.operators.sql_cell import run_sql
from suite.base import case, table


def cell(name: str, source: str, query: str, oracle: str | None = None):
    """Register a cell over one table; the oracle reads the same table as ``dataset``."""
    duck = (oracle or query).replace("dataset", source)

    @case(name, duck)
    def _(spark, sf_dir):
        return run_sql(table(spark, sf_dir, source), query).df


cell(
    "sql_basic",
    "lineitem",
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(avg(l_extendedprice), 4) as avg_price,
       count(*) as n from dataset where l_shipdate < timestamp '1998-09-02 00:00:00'
       group by l_returnflag, l_linestatus order by 1, 2""",
)
cell(
    "sql_self_join",
    "orders",
    """with o as (select o_custkey, o_orderkey, o_totalprice from dataset),
       c as (select o_custkey, max(o_totalprice) as top from dataset group by o_custkey)
       select o.o_orderkey, o.o_custkey, c.top from o join c on o.o_custkey = c.o_custkey and o.o_totalprice = c.top""",
)
cell(
    "sql_outer_join",
    "orders",
    """with a as (select o_custkey, count(*) as urgent from dataset where o_orderpriority = '1-URGENT' group by o_custkey),
       b as (select o_custkey, count(*) as finished from dataset where o_orderstatus = 'F' group by o_custkey)
       select coalesce(a.o_custkey, b.o_custkey) as o_custkey, urgent, finished
       from a full outer join b on a.o_custkey = b.o_custkey""",
)
cell(
    "sql_semi",
    "orders",
    """select o_orderkey from dataset a left semi join
       (select o_custkey as k from dataset group by o_custkey having count(*) >= 12) b on a.o_custkey = b.k""",
    """select o_orderkey from dataset a semi join
       (select o_custkey as k from dataset group by o_custkey having count(*) >= 12) b on a.o_custkey = b.k""",
)
cell(
    "sql_anti",
    "orders",
    """select o_custkey, count(*) as n from dataset a left anti join
       (select distinct o_custkey as k from dataset where o_orderstatus = 'P') b on a.o_custkey = b.k group by o_custkey""",
    """select o_custkey, count(*) as n from dataset a anti join
       (select distinct o_custkey as k from dataset where o_orderstatus = 'P') b on a.o_custkey = b.k group by o_custkey""",
)
cell(
    "sql_exists",
    "orders",
    """select a.o_orderkey from dataset a where exists
       (select 1 from dataset b where b.o_custkey = a.o_custkey and b.o_orderstatus = 'P') and a.o_orderstatus <> 'P'""",
)
cell(
    "sql_filter_agg",
    "lineitem",
    """select l_linenumber, count(*) filter (where l_returnflag = 'R') as returned,
       sum(l_quantity) filter (where l_discount > 0.05) as discounted from dataset group by all""",
)
cell(
    "sql_grouping_sets",
    "lineitem",
    """select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g from dataset
       group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())""",
)
cell("sql_cube", "lineitem", "select l_returnflag, l_linestatus, sum(l_quantity) as q from dataset group by cube (l_returnflag, l_linestatus)")
cell("sql_rollup", "lineitem", "select l_returnflag, l_linestatus, sum(l_quantity) as q from dataset group by rollup (l_returnflag, l_linestatus)")
cell(
    "sql_distinct_agg",
    "lineitem",
    "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from dataset group by l_returnflag",
)
cell(
    "sql_percentile",
    "lineitem",
    """select l_returnflag, median(l_quantity) as med, percentile_cont(0.9) within group (order by l_discount) as p90
       from dataset group by l_returnflag""",
    """select l_returnflag, median(l_quantity) as med, quantile_cont(l_discount, 0.9) as p90
       from dataset group by l_returnflag""",
)
cell(
    "sql_max_by",
    "lineitem",
    "select l_linenumber, max_by(l_orderkey, l_extendedprice) as k, max(l_extendedprice) as top from dataset group by l_linenumber",
)
cell(
    "sql_regr",
    "lineitem",
    "select l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, regr_count(l_extendedprice, l_quantity) as n from dataset group by l_linenumber",
)
cell(
    "sql_rank",
    "orders",
    """select o_orderkey, rank() over w as r, dense_rank() over w as d, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn,
       ntile(4) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as tile,
       round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd
       from dataset window w as (partition by o_custkey order by o_totalprice desc)""",
)
cell(
    "sql_lag",
    "orders",
    """select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous,
       lead(o_totalprice, 1, 0.0) over (partition by o_custkey order by o_orderdate, o_orderkey) as following,
       first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as first_key from dataset""",
    """select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous,
       lead(o_totalprice, 1, 0.0::double) over (partition by o_custkey order by o_orderdate, o_orderkey) as following,
       first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as first_key from dataset""",
)
cell(
    "sql_running_sum",
    "orders",
    """select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey
       rows between unbounded preceding and current row), 2) as running from dataset""",
)
cell(
    "sql_range_frame",
    "orders",
    """select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate
       range between interval 90 day preceding and current row) as recent from dataset""",
)
cell(
    "sql_union",
    "lineitem",
    "select l_suppkey as k from dataset where l_discount > 0.09 union select l_partkey from dataset where l_discount < 0.01",
)
cell(
    "sql_intersect",
    "lineitem",
    "select l_suppkey as k from dataset where l_returnflag = 'A' intersect select l_partkey from dataset where l_returnflag = 'R'",
)
cell(
    "sql_except",
    "lineitem",
    "select l_partkey as k from dataset except select l_partkey from dataset where l_quantity > 45",
)
cell(
    "sql_pivot",
    "lineitem",
    """select * from (select l_linenumber, l_returnflag, l_quantity from dataset)
       pivot (sum(l_quantity) for l_returnflag in ('A' as a, 'N' as n, 'R' as r))""",
    """select l_linenumber, sum(l_quantity) filter (where l_returnflag = 'A') as a, sum(l_quantity) filter (where l_returnflag = 'N') as n,
       sum(l_quantity) filter (where l_returnflag = 'R') as r from dataset group by l_linenumber""",
)
cell(
    "sql_unpivot",
    "lineitem",
    """select l_orderkey, l_linenumber, measure, amount from (select l_orderkey, l_linenumber, l_discount, l_tax from dataset)
       unpivot (amount for measure in (l_discount, l_tax))""",
)
cell(
    "sql_recursive",
    "orders",
    """with recursive steps as (select 1 as k, count(*) as n from dataset union all select k + 1, n from steps where k < 5)
       select k, n, round(sum(o_totalprice), 2) as total from steps join dataset on k = cast(left(o_orderpriority, 1) as int) group by k, n""",
)
cell(
    "sql_string",
    "customer",
    """select c_custkey, upper(c_mktsegment) || '-' || right(c_name, 4) as tag, length(c_name) as len,
       replace(c_name, 'Customer', 'C') as short, regexp_like(c_name, '9$') as nine from dataset where c_mktsegment ilike 'b%'""",
    """select c_custkey, upper(c_mktsegment) || '-' || right(c_name, 4) as tag, length(c_name) as len,
       replace(c_name, 'Customer', 'C') as short, regexp_matches(c_name, '9$') as nine from dataset where c_mktsegment ilike 'b%'""",
)
cell(
    "sql_date",
    "orders",
    """select date_part('year', o_orderdate) as y, cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n
       from dataset group by 1, 2""",
)
cell(
    "sql_math",
    "lineitem",
    """select l_orderkey, l_linenumber, l_partkey div 7 as d, l_partkey % 7 as r, round(sqrt(l_extendedprice), 4) as s,
       cast(floor(l_quantity / 3) as bigint) as f, abs(l_suppkey - l_partkey) as a, l_quantity::int as q from dataset""",
    """select l_orderkey, l_linenumber, l_partkey // 7 as d, l_partkey % 7 as r, round(sqrt(l_extendedprice), 4) as s,
       cast(floor(l_quantity / 3) as bigint) as f, abs(l_suppkey - l_partkey) as a, l_quantity::int as q from dataset""",
)
cell(
    "sql_array",
    "embeddings",
    """select vec_id, cardinality(filter(embedding, x -> x > 0)) as positive,
       round(aggregate(embedding, 0D, (a, x) -> a + x * x), 4) as norm from dataset""",
    """select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as int) as positive,
       round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm from dataset""",
)
cell(
    "sql_json",
    "events",
    "select event_type, sum(cast(get_json_object(props, '$.k') as bigint)) as total, count(*) as n from dataset group by event_type",
    "select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, count(*) as n from dataset group by event_type",
)
cell(
    "sql_case",
    "orders",
    """select case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'medium' else 'small' end as size,
       count(*) as n, coalesce(nullif(o_orderstatus, 'P'), 'open') as status from dataset group by 1, 3""",
)
