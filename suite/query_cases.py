"""Filters and group-by queries."""

from __future__ import annotations

from gritstone.operators.aggregate import query
from gritstone.operators.filters import Filter, apply_filters, filter_expression, filter_hint
from suite.base import CUSTOMER_SQL, LINEITEM_SQL, case, dirty_customer, dirty_lineitem, duck_number, table

AGE = f"({duck_number('age_text', 'string')})"


def filtered(name: str, condition: str, *filters: Filter):
    """Register a filter over the dirty customer table."""

    @case(name, f"select * from {CUSTOMER_SQL} where {condition}")
    def _(spark, sf_dir):
        return apply_filters(dirty_customer(spark, sf_dir), list(filters))


filtered("filter_eq", f"{AGE} = 7", Filter("age_text", "=", "7"))
filtered("filter_eq_text", "c_mktsegment = 'BUILDING'", Filter("c_mktsegment", "=", "BUILDING"))
filtered("filter_ne", f"{AGE} is distinct from 7", Filter("age_text", "!=", 7))
filtered("filter_gt", "c_acctbal > 5000", Filter("c_acctbal", ">", "5000"))
filtered("filter_ge", "c_custkey >= 700", Filter("c_custkey", ">=", 700))
filtered("filter_lt", f"{AGE} < 10.5", Filter("age_text", "<", "10.5"))
filtered("filter_le", "created_at <= '2024-06-15'", Filter("created_at", "<=", "2024-06-15"))
filtered(
    "filter_contains",
    "regexp_matches(email, '(?i)USER1.*ORG')",
    Filter("email", "contains", "USER1.*ORG"),
)
filtered(
    "filter_not_contains",
    "not coalesce(regexp_matches(email, '(?i)user1'), false)",
    Filter("email", "not_contains", "user1"),
)
filtered("filter_is_null", "c_acctbal is null", Filter("c_acctbal", "is_null"))
filtered("filter_not_null", "email is not null", Filter("email", "not_null"))
filtered(
    "filter_multi",
    f"{AGE} >= 5 and not coalesce(regexp_matches(c_mktsegment, '(?i)n/a'), false) and c_acctbal is not null"
    " and email is distinct from 'user42@example.org'",
    Filter("age_text", ">=", 5),
    Filter("c_mktsegment", "not_contains", "n/a"),
    Filter("c_acctbal", "not_null"),
    Filter("email", "!=", "user42@example.org"),
)


@case("filter_hint", f"select * from {CUSTOMER_SQL} where lower(c_mktsegment) = 'machinery'")
def _(spark, sf_dir):
    return filter_hint(dirty_customer(spark, sf_dir), "c_mktsegment", "==", "Machinery")


@case("filter_hint_range", f"select * from {CUSTOMER_SQL} where {AGE} >= 25")
def _(spark, sf_dir):
    return filter_hint(dirty_customer(spark, sf_dir), "age_text", ">=", "25")


@case(
    "filter_expression",
    "select * from orders where o_totalprice > 100000 and o_orderpriority in ('1-URGENT', '2-HIGH') or not (o_orderstatus <> 'P')",
)
def _(spark, sf_dir):
    text = "o_totalprice > 100000 & o_orderpriority in ['1-URGENT', '2-HIGH'] | ~(o_orderstatus != 'P')"
    return filter_expression(table(spark, sf_dir, "orders"), text)


@case(
    "agg_count",
    f"select l_returnflag, l_linenumber, count(*) as value from {LINEITEM_SQL} group by all"
    " order by value desc, l_returnflag nulls first, l_linenumber limit 500",
)
def _(spark, sf_dir):
    return query(dirty_lineitem(spark, sf_dir), ["l_returnflag", "l_linenumber"])


def aggregated(agg: str, sql: str):
    @case(
        f"agg_{agg}",
        f"select l_returnflag, l_linenumber, round({sql}, 4) as value from {LINEITEM_SQL} group by all",
    )
    def _(spark, sf_dir):
        found = query(dirty_lineitem(spark, sf_dir), ["l_returnflag", "l_linenumber"], agg, "l_quantity")
        return found.selectExpr("l_returnflag", "l_linenumber", "round(value, 4) as value")


aggregated("sum", "coalesce(sum(l_quantity), 0)")
aggregated("mean", "avg(l_quantity)")
aggregated("min", "min(l_quantity)")
aggregated("max", "max(l_quantity)")


@case(
    "agg_text_sum",
    f"select c_mktsegment, coalesce(sum({AGE}), 0) as value from {CUSTOMER_SQL} group by c_mktsegment",
)
def _(spark, sf_dir):
    return query(dirty_customer(spark, sf_dir), ["c_mktsegment"], "sum", "age_text")


@case(
    "agg_filtered",
    f"select l_linenumber, count(*) as value from {LINEITEM_SQL} where l_returnflag is distinct from 'N'"
    " and l_quantity >= 10 group by l_linenumber",
)
def _(spark, sf_dir):
    conditions = [Filter("l_returnflag", "!=", "N"), Filter("l_quantity", ">=", 10)]
    return query(dirty_lineitem(spark, sf_dir), ["l_linenumber"], filters=conditions)


@case(
    "agg_topk",
    "select o_custkey, round(sum(o_totalprice), 2) as value from orders group by o_custkey"
    " order by sum(o_totalprice) desc, o_custkey limit 25",
)
def _(spark, sf_dir):
    found = query(table(spark, sf_dir, "orders"), ["o_custkey"], "sum", "o_totalprice", limit=25)
    return found.selectExpr("o_custkey", "round(value, 2) as value")


@case("global_count", f"select 'count' as metric, count(*) as value from {LINEITEM_SQL}")
def _(spark, sf_dir):
    return query(dirty_lineitem(spark, sf_dir))


@case(
    "global_agg",
    " union all ".join(
        f"select '{a}_l_quantity' as metric, round({s}(l_quantity), 4) as value from {LINEITEM_SQL}"
        for a, s in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"))
    ),
)
def _(spark, sf_dir):
    df = dirty_lineitem(spark, sf_dir)
    found = query(df, agg="sum", value_field="l_quantity")
    for agg in ("mean", "min", "max"):
        found = found.unionByName(query(df, agg=agg, value_field="l_quantity"))
    return found.selectExpr("metric", "round(value, 4) as value")


@case("head_rows", "select * from supplier order by all limit 50")
def _(spark, sf_dir):
    return query(table(spark, sf_dir, "supplier"), agg="mean", limit=50)
