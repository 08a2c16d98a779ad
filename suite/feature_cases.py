"""Feature preparation and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.operators import features
from gritstone.operators.split import split_summary, train_test_split
from gritstone.runtime import small_frame
from suite.base import CUSTOMER_SQL, LINEITEM_SQL, case, dirty_customer, dirty_lineitem, table


@case(
    "choose_target",
    """select case when brand then 'p_retailprice' when price then 'p_retailprice' else 'p_size' end as target from (
      select false as brand, count(distinct p_retailprice) > 1 and
      count(distinct p_retailprice) <= greatest(20, cast(floor(count(*) * 0.5) as bigint)) as price from part)""",
)
def _(spark, sf_dir):
    target = features.choose_target(table(spark, sf_dir, "part"))
    return small_frame(spark, [(target,)], "target string")


@case(
    "infer_task",
    """select 'p_size' as target, case when count(distinct p_size) <= least(20, greatest(2, floor(0.2 * count(*)))) then 'classification' else 'regression' end as task from part
    union all select 'p_brand', 'classification' union all
    select 'p_retailprice', case when count(distinct p_retailprice) <= 20 then 'classification' else 'regression' end from part""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = [
        ("p_size", features.infer_task(part, "p_size")),
        ("p_brand", features.infer_task(part, "p_brand")),
        ("p_retailprice", features.infer_task(part, "p_retailprice", "staged")),
    ]
    return small_frame(spark, rows, "target string, task string")


FLAGS = ["A", "N", "R"]
STATUSES = ["F", "O"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LINE_FLAGS = ", ".join(
    [f"cast(coalesce(l_returnflag = '{v}', false) as int) as \"l_returnflag_{v}\"" for v in FLAGS]
    + ["cast(l_returnflag is null as int) as l_returnflag_nan"]
)


@case("one_hot", f"select * exclude (l_returnflag), {LINE_FLAGS} from {LINEITEM_SQL}")
def _(spark, sf_dir):
    return features.one_hot(dirty_lineitem(spark, sf_dir))


@case(
    "numeric_features",
    f"select coalesce(c_custkey, 0) as c_custkey, coalesce(c_acctbal, 0) as c_acctbal, coalesce(cast(rich as int), 0) as rich from (select *, c_acctbal > 5000 as rich from {CUSTOMER_SQL})",
)
def _(spark, sf_dir):
    return features.numeric_features(dirty_customer(spark, sf_dir).withColumn("rich", F.expr("c_acctbal > 5000")))


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@case(
    "standard_scale",
    "select l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 4) as {c}" for c in SCALED)
    + " from lineitem",
)
def _(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    found = features.standard_scale(lineitem, SCALED)
    return found.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in SCALED])


@case("pca_variance")
def _(spark, sf_dir):
    numbers = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    return features.pca_90(features.one_hot(numbers)).variance


@case(
    "pca_two",
    """with c as (select abs(corr(l_quantity, l_extendedprice)) as r from lineitem)
    select cast(1 as int) as component, round((1 + r) / 2, 6) as explained_variance, round((1 + r) / 2, 6) as cumulative from c
    union all select 2, round((1 - r) / 2, 6), 1.0 from c""",
)
def _(spark, sf_dir):
    found = features.pca_90(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], share=1.0)
    return found.variance.selectExpr("component", "round(explained_variance, 6) as explained_variance", "round(cumulative, 6) as cumulative")


@case(
    "pca_scores",
    """with z as (select l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as a,
      (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as b from lineitem)
    select round(abs(a + b) / sqrt(2), 4) as score, count(*) as n from z group by 1""",
)
def _(spark, sf_dir):
    found = features.pca_90(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).df
    return found.selectExpr("round(abs(pca_1), 4) as score").groupBy("score").agg(F.count("*").alias("n"))


@case("pca_components")
def _(spark, sf_dir):
    return features.pca_90(table(spark, sf_dir, "lineitem")).df


@case(
    "variance_select",
    "select name, cast(row_number() over (order by v desc) as int) as place from ("
    + " union all ".join(f"select '{c}' as name, var_samp({c}) as v from {LINEITEM_SQL}" for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "const_col"))
    + ") where v > 1e-10",
)
def _(spark, sf_dir):
    names = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "const_col"]
    kept = features.variance_select(dirty_lineitem(spark, sf_dir), names)
    return small_frame(spark, [(n, i) for i, n in enumerate(kept, start=1)], "name string, place int")


@case(
    "drop_correlated",
    """select 'o_totalprice' as name union all
    select 'taxed' from orders having abs(corr(o_totalprice, o_totalprice * 1.19 + o_orderkey % 7)) <= 0.98
    union all select 'o_custkey' from orders having abs(corr(o_totalprice, o_custkey)) <= 0.98""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("taxed", F.expr("o_totalprice * 1.19 + o_orderkey % 7"))
    kept = features.drop_correlated(orders, ["o_totalprice", "taxed", "o_custkey"])
    return small_frame(spark, [(n,) for n in kept], "name string")


@case(
    "interactions",
    """select l_extendedprice, l_quantity, l_discount, round(l_extendedprice * l_quantity, 4) as l_extendedprice__x__l_quantity,
    round(l_extendedprice * l_discount, 4) as l_extendedprice__x__l_discount, round(l_quantity * l_discount, 4) as l_quantity__x__l_discount,
    round(l_extendedprice * l_extendedprice, 4) as l_extendedprice__squared, round(l_quantity * l_quantity, 4) as l_quantity__squared,
    round(l_discount * l_discount, 4) as l_discount__squared from lineitem""",
)
def _(spark, sf_dir):
    found = features.interaction_features(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount"))
    return found.select(*[F.round(c, 4).alias(c) if "__" in c else F.col(c) for c in found.columns])


HASH = "cast(('0x' || left(md5(concat_ws('|', '42', cast({k} as varchar))), 13)) as bigint)"


@case(
    "split",
    f"select c_custkey, rank() over (order by {HASH.format(k='c_custkey')}) <= ceil(round(count(*) over () * 0.2, 9)) as is_test from customer",
)
def _(spark, sf_dir):
    return train_test_split(table(spark, sf_dir, "customer"), "c_custkey").marked.select("c_custkey", "is_test")


@case(
    "split_stratified",
    f"""select c_custkey, c_mktsegment, rank() over (partition by c_mktsegment order by {HASH.format(k='c_custkey')})
    <= ceil(round(count(*) over (partition by c_mktsegment) * 0.2, 9)) as is_test from customer""",
)
def _(spark, sf_dir):
    split = train_test_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")
    return split.marked.select("c_custkey", "c_mktsegment", "is_test")


@case(
    "split_summary",
    """with c as (select p_brand, count(*) as n, ceil(round(count(*) * 0.2, 9)) as t from part group by p_brand),
    s as (select count(*) <= 20 and min(n) >= 2 as ok, sum(n) as total, sum(t) as strat from c)
    select 'p_brand' as target, 'classification' as task_type, cast(total as bigint) as rows_total,
      cast(total - case when ok then strat else ceil(round(total * 0.2, 9)) end as bigint) as rows_train,
      cast(case when ok then strat else ceil(round(total * 0.2, 9)) end as bigint) as rows_test,
      cast(3 as int) as feature_count, ok as stratified from s""",
)
def _(spark, sf_dir):
    split = train_test_split(table(spark, sf_dir, "part"), "p_partkey", "p_brand")
    return split_summary(split, "classification", 3)
