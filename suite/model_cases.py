"""Models, metrics and the run registry."""

from __future__ import annotations

from gritstone.operators import metrics, models
from gritstone.runtime import scratch_path, small_frame
from suite.base import case, table


def evaluated(run, spark):
    """Metric rows of a run beside the number of rows it was tested on."""
    return run.metric_table(spark)


ORDER_FEATURES = ["o_totalprice", "o_orderpriority", "o_custkey"]


@case("model_logreg")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = models.train(orders, "o_orderstatus", ORDER_FEATURES, model="logistic_regression", key="o_orderkey")
    return evaluated(run, spark)


@case("model_logreg_balanced")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    run = models.train(
        labels, "quality", ["n_chars", "lang", "source"], "classification", "logistic_regression",
        {"C": 1.0, "class_weight": "balanced"}, key="doc_id",
    )
    return evaluated(run, spark)


@case("model_linreg")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(part, "p_retailprice", ["p_partkey", "p_size", "p_brand"], model="linear_regression", key="p_partkey")
    return evaluated(run, spark)


@case("model_rf_cls")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(
        part, "p_type", ["p_size", "p_retailprice", "p_brand"], params={"n_estimators": 20, "max_depth": 5}, key="p_partkey"
    )
    return evaluated(run, spark)


@case("model_rf_reg")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(
        part, "p_retailprice", ["p_partkey", "p_size", "p_type"], params={"n_estimators": 20, "max_depth": 6}, key="p_partkey"
    )
    return evaluated(run, spark)


@case("model_gbt_cls")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr("*", "c_acctbal > 4000 as rich")
    run = models.train(
        customer, "rich", ["c_acctbal", "c_nationkey", "c_mktsegment"], "classification", "gradient_boosting",
        {"n_estimators": 10}, key="c_custkey",
    )
    return evaluated(run, spark)


@case("model_gbt_multi")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = models.train(
        orders, "o_orderstatus", ["o_totalprice", "o_custkey"], model="gradient_boosting", params={"n_estimators": 3},
        key="o_orderkey",
    )
    return evaluated(run, spark)


@case("model_gbt_reg")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(
        part, "p_retailprice", ["p_partkey", "p_size"], model="gradient_boosting", params={"n_estimators": 10}, key="p_partkey"
    )
    return evaluated(run, spark)


@case("model_pca")
def _(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    run = models.train(
        lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_partkey"], "regression", "linear_regression",
        pca=3, key=["l_orderkey", "l_linenumber", "l_partkey"], filter_expr="l_quantity > 10 & l_returnflag in ['A', 'N']",
    )
    return run.importance_table(spark)


@case("model_tuned")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    run = models.train(
        customer, "c_mktsegment", ["c_acctbal", "c_nationkey"], model="logistic_regression", tune=True, key="c_custkey"
    )
    return evaluated(run, spark)


@case("feature_importance")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(
        part, "p_retailprice", ["p_partkey", "p_size", "p_type"], params={"n_estimators": 10, "max_depth": 4}, key="p_partkey"
    )
    return run.importance_table(spark)


def searched(spark, sf_dir):
    small = {"random_forest": {"n_estimators": 8, "max_depth": 4}, "gradient_boosting": {"n_estimators": 4}}
    return models.auto_train(table(spark, sf_dir, "supplier").drop("s_name"), "s_acctbal", "s_suppkey", small)


@case("model_comparison")
def _(spark, sf_dir):
    return searched(spark, sf_dir)[1]


@case("auto_train")
def _(spark, sf_dir):
    return evaluated(searched(spark, sf_dir)[0], spark)


@case("accuracy_report")
def _(spark, sf_dir):
    run, comparison = searched(spark, sf_dir)
    return models.accuracy_report(run, comparison)


@case("model_tuned_forest")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    run = models.train(part, "p_retailprice", ["p_partkey", "p_size", "p_type"], "regression", tune=True, key="p_partkey")
    return evaluated(run, spark)


@case("model_tuned_boosting")
def _(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    run = models.train(
        supplier, "s_acctbal", ["s_suppkey", "s_nationkey"], "regression", "gradient_boosting", tune=True, key="s_suppkey"
    )
    return evaluated(run, spark)


HASH = "cast(('0x' || left(md5(concat_ws('|', '42', cast(p_partkey as varchar))), 13)) as bigint)"


# A line fitted on the training rows, those that the hash of the key puts last, and all rows with its prediction.
LINE = f"""with s as (select *, rank() over (order by {HASH}) <= ceil(round(count(*) over () * 0.2, 9)) as held from part),
    line as (select regr_slope(p_retailprice, p_partkey) as slope, regr_intercept(p_retailprice, p_partkey) as base from s where not held),
    p as (select p_partkey, held, p_retailprice as actual, base + slope * p_partkey as prediction from s, line)"""


def fitted_line(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part, models.train(part, "p_retailprice", ["p_partkey"], "regression", "linear_regression", key="p_partkey")


@case("predict", f"{LINE} select p_partkey, actual, round(prediction, 4) as prediction from p where held")
def _(spark, sf_dir):
    run = fitted_line(spark, sf_dir)[1]
    return run.predictions.selectExpr("p_partkey", "actual", "round(prediction, 4) as prediction")


@case(
    "model_line",
    f"""{LINE}, f as (select * from p where held)
    select 'rmse' as metric, round(sqrt(avg((actual - prediction) ** 2)), 4) as value from f
    union all select 'mae', round(avg(abs(actual - prediction)), 4) from f
    union all select 'r2', round(1 - sum((actual - prediction) ** 2) / (var_pop(actual) * count(*)), 4) from f
    union all select 'train_r2', round((select 1 - sum((actual - prediction) ** 2) / (var_pop(actual) * count(*)) from p where not held), 4)""",
)
def _(spark, sf_dir):
    run = fitted_line(spark, sf_dir)[1]
    more = small_frame(spark, [("train_r2", run.train_score)], "metric string, value double")
    return run.metric_table(spark).unionByName(more).selectExpr("metric", "round(value, 4) as value")


@case("model_roundtrip", f"{LINE} select p_partkey, round(prediction, 4) as prediction from p")
def _(spark, sf_dir):
    part, run = fitted_line(spark, sf_dir)
    root = scratch_path(spark, "runs")
    again = models.load_run(root, models.save_run(run, root, spark), spark)
    return models.predict(again, part).selectExpr("p_partkey", "round(prediction, 4) as prediction")


# Two label columns and a score that both engines derive from the whole orders table.
LABELLED = """select *, case when o_totalprice > 250000 then 'F' when o_custkey % 3 = 0 then 'P' else 'O' end as guess,
    case when o_orderstatus = 'F' then 1 else 0 end as finished, o_totalprice + o_custkey as points from {orders}"""


def labelled(spark, sf_dir):
    return spark.sql(LABELLED, orders=table(spark, sf_dir, "orders"))


@case(
    "metrics_cls",
    f"""with p as ({LABELLED.format(orders="orders")}), l as (select label,
      (select count(*) from p where o_orderstatus = label and guess = label) as hit,
      (select count(*) from p where o_orderstatus = label) as support, (select count(*) from p where guess = label) as named
      from (select distinct o_orderstatus as label from p)),
    r as (select finished, rank() over (order by points) + (count(*) over (partition by points) - 1) / 2.0 as rk from p)
    select 'accuracy' as metric, round(sum(hit) / sum(support), 6) as value from l
    union all select 'f1', round(sum(case when hit = 0 then 0 else 2.0::double * hit / (support + named) end * support) / sum(support), 6) from l
    union all select 'auc', round((sum(rk) filter (where finished = 1) - count(*) filter (where finished = 1) * (count(*) filter (where finished = 1) + 1) / 2.0)
      / (count(*) filter (where finished = 1) * count(*) filter (where finished = 0)), 6) from r""",
)
def _(spark, sf_dir):
    found = metrics.classification_metrics(labelled(spark, sf_dir), "o_orderstatus", "guess")
    auc = metrics.area_under_curve(labelled(spark, sf_dir), "finished", "points")
    extra = spark.createDataFrame([("auc", auc)], "metric string, value double")
    return found.unionByName(extra).selectExpr("metric", "round(value, 6) as value")


@case(
    "metrics_reg",
    """with p as (select l_extendedprice as a, l_quantity * 2100 as p from lineitem)
    select 'rmse' as metric, round(sqrt(avg((a - p) * (a - p))), 4) as value from p
    union all select 'mae', round(avg(abs(a - p)), 4) from p
    union all select 'r2', round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(a)), 4) from p""",
)
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice as a", "l_quantity * 2100 as p")
    return metrics.regression_metrics(pairs, "a", "p").selectExpr("metric", "round(value, 4) as value")


@case(
    "confusion_matrix",
    f"""select o_orderstatus as actual, count(*) filter (where guess = 'F') as "pred_F", count(*) filter (where guess = 'O') as "pred_O",
    count(*) filter (where guess = 'P') as "pred_P" from ({LABELLED.format(orders="orders")}) group by o_orderstatus""",
)
def _(spark, sf_dir):
    return metrics.confusion_matrix(labelled(spark, sf_dir), "o_orderstatus", "guess")


# Comparison rows derived from the data: one "model" per supplier.
COMPARED = """select l_suppkey as id, case when l_suppkey % 2 = 0 then 'classification' else 'regression' end as task_type,
  0.8 + avg(l_discount) * 2.4 as test_score, abs(avg(l_tax) - 0.04) * 30 as overfit_gap from {lineitem} group by l_suppkey"""


@case(
    "review_gate",
    f"""select id, task_type, needs_improvement, task_type || case when needs_improvement then ' score or overfit gap needs improvement'
      else ' score is strong and overfit gap is controlled' end as reason from (
      select *, not (task_type = 'classification' and test_score >= 0.92 and overfit_gap <= 0.12
        or task_type = 'regression' and test_score >= 0.85 and overfit_gap <= 0.15) as needs_improvement
      from ({COMPARED.format(lineitem="lineitem")}))""",
)
def _(spark, sf_dir):
    compared = spark.sql(COMPARED, lineitem=table(spark, sf_dir, "lineitem"))
    return metrics.review_gate(compared).select("id", "task_type", "needs_improvement", "reason")


# Run rows derived from the data: one "run" per customer, some metrics missing.
RUNS = """select o_custkey as id, case when o_custkey % 2 = 0 then 'classification' else 'regression' end as task_type,
  case when o_custkey % 3 = 0 then min(o_totalprice) / 500000 end as auc, avg(o_totalprice) / 500000 as accuracy,
  max(o_totalprice) / 500000 as f1, case when o_custkey % 3 = 1 then min(o_totalprice) / 400000 end as r2,
  case when o_custkey % 5 <> 0 then max(o_totalprice) end as rmse, min(o_totalprice) as mae from {orders} group by o_custkey"""


@case(
    "leaderboard",
    f"""select id, key_metric, round(case key_metric when 'auc' then auc when 'accuracy' then accuracy when 'r2' then r2
      when 'rmse' then -rmse else -mae end, 6) as key_value from (select *, case when task_type = 'classification' then
      case when auc is not null then 'auc' else 'accuracy' end
      else case when r2 is not null then 'r2' when rmse is not null then 'rmse' else 'mae' end end as key_metric
      from ({RUNS.format(orders="orders")}))""",
)
def _(spark, sf_dir):
    runs = spark.sql(RUNS, orders=table(spark, sf_dir, "orders"))
    return metrics.leaderboard(runs).selectExpr("id", "key_metric", "round(key_value, 6) as key_value")
