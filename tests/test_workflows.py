"""Sources, versions, SQL guard, splits, cleaning invariants and models."""

import pytest

from gritstone.operators import models
from gritstone.operators.cleaning import clean, clean_staged, drop_duplicates
from gritstone.operators.filters import filter_expression
from gritstone.operators.profile import profile
from gritstone.operators.split import train_test_split
from gritstone.operators.sql_cell import run_sql
from gritstone.plans.cleaning_plan import plan_cleaning
from gritstone.plans.stages import run_stages
from gritstone.runtime import scratch_path
from gritstone.sources.reader import format_of, read_dataset
from gritstone.sources.versions import VersionStore
from suite.base import dirty_customer, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customer(spark):
    return dirty_customer(spark, SF)


def test_sql_guard(spark, customer):
    assert run_sql(customer, "select count(*) as updated_at from dataset").df.columns == ["updated_at"]
    assert run_sql(customer, "select 'drop; table' as t from dataset limit 1").total == 1
    assert not spark.catalog.tableExists("dataset")
    for bad in (
        "drop table dataset", "select 1; select 2", "select * from parquet.`/tmp/x`", "insert into dataset values (1)",
        "select reflect('java.lang.System', 'exit', 0) from dataset", "with a as (select 1) delete from dataset",
        "select " + "1," * 15_000 + "1 from dataset",
    ):
        with pytest.raises(ValueError):
            run_sql(customer, bad)


def test_sql_cell_reads_the_plan(spark, customer):
    spark.range(3).createOrReplaceTempView("other_view")
    for bad in (
        "select transform(c_name) using 'cat' as (x) from dataset",
        "select 1 -- '\n, reflect('java.lang.System', 'currentTimeMillis')",
        "select java_method('java.lang.System', 'currentTimeMillis') as t",
        "select * from other_view",
        "select (select count(*) from other_view) as n from dataset",
        "with dataset as (select * from other_view) select * from dataset",
        "select * from parquet.`/root/testdata/sf0.001/region.parquet`",
        "select 1) union (select 2",
        "drop view dataset",
        "set spark.sql.ansi.enabled = false",
        "select 1; select 2",
    ):
        with pytest.raises(Exception):
            run_sql(customer, bad)
    renamed = customer.withColumnRenamed("c_name", "load").withColumnRenamed("c_acctbal", "copy")
    assert run_sql(renamed, "select max(load) as a, sum(copy) as b from dataset -- it's fine").total == 1
    query = "with t as (select c_mktsegment as k, count(*) as n from dataset group by 1) select * from t where n > (select avg(n) from t) order by k"
    assert run_sql(customer, query).total > 0


def test_sql_restores_a_view_of_the_same_name(spark, customer):
    spark.range(3).createOrReplaceTempView("dataset")
    assert run_sql(customer, "select count(*) as n from dataset").df.first()["n"] == customer.count()
    assert spark.table("dataset").count() == 3
    spark.catalog.dropTempView("dataset")


def test_filter_expression_refuses_queries(spark, customer):
    assert filter_expression(customer, "").count() == customer.count()
    # Keys 0 to 4, and the injected copy of key 0.
    assert filter_expression(customer, "c_mktsegment == 'select' | c_custkey < 5").count() == 6
    for bad in ("c_custkey in (select 1)", "reflect('a', 'b')", "nothing > 1"):
        with pytest.raises(ValueError):
            filter_expression(customer, bad)


def test_formats():
    assert [format_of(p) for p in ("a/b.CSV", "x.tsv", "d.parquet/", "e.jsonl", "plain")] == [
        "csv", "tsv", "parquet", "jsonl", "csv",
    ]
    with pytest.raises(ValueError):
        format_of("old.xls")


def test_csv_types_and_gaps(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text('i,d,b,s,e\n1,1.5,True,"a ""q"", x",\n 2,NA,false,"two\nlines",\n,nan,TRUE,None,\n')
    df = read_dataset(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "double"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, 'a "q", x', None), (2, None, False, "two\nlines", None), (None, None, True, None, None),
    ]


def test_versions_are_immutable(spark, customer):
    store = VersionStore(spark, scratch_path(spark, "store"))
    dataset = store.create(customer, "customer.csv")
    assert store.promote(drop_duplicates(customer), dataset, "dedup") == 2
    assert store.read(dataset, 1).count() == customer.count()
    assert store.read(dataset).count() < customer.count()
    with pytest.raises(Exception):
        store.create(customer, "customer.csv", dataset)
    for version in (0, 3):
        with pytest.raises(KeyError):
            store.read(dataset, version)
    with pytest.raises(KeyError):
        store.read("nothing")


def test_promotion_after_an_interrupted_one(spark, customer, monkeypatch):
    from gritstone.sources import versions

    store = VersionStore(spark, scratch_path(spark, "store"))
    dataset = store.create(customer, "customer.csv")
    with monkeypatch.context() as broken:
        broken.setattr(versions, "dataset_summary", lambda df: 1 / 0)  # the table is written, its catalog row is not
        with pytest.raises(ZeroDivisionError):
            store.promote(customer, dataset, "first try")
    assert store.promote(customer.limit(3), dataset, "second try") == 2
    assert store.read(dataset).count() == 3 and store.list().count() == 2


def test_workbooks_from_files(spark, tmp_path):
    from gritstone.sources.reader import read_dataset
    from suite.source_cases import workbook

    (tmp_path / "a.xlsx").write_bytes(workbook(["id", "v", "v"], [[1, "a", "b"], [2, "c"]]))
    (tmp_path / "b.xlsx").write_bytes(workbook(["v", "id"], [["d", 3, "extra"]]))
    rows = {r.id: r.asDict() for r in read_dataset(spark, str(tmp_path), "xlsx").collect()}
    assert rows[1]["v"] == "a" and rows[1]["v.1"] == "b" and rows[2]["v.1"] is None
    assert rows[3]["v"] == "d" and rows[3]["Unnamed: 2"] == "extra"


def test_findings_are_counted_before_they_are_cut(spark):
    from gritstone.operators.distribution import histograms
    from gritstone.operators.report import report

    wide = spark.range(40).selectExpr(*[f"if(id % 4 = {i % 4}, null, id * {i + 1}) as c{i}" for i in range(35)])
    found = profile(wide)
    cut = report(found, max_findings=30)
    assert cut.findings.count() == 30 and report(found).findings.count() >= 35
    assert int(cut.metrics.where("label = 'Detected issues'").first()["value"]) >= 35
    assert cut.columns.where("status = 'ready'").count() == 0
    assert histograms(wide).select("column").distinct().count() == 35


def test_cleaning_is_idempotent(customer):
    result = clean(customer)
    assert result.status in {"passed", "warning"}
    again = drop_duplicates(result.df)
    assert drop_duplicates(again).count() == again.count()
    staged = clean_staged(customer).df
    nulls = " + ".join(f"count_if({c} is null)" for c in staged.columns)
    assert staged.selectExpr(f"{nulls} as n").first()["n"] == 0


def test_plan_of_a_clean_table(spark):
    plan = plan_cleaning(profile(spark.createDataFrame([(1, 2.0), (2, 3.0)], "a bigint, b double")))
    assert [s[0] for s in plan.steps] == ["copy_with_manifest"] and plan.risk_level == "low"


def test_profile_invariants(customer):
    found = profile(customer)
    assert 0 <= found.summary["data_quality_score"] <= 100
    filled = {c["column"]: found.summary["row_count"] - c["null_count"] for c in found.columns}
    counts = found.histograms.groupBy("column").sum("count").collect()
    assert all(filled[r["column"]] == r["sum(count)"] for r in counts)


def test_split_is_disjoint_and_complete(spark):
    part = table(spark, SF, "part")
    split = train_test_split(part, "p_partkey", "p_brand")
    assert split.train.count() + split.test.count() == part.count()
    assert split.test.count() == split.rows_test
    assert split.train.join(split.test, "p_partkey").count() == 0
    again = train_test_split(part.repartition(5), "p_partkey", "p_brand")
    assert {r[0] for r in again.test.select("p_partkey").collect()} == {r[0] for r in split.test.select("p_partkey").collect()}


def test_linear_model_learns_a_line(spark):
    data = spark.range(400).selectExpr("id", "cast(id as double) as x", "id * 3.0D + 7 as y", "if(id % 2 = 0, 'a', 'b') as g")
    run = models.train(data, "y", ["x", "g"], "regression", "linear_regression", key="id")
    assert run.metrics["r2"] > 0.9999 and run.importances[0][0] == "x"
    unseen = spark.createDataFrame([(1000, 1000.0, "z")], "id bigint, x double, g string")
    assert models.predict(run, unseen).first()["prediction"] == pytest.approx(3007, rel=0.01)


def test_binary_model_reports_auc(spark):
    data = spark.range(300).selectExpr("id", "cast(id as double) as x", "if(id > 150, 'yes', 'no') as y")
    run = models.train(data, "y", ["x"], model="logistic_regression", key="id")
    assert run.metrics["accuracy"] > 0.9 and run.metrics["auc"] > 0.99
    assert set(r[0] for r in run.predictions.select("prediction").distinct().collect()) <= {"yes", "no"}


def test_model_requests_are_checked(spark):
    part = table(spark, SF, "part")
    for target, features in (("nothing", ["p_size"]), ("p_size", ["p_size"]), ("p_size", []), ("p_size", ["nothing"])):
        with pytest.raises(ValueError):
            models.train(part, target, features)
    with pytest.raises(ValueError):
        models.train(part.limit(3), "p_size", ["p_retailprice"])


def test_workflow_stops_at_the_first_failure(spark):
    store = VersionStore(spark, scratch_path(spark, "flow"))
    source = table(spark, SF, "customer").drop("c_name")
    results = run_stages(source, store, ["clean_data", "prepare_data", "split_data"], "c_acctbal", "c_custkey")
    assert [(r.stage, r.status, r.version) for r in results] == [
        ("clean_data", "passed", 2), ("prepare_data", "passed", 3), ("split_data", "passed", None),
    ]
    with pytest.raises(ValueError):
        run_stages(source, store, ["nothing"])


def test_registered_workflow_searches_the_whole_grids(spark, monkeypatch):
    from suite import report_cases

    asked = {}

    def recorded(df, target, features, task, family, params, tune=False, **rest):
        asked[family] = (params, tune)
        raise RuntimeError("recorded")

    monkeypatch.setattr(models, "train", recorded)
    results = report_cases.flow(spark, SF, ["train_model"])
    assert [r.status for r in results] == ["failed"] and "recorded" in str(results[0].error)
    assert asked == {
        "linear_regression": ({"max_iter": 500}, False),
        "random_forest": ({"n_estimators": 120}, models.STAGED_GRIDS["random_forest"]),
        "gradient_boosting": ({}, models.STAGED_GRIDS["gradient_boosting"]),
    }
