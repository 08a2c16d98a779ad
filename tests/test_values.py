"""Cell readings against hand-checked values."""

import math

import pytest
from pyspark.sql import types as T

from gritstone.functions.values import WHITESPACE, as_text, blank_to_null, coerce_numeric, is_email, parse_date
from gritstone.operators import distribution, frequency, rows, stats
from gritstone.operators.aggregate import query
from gritstone.operators.correlation import correlation
from gritstone.operators.filters import Filter, apply_filters


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_coerce_numeric(spark):
    cells = {
        " 7 ": 7.0, "1e3": 1000.0, "0x10": None, "1_0": None, "inf": math.inf, "-Infinity": -math.inf, "nan": None,
        "true": None, "1,000": None, "": None, "+5": 5.0, ".5": 0.5, "5.": 5.0, "1d": None, " 7　": 7.0,
    }
    df = column(spark, list(cells), "string")
    found = {r.v: r.n for r in df.select("v", coerce_numeric("v", T.StringType()).alias("n")).collect()}
    assert found == cells


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-01-05", "2024-01-05"), ("2024-01-05T10:00:00Z", "2024-01-05"), ("2024/1/5", "2024-01-05"),
        ("01/13/2024", "2024-01-13"), ("13/01/2024", "2024-01-13"), ("Jan 5, 2024", "2024-01-05"),
        ("5 March 2024", "2024-03-05"), ("20240105", "2024-01-05"), ("1997", "1997-01-01"), ("2024-02-30", None),
        ("Foo 5, 2024", None), ("7", None), ("junk", None),
    ],
)
def test_parse_date(spark, text, day):
    found = column(spark, [text], "string").selectExpr(f"cast({parse_date('v')} as string) as d").first()
    assert found["d"] == day


def test_number_text_follows_python(spark):
    values = [1e7, 123456789.25, 1e16, 1.5e-5, 0.00012345, 1e300, -12345678.5, 0.0, 0.1, math.inf, 900.1, 1e22]
    df = column(spark, values, "double")
    found = [r.t for r in df.selectExpr("v", f"{as_text('v', T.DoubleType())} as t").collect()]
    assert found == [repr(v) for v in values]


def test_blank_markers_and_emails(spark):
    df = column(spark, [" n/a ", "NA", "x\t", "", "none"], "string")
    assert [r.c for r in df.selectExpr(f"{blank_to_null('v')} as c").collect()] == [None, "NA", "x", None, None]
    df = column(spark, ["a@b.co", " a@b.co ", "a@b", "a b@c.d"], "string")
    assert [r.c for r in df.selectExpr(f"{is_email('v')} as c").collect()] == [True, True, False, False]
    assert all(c.isspace() for c in WHITESPACE)


def test_small_moments(spark):
    df = column(spark, [1.0, 2.0, 2.0, 3.0, 9.0, 4.0, 7.5], "double")
    row = stats.numeric_stats(df).first()
    assert (row["skewness"], row["kurtosis"]) == (0.9365, -0.6864)
    q = stats.quantile_table(df).first()
    assert (q["q25"], q["median"], q["q75"]) == (2.0, 3.0, 5.75)
    row = stats.numeric_stats(column(spark, [1.0] * 5, "double")).first()
    assert (row["skewness"], row["kurtosis"]) == (0.0, 0.0)
    row = stats.numeric_stats(column(spark, [1.0, 2.0], "double")).first()
    assert (row["skewness"], row["kurtosis"]) == (None, None)
    assert stats.numeric_stats(column(spark, [1.0], "double")).first()["std"] is None


def test_histogram_edges(spark):
    bins = distribution.histograms(column(spark, [0.0, 5.0, 10.0, 2.5, 7.5], "double"), bins=4)
    assert [r["count"] for r in bins.orderBy("bin").collect()] == [1, 1, 1, 2]
    assert distribution.histograms(column(spark, [1.0] * 5, "double")).count() == 1


def test_frequencies_break_ties_by_value(spark):
    df = column(spark, ["b", "a", "b", "a", "c"], "string")
    assert frequency.modes(df).first()["mode"] == "a"
    assert [(r.value, r.n) for r in frequency.top_values(df).orderBy("rank").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r.value for r in frequency.rare_values(df).collect()] == ["c"]
    assert frequency.modes(column(spark, [10, 9, 9, 10], "bigint")).first()["mode"] == "9"


def test_nan_is_null(spark):
    df = column(spark, [1.0, math.nan, None], "double")
    assert stats.null_stats(df).first()["null_count"] == 2
    assert stats.numeric_stats(df).first()["mean"] == 1.0


def test_nulls_and_duplicates(spark):
    df = column(spark, [None, None, 1.0], "double")
    assert rows.duplicate_count(df).first()[0] == 1
    kept = apply_filters(column(spark, [1.0, None], "double"), [Filter("v", "!=", 1)])
    assert [r.v for r in kept.collect()] == [None]
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    assert {r.g: r.value for r in query(df, ["g"], "sum", "v").collect()} == {"a": 0.0, "b": 2.0}
    assert {r.g: r.value for r in query(df, ["g"], "mean", "v").collect()} == {"a": None, "b": 2.0}


def test_spearman_on_pairs_with_nulls(spark):
    data = [(1.0, 4.0), (2.0, 3.0), (3.0, None), (4.0, 1.0), (None, 9.0)]
    df = spark.createDataFrame(data, "a double, b double")
    found = {(r.x, r.y): r.value for r in correlation(df, "spearman").collect()}
    assert found[("a", "b")] == -1.0 and found[("b", "b")] == 1.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    found = {(r.x, r.y): r.value for r in correlation(df).collect()}
    assert found[("a", "b")] is None and found[("a", "a")] == 1.0


def test_filter_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kept = apply_filters(df, [Filter("l_suppkey", ">", 3), Filter("l_returnflag", "=", "R")]).select("l_tax")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_suppkey,3)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan


def test_bad_requests(spark):
    df = column(spark, [1.0], "double")
    for call in (
        lambda: apply_filters(df, [Filter("w", "=", 1)]),
        lambda: apply_filters(df, [Filter("v", "like", 1)]),
        lambda: query(df, ["v"], "median", "v"),
        lambda: query(df, ["v"], "sum"),
        lambda: query(df, ["w"]),
    ):
        with pytest.raises(ValueError):
            call()
