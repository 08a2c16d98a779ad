"""The paths meant for large tables, forced on small ones and held against brute force."""

import numpy as np
import pandas as pd
import pytest

from gritstone.operators import correlation as corr
from gritstone.operators import distribution, order_stats
from gritstone.operators.rows import duplicate_count
from gritstone.operators.frequency import frequency_table, ranked_values


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    rng = np.random.default_rng(7)
    a = np.where(rng.random(6000) < 0.34, 5.0, rng.normal(0, 100, 6000).round(2))
    b = np.where(rng.random(6000) < 0.5, a * 2, rng.integers(0, 50, 6000)).astype(float)
    return pd.DataFrame({"a": a, "b": b})


PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("bracket", [1_000_000, 40])
def test_quantiles_by_selection(spark, skewed, monkeypatch, bracket):
    monkeypatch.setattr(order_stats, "BRACKET_VALUES", bracket)
    found = order_stats.quantiles(spark.createDataFrame(skewed), {"a": "a", "b": "b"}, PROBABILITIES)
    for c in ("a", "b"):
        assert found[c] == pytest.approx(list(skewed[c].quantile(PROBABILITIES)))


def test_selection_survives_a_wrong_sketch(spark, skewed, monkeypatch):
    def misleading(base, counts, searches):
        for s in searches:
            s.low, s.high = 1000.0, 2000.0

    monkeypatch.setattr(order_stats, "_sketch", misleading)
    found = order_stats.quantiles(spark.createDataFrame(skewed), {"a": "a"}, [0.25, 0.5])
    assert found["a"] == pytest.approx(list(skewed["a"].quantile([0.25, 0.5])))


def test_ranks_by_range_partition(spark, skewed):
    counted = spark.createDataFrame(skewed).groupBy("a").count().toDF("value", "n")
    found = {r["value"]: r["rank"] for r in distribution.average_ranks(counted).collect()}
    expected = skewed["a"].rank()
    assert all(found[v] == r for v, r in zip(skewed["a"], expected))


def test_spearman_with_hot_values(spark, skewed):
    found = {(r.x, r.y): r.value for r in corr.correlation(spark.createDataFrame(skewed), "spearman").collect()}
    assert found[("a", "b")] == pytest.approx(skewed.corr("spearman").loc["a", "b"], abs=1e-4)


def test_covariance_with_holes(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(500, 6)), columns=list("abcdef"))
    data.loc[rng.random(500) < 0.2, "c"] = None
    found = corr.correlation(spark.createDataFrame(data), "cov").collect()
    expected = data.cov()
    assert all(r.value == pytest.approx(expected.loc[r.x, r.y], abs=1e-4) for r in found)


def test_copies_are_combined_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("1 as k", "repeat('x', 100) as t")
    plan = duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert duplicate_count(df).first()[0] == 999


def test_top_values_limit_each_task(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ranked_values(frequency_table(df), 8, "n desc, value")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_selection_settles_a_balanced_column(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BRACKET_VALUES", 4)
    df = spark.range(1000).selectExpr("cast(id % 2 as double) as a", "cast(if(id < 400, 0, if(id < 800, 1, id)) as double) as b")
    found = order_stats.quantiles(df, {"a": "a", "b": "b"}, [0.25, 0.5, 0.75, 0.9])
    frame = df.toPandas()
    for c in ("a", "b"):
        assert found[c] == pytest.approx(list(frame[c].quantile([0.25, 0.5, 0.75, 0.9])))


@pytest.mark.parametrize("copies", [1, 600])
@pytest.mark.parametrize("target", [None, "y"])
def test_split_reports_the_rows_it_holds(spark, copies, target):
    from gritstone.operators.split import train_test_split

    df = spark.range(1000).selectExpr(f"if(id < {copies}, -1, id) as k", "id % 3 as y", "id as v")
    for seed in range(4):
        split = train_test_split(df, "k", target, seed=seed)
        assert split.test.count() == split.rows_test
        assert split.train.count() + split.rows_test == split.rows_total == 1000
        assert 200 <= split.rows_test <= 202  # one row more per class at most
    equal = df.select("k", "y")
    split = train_test_split(equal, None, target)
    assert split.test.count() == split.rows_test and split.train.count() == 1000 - split.rows_test


def test_profile_reads_texts_by_distinct_value(spark):
    from gritstone.operators import profile

    long_mail = "x" * 70 + "@example.org"
    texts = ["a", "12", " 7.5 ", "2024-05-17", "ann@b.org", None, long_mail, "y" * 80 + " no mail", "1" + "0" * 70]
    df = spark.createDataFrame([(i, texts[i % 9], None, float(i % 4)) for i in range(90)], "id long, t string, e string, v double")
    freq = frequency_table(df)
    found = profile._text_facts(df, freq)
    t = found["t"]
    assert (t["filled"], t["n"], t["date_count"], t["email_count"]) == (80, 30, 10, 20)
    assert (t["low_text"], t["high_text"], t["low"], t["high"]) == (" 7.5 ", "y" * 80 + " no mail", 7.5, 1e70)
    assert found["e"]["filled"] == 0 and found["e"]["mean"] is None and t["mean"] is not None
    columns = {c["column"]: c for c in profile.profile(df).columns}
    assert columns["t"]["null_count"] == 10 and columns["e"]["null_percentage"] == 100.0 and columns["v"]["mean"] == pytest.approx(1.4778, abs=0.1)
    only = profile.profile(df.select("t")).columns
    assert [c["null_count"] for c in only] == [10]


def test_fingerprint_adds_whole_numbers(spark):
    from gritstone.operators.rows import fingerprint

    df = spark.range(300).selectExpr("id", "if(id % 9 = 0, null, concat('t', id)) as t")
    plan = fingerprint(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(conv" not in plan and "shiftright" in plan
    import hashlib

    lines = ["\x1f".join((str(i), "\0" if i % 9 == 0 else f"t{i}")) for i in range(300)]
    assert fingerprint(df).first()[0] == f"300-{sum(int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines)}"
