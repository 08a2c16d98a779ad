"""Moments of all pairs from one scan, and rank correlations by null pattern."""

import uuid

import numpy as np
import pandas as pd
import pytest

from gritstone.operators.correlation import _masks, correlation, pair_moments
from gritstone.operators.gramian import Gramian


@pytest.fixture(scope="module")
def holes():
    r = np.random.default_rng(4)
    data = pd.DataFrame({f"c{i}": r.normal(size=400) * 10.0 ** (i % 5) + 1e6 * (i % 3) for i in range(8)})
    data["c1"] = data["c0"] * 2 + r.normal(size=400)
    data.loc[r.random(400) < 0.3, ["c2", "c3"]] = np.nan
    data.loc[r.random(400) < 0.2, "c4"] = np.nan
    data["c5"] = 0.1
    data["c6"] = np.nan
    data["c7"] = np.round(data["c7"] / 5000)
    return data


def jobs(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def frame(spark, data):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in data)).repartition(5)


def matrix(df):
    return {(r.x, r.y): r.value for r in df.collect()}


@pytest.mark.parametrize("method", ["pearson", "spearman", "cov"])
def test_matrices_equal_pandas(spark, holes, method):
    found = matrix(correlation(frame(spark, holes), method))
    plain = holes.cov() if method == "cov" else holes.corr(method)
    for x in holes:
        for y in holes:
            wanted = plain.loc[x, y]
            if method != "cov" and "c5" in (x, y):
                wanted = np.nan
            got = found[x, y]
            assert (got is None) == bool(np.isnan(wanted)), (x, y, got, wanted)
            if got is not None:
                assert got == pytest.approx(wanted, rel=1e-9, abs=6e-5), (x, y)


def test_jobs_do_not_grow_with_columns(spark):
    r = np.random.default_rng(1)
    wide = pd.DataFrame({f"v{i}": np.where(r.random(60) < 0.1 * (i % 3), np.nan, r.normal(size=60)) for i in range(100)})
    few, many = frame(spark, wide.iloc[:, :6]), frame(spark, wide)
    assert jobs(spark, lambda: pair_moments(many, many.columns)) == jobs(spark, lambda: pair_moments(few, few.columns)) <= 3
    moments = pair_moments(many, many.columns)
    both = wide[["v4", "v5"]].dropna()
    assert moments[4, 5][:2] == (len(both), pytest.approx(both.cov().loc["v4", "v5"] * (1 - 1 / len(both))))


def test_jobs_of_rank_correlations_do_not_grow_with_pairs(spark, holes):
    table = frame(spark, holes)
    counts = [jobs(spark, lambda n=n: correlation(table, "spearman", n).collect()) for n in (["c0", "c2"], ["c0", "c1", "c2", "c3", "c4", "c7"])]
    assert abs(counts[1] - counts[0]) <= 3, counts


def test_masks_are_shared_by_null_pattern():
    n = np.array([[10, 7, 7, 10], [7, 7, 7, 7], [7, 7, 7, 7], [10, 7, 7, 10]], float)
    masks = _masks(n)
    assert masks[0, 1] == masks[0, 2] != masks[0, 0] == masks[0, 3]
    assert len({masks[1, j] for j in range(4)}) == 1


def test_parts_add_up_in_any_order():
    r = np.random.default_rng(2)
    rows = r.normal(size=(300, 4)) * [1, 1e3, 1e-3, 1] + [1e7, 0, 5, 0]
    rows[r.random((300, 4)) < 0.2] = np.nan
    rows[:120, 3] = np.nan
    parts = []
    for begin in range(0, 300, 60):
        part = Gramian.empty(4)
        part.add_rows(rows[begin : begin + 60])
        parts.append(Gramian.unpacked(part.packed(), 4))
    forward, backward = Gramian.empty(4), Gramian.empty(4)
    for p in parts:
        forward = forward.plus(p)
    for p in reversed(parts):
        backward = backward.plus(p)
    plain = pd.DataFrame(rows)
    for sums in (forward.centred(), backward.centred()):
        covariance = sums.product / sums.n - sums.first / sums.n * (sums.first / sums.n).T
        assert covariance == pytest.approx((plain.cov() * (1 - 1 / sums.n)).to_numpy(), rel=1e-6)


@pytest.mark.parametrize("known", [0, 60, 500_000])
@pytest.mark.parametrize("gathered", [0, 64])
def test_ranks_looked_up_or_joined(spark, holes, monkeypatch, known, gathered):
    """Rankings of few values are looked up in tasks, others joined: in a column each, or in lists."""
    from gritstone.operators import correlation as corr

    monkeypatch.setattr(corr, "KNOWN_VALUES", known)
    monkeypatch.setattr(corr, "GATHERED_COLUMNS", gathered)
    monkeypatch.setattr(corr, "HOT_SHARE", 10)
    found, plain = matrix(correlation(frame(spark, holes), "spearman")), holes.corr("spearman")
    for x in holes:
        for y in holes:
            wanted = np.nan if "c5" in (x, y) else plain.loc[x, y]
            assert (found[x, y] is None) == bool(np.isnan(wanted)), (x, y)
            assert found[x, y] is None or found[x, y] == pytest.approx(wanted, abs=6e-5), (x, y)


def test_few_values_are_not_sent_by_row(spark, holes, monkeypatch):
    from gritstone.operators import correlation as corr

    plans, plain = [], corr.gramian
    monkeypatch.setattr(corr, "gramian", lambda base, *rest: plans.append(base._jdf.queryExecution().optimizedPlan().toString()) or plain(base, *rest))
    correlation(frame(spark, holes), "spearman")
    assert plans and not any("Join" in p or "Aggregate" in p for p in plans)
