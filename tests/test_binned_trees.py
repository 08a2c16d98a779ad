"""Trees on binned features equal those of Spark, whatever the points of a grid share."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from gritstone.operators import binned_trees, models
from gritstone.runtime import scratch_path

FEATURES = ["amount", "size", "flag", "colour"]


@pytest.fixture(scope="module")
def table(spark):
    """300 rows, some twice, with missing cells and keys, a colour in one row only and few or many different numbers."""
    r = random.Random(5)
    rows = []
    for i in range(290):
        size, amount, colour = r.randrange(6), r.gauss(0, 1), r.choice(["red", "blue", "green"])
        y = size * 3 + amount * 5 + (4 if colour == "red" else 0) + r.gauss(0, 1)
        rows.append((None if i % 50 == 0 else i, None if i % 9 == 0 else amount, None if i % 13 == 0 else size, i % 2 == 0, "teal" if i == 7 else colour, y))
    return spark.createDataFrame(rows + rows[:10], "id long, amount double, size int, flag boolean, colour string, y double")


def tuned(df, model, grid, features=FEATURES, **options):
    return models.train(df, "y", features, "regression", model, tune=grid, key="id", **options)


def test_boosting_equals_sparks(table, monkeypatch):
    grid = {"n_estimators": [4, 9], "learning_rate": [0.1, 0.3], "max_depth": [2, 4]}
    new = tuned(table, "gradient_boosting", grid)
    monkeypatch.setattr(binned_trees, "fits", lambda *_: False)
    old = tuned(table, "gradient_boosting", grid)
    assert np.allclose(new.search.fold_scores, old.search.fold_scores, rtol=1e-9, atol=1e-12)
    assert new.params == old.params and new.metrics == pytest.approx(old.metrics, rel=1e-9)
    assert new.train_score == pytest.approx(old.train_score, rel=1e-9)
    assert dict(new.importances) == pytest.approx(dict(old.importances), rel=1e-6, abs=1e-9)


def test_forests_are_tuned_without_a_fit_for_every_point(table, monkeypatch):
    """Before, Spark's trainer made a forest for every point and fold."""
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda *_: pytest.fail("a forest was fitted by Spark"))
    run = tuned(table, "random_forest", {"n_estimators": [6, 15], "max_depth": [None, 3], "min_samples_leaf": [1, 3]})
    assert len(run.search.points) == 8 and run.metrics["r2"] > 0.7 and run.metrics["tuning_score"] > 0.7
    assert run.model.stages[-2].getNumTrees == run.params["n_estimators"]


def test_points_of_a_shared_forest_equal_forests_of_their_own(table):
    shared = tuned(table, "random_forest", {"n_estimators": [4, 9], "max_depth": [2, 5], "min_samples_leaf": [4]})
    for i, point in list(enumerate(shared.search.points))[:3]:
        alone = tuned(table.repartition(5), "random_forest", {k: [v] for k, v in point.items()})
        assert np.allclose([s[i] for s in shared.search.fold_scores], [s[0] for s in alone.search.fold_scores], rtol=1e-9)


def test_a_forest_is_as_good_as_sparks(table, monkeypatch):
    grid = {"n_estimators": [30], "max_depth": [6]}
    new = tuned(table, "random_forest", grid)
    monkeypatch.setattr(binned_trees, "fits", lambda *_: False)
    old = tuned(table, "random_forest", grid)
    assert new.metrics["tuning_score"] == pytest.approx(old.metrics["tuning_score"], abs=0.03)
    assert new.metrics["r2"] == pytest.approx(old.metrics["r2"], abs=0.04)
    assert {n for n, v in new.importances if v > 0.1} == {n for n, v in old.importances if v > 0.1}


def test_tree_equals_a_plain_search(monkeypatch):
    """Every split is the best of all by brute force, also where histograms go in pieces."""
    monkeypatch.setattr(binned_trees, "ENTRIES", 8)
    r = np.random.default_rng(1)
    codes, blocks = [r.integers(0, 5, 120), r.integers(0, 4, 120)], [(5, False), (4, True)]
    n, y = r.integers(0, 3, 120).astype(float), r.normal(size=120)
    tree = binned_trees.grow(codes, blocks, n, n * y, n * y * y, 3, 4)

    def loss(part):
        return n[part] @ (y[part] - np.average(y[part], weights=n[part])) ** 2

    def check(node, part):
        assert tree.value[node] == pytest.approx(np.average(y[part], weights=n[part])) and tree.count[node] == n[part].sum()
        if tree.left[node] < 0:
            return
        sides = [codes[0] > c for c in range(4)] + [codes[1] == c for c in range(3)]
        found = [loss(part) - loss(part & s) - loss(part & ~s) for s in sides if n[part & s].sum() >= 4 and n[part & ~s].sum() >= 4]
        assert tree.gain[node] * n[part].sum() == pytest.approx(max(found))
        b, c = tree.block[node], tree.cut[node]
        side = codes[b] == c if blocks[b][1] else codes[b] > c
        check(tree.left[node], part & ~side)
        check(tree.left[node] + 1, part & side)

    check(0, np.ones(120, bool))
    assert len(tree.left) > 7


@pytest.mark.parametrize("kinds", [1, 2, 32, 33, 400])
def test_bins_are_those_of_spark(kinds):
    r = np.random.default_rng(kinds)
    numbers = np.sort(r.normal(size=kinds))[r.integers(0, kinds, 1000) ** 2 // kinds]
    values, counts = np.unique(numbers, return_counts=True)
    plain = []
    if len(values) <= 32:
        plain = list((values[:-1] + values[1:]) / 2)
    else:
        upto, wanted = counts[0], 1000 / 32
        for i in range(1, len(values)):
            before, upto = upto, upto + counts[i]
            if abs(before - wanted) < abs(upto - wanted):
                plain.append((values[i - 1] + values[i]) / 2)
                wanted += 1000 / 32
    assert list(binned_trees.cuts_of(numbers)) == plain


def test_cells_of_a_bootstrap(monkeypatch):
    """Rows of a cell are drawn one by one, also where a cell goes over the border of a piece."""
    r = np.random.default_rng(2)
    codes, labels = [r.integers(0, 3, 500), r.integers(0, 2, 500)], r.normal(size=500)
    cells = binned_trees.grouped(codes, [3, 2], labels)
    assert len(cells.rows) == 6 and cells.rows.sum() == 500 and cells.sums.sum() == pytest.approx(0, abs=1e-9)
    monkeypatch.setattr(binned_trees, "DRAWN_ROWS", 500)
    whole = cells.drawn(42, 3)
    monkeypatch.setattr(binned_trees, "DRAWN_ROWS", 37)
    pieces = cells.drawn(42, 3)
    weight = np.random.default_rng([42, 3]).poisson(1.0, 500)
    for found in (whole, pieces):
        assert found[0] == pytest.approx(np.add.reduceat(weight, cells.starts))
        assert found[1] == pytest.approx(np.add.reduceat(weight * cells.labels, cells.starts))


def test_score_on_the_training_rows(table, monkeypatch):
    """Trees that are grown again for it score as the model on its rows."""
    for model in ("random_forest", "gradient_boosting"):
        monkeypatch.setattr(binned_trees, "ROWS_A_CELL", 0)
        again = tuned(table, model, {"n_estimators": [5], "max_depth": [3]})
        monkeypatch.setattr(binned_trees, "ROWS_A_CELL", 1000)
        by_rows = tuned(table, model, {"n_estimators": [5], "max_depth": [3]})
        assert again.train_score == pytest.approx(by_rows.train_score, rel=1e-9) and again.metrics == by_rows.metrics


def test_stored_trees_predict_the_same(spark, table):
    for model in ("random_forest", "gradient_boosting"):
        run = tuned(table, model, {"n_estimators": [5], "max_depth": [3]})
        root = scratch_path(spark, "runs")
        again = models.load_run(root, models.save_run(run, root, spark), spark)
        first = [r.prediction for r in models.predict(run, table).orderBy("id", "y").select("prediction").collect()]
        assert first == [r.prediction for r in models.predict(again, table).orderBy("id", "y").select("prediction").collect()]


def test_what_the_trees_cannot_take_goes_to_spark(table, monkeypatch):
    fits, plain = [], GBTRegressor._fit_java
    monkeypatch.setattr(GBTRegressor, "_fit_java", lambda self, data: fits.append(1) or plain(self, data))
    grid = {"n_estimators": [3], "max_depth": [2]}
    assert tuned(table, "gradient_boosting", grid, hash_above=2).search and len(fits) == 4
    monkeypatch.setattr(binned_trees, "MOST_BYTES", 100)
    assert tuned(table, "gradient_boosting", grid).search and len(fits) == 8
