"""Tuning prepares every fold on its complement alone."""

import math
import random

import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gritstone.operators import models
from gritstone.operators.preparation import FOLD, merged, prepare_views
from gritstone.operators.tuning import MAX_FOLDS, grid_points

FEATURES = ["amount", "size", "flag", "colour", "empty"]


@pytest.fixture(scope="module")
def table(spark):
    """200 rows: missing cells, an extreme outlier, a colour in one row only, and a column without values."""
    r = random.Random(3)
    rows = []
    for i in range(200):
        size = r.gauss(10, 3)
        amount = 1e9 if i == 77 else None if i % 9 == 0 else r.gauss(0, 1) + size / 4
        colour = "teal" if i == 50 else None if i % 11 == 0 else r.choice(["red", "blue", "green"])
        kind = "a" if (amount or 2) + r.gauss(0, 1) > 2.5 else "b" if size > 9 else "c"
        rows.append((i, amount, None if i % 13 == 0 else size, r.random() < 0.5, colour, None, kind))
    return spark.createDataFrame(rows, "id long, amount double, size double, flag boolean, colour string, empty double, kind string")


def test_views_equal_a_plain_fit_of_each_complement(spark, table):
    folded = table.withColumn(FOLD, (F.col("id") % 3).cast("int"))
    views = prepare_views(folded, FEATURES, 3, None, None)
    data = folded.toPandas()
    for v, view in enumerate(views):
        part = data if v == 0 else data[data[FOLD] != v - 1]
        plain = prepare_views(folded.where(f"{FOLD} <> {v - 1}"), FEATURES, 0, None, None)[0]
        assert view.medians == plain.medians and view.fills == plain.fills and view.labels == plain.labels
        for c in ("amount", "size"):
            assert view.medians[c] == pytest.approx(part[c].median())
            filled = part[c].fillna(part[c].median())
            assert view.scales[c] == pytest.approx((filled.mean(), filled.std(ddof=0)), rel=1e-9)
            assert plain.scales[c] == pytest.approx(view.scales[c], rel=1e-9)
        assert view.labels["colour"] == sorted(part["colour"].dropna().unique())
        assert view.fills["colour"] == sorted(part["colour"].value_counts().items(), key=lambda x: (-x[1], x[0]))[0][0]
        assert view.medians["empty"] == 0.0 and view.scales["empty"] == (0.0, 0.0)
    # The outlier and the colour of one row belong to a fold each, so one complement knows nothing of them.
    assert sorted("teal" in v.labels["colour"] for v in views) == [False, True, True, True]
    assert sum(v.scales["amount"][1] > 1e6 for v in views) == 3


def test_scores_equal_a_plain_refit_of_each_fold(spark, table):
    grid = {"C": [0.3, 1.0, 3.0]}
    run = models.train(table, "kind", FEATURES, "classification", "logistic_regression", tune=grid, key="id")
    assert run.search.points == grid_points(grid) and len(run.search.fold_scores) == MAX_FOLDS
    place = models.stable_hash("'fold'", "`id`")
    data = run.split.train.selectExpr("*", f"cast(pmod({place}, 3) as int) as fold").toPandas()
    labels = sorted(data["kind"].unique())
    for fold in range(MAX_FOLDS):
        inside = data[data["fold"] != fold]

        def vectors(part, inside=inside):
            columns = []
            for c in ("amount", "size"):
                middle = inside[c].median()
                known = inside[c].fillna(middle)
                columns.append(((part[c].fillna(middle) - known.mean()) / known.std(ddof=0)).tolist())
            flags = inside["flag"].astype(float)
            columns.append(((part["flag"].astype(float) - flags.mean()) / flags.std(ddof=0)).tolist())
            columns.append([0.0] * len(part))
            common = sorted(inside["colour"].value_counts().items(), key=lambda x: (-x[1], x[0]))[0][0]
            for value in sorted(inside["colour"].dropna().unique()):
                columns.append((part["colour"].where(part["colour"].notna(), common) == value).astype(float).tolist())
            rows = [(float(labels.index(k)), Vectors.dense(x)) for k, *x in zip(part["kind"], *columns)]
            return spark.createDataFrame(rows, ["label", "features"])

        train, held = vectors(inside), vectors(data[data["fold"] == fold])
        for point, score in zip(run.search.points, run.search.fold_scores[fold]):
            plain = LogisticRegression(maxIter=300, regParam=1 / (point["C"] * len(inside)), standardization=False).fit(train)
            right = plain.transform(held).where("prediction = label").count() / held.count()
            assert score == pytest.approx(right, abs=1e-9), (fold, point)
    best = max(run.search.scores)
    assert run.metrics["tuning_score"] == best and run.params["C"] == run.search.points[run.search.best]["C"]


def test_points_that_mean_the_same_are_tried_once(spark, table):
    run = models.train(table, "size", ["amount", "flag"], "regression", tune={"n_estimators": [2], "max_depth": [None, 12, 3]}, key="id")
    assert [p["max_depth"] for p in run.search.points] in ([None, 3], [12, 3])
    assert run.params["max_depth"] in (None, 12, 3) and all(math.isfinite(s) for s in run.search.scores)


def test_small_classes_and_prepared_features(spark, table):
    rare = table.withColumn("kind", F.when(F.col("id") == 3, "rare").otherwise(F.col("kind")))
    assert models.train(rare, "kind", ["size"], "classification", "logistic_regression", tune=True, key="id").search is None
    ready = table.selectExpr("id", "coalesce(size, 0) as size", "coalesce(amount, 0) / 1e9 as amount", "kind")
    run = models.train(ready, "kind", ["size", "amount"], "classification", "logistic_regression", {"class_weight": "balanced"}, tune=True, key="id", prepared=True)
    assert len(run.search.scores) == 3


def test_merged_moments():
    parts = [pd.Series([1.0, 2.0, 4.0]), pd.Series([], dtype=float), pd.Series([1e6]), pd.Series([5.0, 5.0])]
    whole = pd.concat(parts)
    found = merged([(len(p), p.mean() if len(p) else 0.0, ((p - p.mean()) ** 2).sum()) for p in parts])
    assert found == pytest.approx((whole.mean(), whole.std(ddof=0)))
    assert merged([]) == (0.0, 0.0)


@pytest.mark.parametrize("options", [{}, {"pca": 2}, {"hash_above": 3}, {"pca": 1, "hash_above": 3}])
def test_names_come_from_the_vector(spark, table, options):
    """Names equal those of a list made by hand, for numbers, categories, hashed columns and components."""
    folded = table.withColumn(FOLD, F.lit(0)).withColumn("label", F.lit(0.0))
    plan = prepare_views(folded, ["amount", "colour", "flag", "kind"], 0, options.get("pca"), options.get("hash_above"))[0]
    vectors = models.Pipeline(stages=plan.stages()).fit(folded).transform(folded).select("features", "label")
    names = models.feature_names(vectors, plan)
    numbers = [f"pca_{i + 1}" for i in range(options["pca"])] if "pca" in options else ["amount", "flag"]
    colours = [] if "hash_above" in options else [f"colour_{c}" for c in ("blue", "green", "red", "teal")]
    hashed = [f"hashed_{i}" for i in range(4096)] if "hash_above" in options else []
    assert names == [*numbers, *colours, *[f"kind_{k}" for k in "abc"], *hashed]
    assert len(names) == vectors.first().features.size


def test_odd_category_names(spark):
    rows = [(i, ["a_1", "x y", "é\nü", "__num_0"][i % 4], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    run = models.train(df, "y", ["c"], "classification", params={"n_estimators": 2}, key="id")
    assert sorted(n for n, _ in run.importances) == sorted(f"c_{v}" for v in ["a_1", "x y", "é\nü", "__num_0"])


def test_boosting_over_many_classes(spark):
    import time

    def fitted(classes: int) -> float:
        rows = [(i, float(i % classes) + (i % 7) / 10, str(i % classes)) for i in range(400)]
        df = spark.createDataFrame(rows, "id long, x double, y string")
        start = time.perf_counter()
        run = models.train(df, "y", ["x"], "classification", "gradient_boosting", {"n_estimators": 4, "max_depth": 2}, key="id")
        assert 0 < run.metrics["accuracy"] <= 1
        return time.perf_counter() - start

    fitted(3)
    # Side by side, so less than in proportion.
    assert fitted(20) < 5.5 * fitted(3)


def test_categories_of_different_sizes(spark, table):
    wide = table.selectExpr("id", "colour", "concat('k', id % 9) as other", "kind")
    run = models.train(wide, "kind", ["colour", "other"], "classification", "logistic_regression", {"class_weight": "balanced"}, key="id", top=50)
    assert len(run.importances) in (12, 13) and any(n.startswith("other_k") for n, _ in run.importances)


def test_shorter_boosted_models_are_scored_by_the_longest(spark, table, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    ready = table.selectExpr("id", "coalesce(size, 0) as size", "coalesce(amount, 0) / 1e9 as amount", "cast(flag as int) as flag")
    fits, plain = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, data: fits.append(self.getMaxIter()) or plain(self, data))
    grid = {"n_estimators": [3, 7], "learning_rate": [0.1, 0.3], "max_depth": [2]}

    def searched(grid):
        fits.clear()
        return models.train(ready, "size", ["amount", "flag"], "regression", "gradient_boosting", tune=grid, key="id", prepared=True).search

    found = searched(grid)
    # One fit for each fold and learning rate, and the final one.
    assert len(fits) == 2 * MAX_FOLDS + 1
    for i, point in enumerate(found.points):
        alone = searched({k: [v] for k, v in point.items()})
        for fold in range(MAX_FOLDS):
            assert found.fold_scores[fold][i] == pytest.approx(alone.fold_scores[fold][0], rel=1e-9)


def test_small_files_of_many_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    from gritstone import runtime
    from gritstone.sources.versions import VersionStore

    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    df = spark.range(1000).coalesce(1).selectExpr("id", "id % 7 as x", "id % 5 as y")
    assert len(runtime.spread(df).inputFiles()) == min(10, spark.sparkContext.defaultParallelism)
    assert runtime.spread(df).exceptAll(df).isEmpty() and runtime.spread(df).count() == 1000
    assert runtime.dealt(df.limit(150)) is not None and runtime.spread(df.where("id < 150")).count() == 150
    store = VersionStore(spark, str(tmp_path))
    assert len(store.read(store.create(df, "a.parquet")).inputFiles()) > 1
    monkeypatch.setattr(runtime, "MOST_TASK_ROWS", 10)
    assert runtime.spread(df) is df
