"""Grid search over folds, each prepared and fitted on its complement alone."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gritstone.operators.preparation import FOLD

MAX_FOLDS = 3
# Fits that run side by side; small ones leave most of a cluster idle.
FITS_AT_ONCE = 12
STORAGE = StorageLevel.MEMORY_AND_DISK


@dataclass
class GridSearch:
    """Points of a grid with the score of each on every fold that it was not fitted on."""

    points: list[dict]
    fold_scores: list[list[float]]

    @property
    def scores(self) -> list[float]:
        return [sum(s) / len(s) for s in zip(*self.fold_scores, strict=True)]

    @property
    def best(self) -> int:
        return max(range(len(self.points)), key=lambda i: self.scores[i])


def grid_points(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid's values."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def score(predicted: DataFrame, task: str) -> float:
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predicted)
    return RegressionEvaluator(metricName="r2").evaluate(predicted)


def grid_search(
    rows: DataFrame, prepared: list[PipelineModel], weigh: Callable[[DataFrame], DataFrame], build: Callable[[dict, int], Estimator],
    task: str, points: list[dict],
) -> GridSearch:
    """Score every point on every fold of ``rows`` (column ``__fold``).

    ``prepared`` holds the preparation of each fold's complement, ``weigh`` adds row weights to training rows, and
    ``build`` gives the estimator of a point for a number of training rows.
    """
    # Iterative learners read the vectors many times; lost blocks are rebuilt from the source.
    vectors = [p.transform(rows).select("features", "label", FOLD).persist(STORAGE) for p in prepared]
    try:
        insides = [weigh(v.where(f"{FOLD} <> {fold}")) for fold, v in enumerate(vectors)]
        outsides = [v.where(f"{FOLD} = {fold}") for fold, v in enumerate(vectors)]
        counts = [inside.count() for inside in insides]
        groups = _groups([build(p, counts[0]) for p in points], points)

        def fitted(part: tuple[int, list[int]]) -> list[float]:
            fold, group = part
            return _scores([build(points[i], counts[fold]) for i in group], insides[fold], outsides[fold], task)

        parts = [(fold, group) for fold in range(len(prepared)) for group in groups]
        with ThreadPool(min(FITS_AT_ONCE, len(parts))) as pool:
            scores = pool.map(fitted, parts, chunksize=1)
    finally:
        for v in vectors:
            v.unpersist()
    found = [[0.0] * len(points) for _ in prepared]
    for (fold, group), values in zip(parts, scores, strict=True):
        for i, value in zip(group, values, strict=True):
            found[fold][i] = value
    return GridSearch(points, found)


def _groups(estimators: list[Estimator], points: list[dict]) -> list[list[int]]:
    """Points that one fit can score: boosted regressions that differ in the number of trees alone."""
    groups: dict[str, list[int]] = {}
    for i, (estimator, point) in enumerate(zip(estimators, points, strict=True)):
        boosted = isinstance(estimator, GBTRegressor)
        groups.setdefault(json.dumps({k: v for k, v in point.items() if k != "n_estimators"}) if boosted else str(i), []).append(i)
    return list(groups.values())


def _scores(estimators: list[Estimator], inside: DataFrame, outside: DataFrame, task: str) -> list[float]:
    """Score of each estimator. A boosted model begins with the trees of every shorter one, so the longest has all errors."""
    spread = outside.agg(F.var_pop("label")).first()[0] if len(estimators) > 1 else None
    if not spread:
        return [score(e.fit(inside).transform(outside), task) for e in estimators]
    sizes = [e.getMaxIter() for e in estimators]
    model = estimators[sizes.index(max(sizes))].fit(inside)
    errors = model.evaluateEachIteration(outside, "squared")
    return [1 - errors[size - 1] / spread for size in sizes]
