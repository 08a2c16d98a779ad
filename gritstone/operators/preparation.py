"""Preparation of model features, fitted on several overlapping parts of a table at once.

Cross-validation needs medians, scales, fill values and categories of the
complement of every fold. They come from statistics per fold: quantiles of all
complements share one selection, moments are merged from one grouping by fold, and
one count of values by fold serves every complement. View 0 is the whole table,
view ``f + 1`` the complement of fold ``f``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.values import is_number, number_literal, quote, text_literal
from gritstone.operators import frequency
from gritstone.operators.features import scaled
from gritstone.operators.normalize import types_of
from gritstone.operators.order_stats import quantiles
from gritstone.runtime import chunks

# Width of a hashed categorical feature.
HASHED_WIDTH = 4_096
# Columns whose moments share one pass.
COLUMNS_PER_PASS = 50
FOLD = "__fold"


@dataclass
class Preparation:
    """What the stages of one view are built from."""

    numbers: list[str]
    readings: dict[str, str]
    categories: list[str]
    hashed: list[str]
    components: int | None
    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, str] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)

    def stages(self) -> list:
        """Pipeline stages from raw columns to ``features``; only PCA reads rows when it is fitted."""
        columns, stages, parts = [], [], []
        for i, c in enumerate(self.numbers):
            cell = f"coalesce({self.readings[c]}, {number_literal(self.medians[c])})"
            columns.append(f"{scaled(cell, *self.scales[c])} as __num_{i}")
        for kind, names in (("cat", self.categories), ("hash", self.hashed)):
            for i, c in enumerate(names):
                columns.append(f"coalesce(cast({quote(c)} as string), {text_literal(self.fills[c])}) as __{kind}_{i}")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"))
        if self.numbers:
            stages.append(VectorAssembler(inputCols=[f"__num_{i}" for i in range(len(self.numbers))], outputCol="__numbers"))
            parts.append("__numbers")
            if self.components is not None:
                stages.append(PCA(k=self.components, inputCol="__numbers", outputCol="__components"))
                parts = ["__components"]
        if self.categories:
            raw, index, onehot = ([f"__{kind}_{i}" for i in range(len(self.categories))] for kind in ("cat", "index", "onehot"))
            # An unseen value takes the extra last index, which the encoder drops: all zeros.
            # One indexer for each column: label lists of different lengths in one would be filled up with nulls.
            for c, i, o in zip(self.categories, raw, index, strict=True):
                stages.append(StringIndexerModel.from_labels(self.labels[c], inputCol=i, outputCol=o, handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True))
            parts += onehot
        if self.hashed:
            inputs = [f"__hash_{i}" for i in range(len(self.hashed))]
            stages.append(FeatureHasher(inputCols=inputs, outputCol="__hashed", numFeatures=HASHED_WIDTH))
            parts.append("__hashed")
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
        return stages


    def shown(self, name: str) -> str:
        """The name of a vector entry for readers: that of its column, with its value, component or hash."""
        stage, place, rest = re.fullmatch(r"__(?:numbers___)?(num|onehot|components|hashed)_(\d+)(?:_(.*))?", name, re.DOTALL).groups()
        if stage == "num":
            return self.numbers[int(place)]
        if stage == "onehot":
            return f"{self.categories[int(place)]}_{rest}"
        return f"pca_{int(place) + 1}" if stage == "components" else f"hashed_{place}"


def merged(parts: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and population deviation of parts given as count, mean and sum of squared deviations."""
    n, mean, squares = 0, 0.0, 0.0
    for count, m, s in parts:
        if count:
            total = n + count
            squares += s + (m - mean) ** 2 * n * count / total
            mean += (m - mean) * count / total
            n = total
    return mean, math.sqrt(max(squares, 0.0) / n) if n else 0.0


def _set_numbers(train: DataFrame, views: list[Preparation]) -> None:
    names, readings = views[0].numbers, views[0].readings
    within = {v: "" if v == 0 else f"if({FOLD} <> {v - 1}, " for v in range(len(views))}
    wanted = {(c, v): f"{within[v]}{readings[c]}{', null)' if v else ''}" for c in names for v in within}
    medians = quantiles(train, wanted, [0.5])
    parts: dict[tuple[int, str], tuple[int, int, float, float]] = {}
    for chunk in chunks(names, COLUMNS_PER_PASS):
        sums = [
            e
            for i, c in enumerate(chunk)
            for e in (f"count({readings[c]}) as n{i}", f"avg({readings[c]}) as m{i}", f"var_pop({readings[c]}) as v{i}")
        ]
        grouped = train.groupBy(FOLD).agg(F.count(F.lit(1)).alias("rows"), *[F.expr(e) for e in sums])
        for r in grouped.collect():
            for i, c in enumerate(chunk):
                n = r[f"n{i}"]
                parts[r[FOLD], c] = (n, r["rows"] - n, r[f"m{i}"] or 0.0, (r[f"v{i}"] or 0.0) * n)
    for v, view in enumerate(views):
        for c in names:
            view.medians[c] = middle = medians[c, v][0] or 0.0
            inside = [p for (f, name), p in parts.items() if name == c and f != v - 1]
            # Missing cells hold the median.
            filled = [(n, m, s) for n, _, m, s in inside] + [(sum(p[1] for p in inside), middle, 0.0)]
            view.scales[c] = merged(filled)


def _set_categories(train: DataFrame, views: list[Preparation]) -> None:
    onehot, hashed = views[0].categories, views[0].hashed
    names = [*onehot, *hashed]
    cells = train.select(FOLD, F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(quote(c)).cast("string").alias("value")) for i, c in enumerate(names)])).alias("c"))
    number = [F.count(F.lit(1)) if v == 0 else F.count_if(F.col(FOLD) != v - 1) for v in range(len(views))]
    counted = cells.where("c.value is not null").groupBy("c.place", "c.value").agg(*[n.alias(f"n{v}") for v, n in enumerate(number)])
    # The most frequent value, the smallest among ties.
    first = [F.min(F.when(F.col(f"n{v}") > 0, F.struct(-F.col(f"n{v}"), F.col("value")))).alias(f"first{v}") for v in range(len(views))]
    for view in views:
        view.fills = dict.fromkeys(names, "")
        view.labels = {c: [] for c in onehot}
    for r in counted.groupBy("place").agg(*first).collect():
        for v, view in enumerate(views):
            if r[f"first{v}"] is not None:
                view.fills[names[r.place]] = r[f"first{v}"]["value"]
    # Every label becomes a column of the feature vector, so they fit the driver as the vector's names do.
    for r in counted.where(F.col("place") < len(onehot)).collect() if onehot else ():
        for v, view in enumerate(views):
            if r[f"n{v}"]:
                view.labels[onehot[r.place]].append(r.value)
    for view in views:
        view.labels = {c: sorted(values) or [""] for c, values in view.labels.items()}


def prepare_views(train: DataFrame, features: list[str], folds: int, pca: int | None, hash_above: int | None) -> list[Preparation]:
    """Preparations of the whole of ``train`` and of the complement of each of its folds (column ``__fold``)."""
    types = types_of(train)
    numbers = [c for c in features if is_number(types[c]) or isinstance(types[c], T.BooleanType)]
    categories = [c for c in features if c not in numbers]
    readings = {c: f"nanvl(cast({f'cast({quote(c)} as int)' if isinstance(types[c], T.BooleanType) else quote(c)} as double), null)" for c in numbers}
    hashed: list[str] = []
    if categories and hash_above is not None:
        counted = frequency.distinct_counts(train.select(*[quote(c) for c in categories])).collect()
        hashed = [r.column for r in counted if r.distinct_count > hash_above]
    components = None if pca is None or not numbers else min(len(numbers), pca or min(3, len(numbers)))
    onehot = [c for c in categories if c not in hashed]
    views = [Preparation(numbers, readings, onehot, hashed, components) for _ in range(folds + 1)]
    if numbers:
        _set_numbers(train, views)
    if categories:
        _set_categories(train, views)
    return views
