"""Boosted trees fitted by Spark, carried to tasks as plain arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.runtime import scratch_path


@dataclass
class Trees:
    """Nodes of all trees in a row: a leaf is its own child."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a matrix."""
        margin = np.zeros(len(features))
        rows = np.arange(len(features))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(features), root)
            for _ in range(self.depth):
                goes_left = features[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def fit_trees(rows: DataFrame, iterations: int = 20, depth: int = 5) -> Trees:
    """Fit ``rows`` (``label`` 0 or 1, ``features`` array) and read the trees back."""
    spark = rows.sparkSession
    data = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    model = GBTClassifier(featuresCol="vector", maxIter=iterations, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7).fit(data)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    # At most ``iterations`` trees of 2^(depth+1) - 1 nodes.
    nodes = saved.select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    offset: dict[int, int] = {}
    for i, n in enumerate(nodes):
        offset.setdefault(n.treeID, i)
    leaf = [n.leftChild < 0 for n in nodes]
    begin = [offset[n.treeID] for n in nodes]
    return Trees(
        roots=np.array([offset[t] for t in sorted(offset)]),
        weights=np.array(model.treeWeights),
        feature=np.array([0 if e else n.split.featureIndex for n, e in zip(nodes, leaf, strict=True)]),
        threshold=np.array([0.0 if e else n.split.leftCategoriesOrThreshold[0] for n, e in zip(nodes, leaf, strict=True)]),
        left=np.array([i if e else b + n.leftChild for i, (n, e, b) in enumerate(zip(nodes, leaf, begin, strict=True))]),
        right=np.array([i if e else b + n.rightChild for i, (n, e, b) in enumerate(zip(nodes, leaf, begin, strict=True))]),
        value=np.array([n.prediction for n in nodes]),
        depth=depth,
    )
