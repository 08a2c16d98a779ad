"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics (lengths, shares of kinds of
characters, repetition). Random Fourier features of the standardised vector
approximate a Gaussian kernel; ridge scores solve normal equations that are
summed partition by partition, and isotonic regression on labelled rows that the
fit has not seen turns scores into probabilities.

Labels come only from rows whose ``crc32(doc_id as text) mod 3`` is not 1: rest 0
fits the weights, rest 2 the calibration, rest 1 is held out. Label, language,
source and id are never inputs of a score.

Null and empty texts have all-zero statistics and get a score like any other. A
document labelled several times counts as often. Without labelled rows every
score is 0.5. Repeated rows get equal scores; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.runtime import materialize, share_package

FEATURES = 256
RIDGE = 1.0
#: Kernel width in standardised units, per square root of the number of statistics.
WIDTH = 1.0
#: Standardised statistics beyond this many deviations are cut off.
REACH = 6.0
CALIBRATION_STEP = 1e-3
SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\/"
N_STATISTICS = 22
_TERMINAL = re.compile(rb"[.!?]\s")


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; zeros for null and empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    symbols = sum(int(counts[c]) for c in SYMBOLS)
    marks = sum(int(counts[c]) for c in b".,;:!?'\"()-")
    words = data.split()
    m = len(words)
    lengths = np.array([len(w) for w in words]) if words else np.zeros(1)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lines = [line.strip() for line in data.split(b"\n")]
    lines = [line for line in lines if line]
    ended = sum(w[-1] in SYMBOLS for w in words)
    shown = sum(w[-1:] == b"!" for w in words)
    plain = sum(w.isalpha() for w in words)
    return [
        np.log1p(n), np.log1p(m), float(lengths.mean()), float(lengths.std()), _share(upper, upper + lower), _share(digits, n),
        _share(symbols, n), _share(marks, n), _share(counts[128:].sum(), n), _share(counts[10], n), _share(counts[124], n),
        _share(counts[33], n), _share(distinct, m), _share(again, m), 1 - _share(len(set(triples)), len(triples)) if triples else 0.0,
        1 - _share(len(set(lines)), len(lines)) if lines else 0.0, _share(ended, m), _share(shown, m), _share(plain, m),
        _share(len(_TERMINAL.findall(data)), m), float(np.log1p(lengths.max())), _share((lengths <= 2).sum(), m),
    ]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


class QualityModel:
    """Weights, scales and calibration; a few hundred numbers."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 7):
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = random.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), features))
        self.phases = random.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.chance = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -REACH, REACH)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; between the calibrated steps it rises linearly."""
        return np.interp(self.raw(x), self.at, self.chance)


def _vectors(batch: pd.DataFrame) -> np.ndarray:
    return np.array(list(batch.x), float).reshape(len(batch), -1)


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Products of features with each other and with the label, summed within partitions and then over them."""
    n = len(model.weights)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            z = model.features(_vectors(batch))
            total += z.T @ np.hstack([z, batch.y.to_numpy()[:, None]])
        yield pd.DataFrame({"i": range(n), "line": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        lines = np.array(list(group.line))
        # Adding in order of value makes the sum independent of the order of arrival.
        return pd.DataFrame({"i": group.i[:1], "line": [np.sort(lines, axis=0).sum(axis=0)]})

    parts = rows.select("x", "y").mapInPandas(sums, "i int, line array<double>")
    found = parts.groupBy("i").applyInPandas(add, "i int, line array<double>").collect()
    total = np.zeros((n, n + 1))
    for row in found:
        total[row.i] = row.line
    return total[:, :n], total[:, n]


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and rising values of the pooled blocks."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, mean, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrate(rows: DataFrame, model: QualityModel) -> None:
    """Isotonic calibration on counts per narrow score interval, so the driver sees a bounded number of rows."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.clip(model.raw(_vectors(batch)), -1, 2)
            yield pd.DataFrame({"bin": np.round(raw / CALIBRATION_STEP).astype(np.int64), "y": batch.y})

    counts = rows.select("x", "y").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    found = sorted((r.bin, r.y, r.n) for r in counts.collect())
    if found:
        bins, ones, n = (np.array(c, float) for c in zip(*found, strict=True))
        model.at, model.chance = isotonic(bins * CALIBRATION_STEP, ones / n, n)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row of ``docs`` (``doc_id, text``)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "x": [statistics(t) for t in batch.text]})

    share_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(measured: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """A model of ``labels`` (``doc_id, label``) from statistics (``doc_id, x``)."""
    scales = [f(F.col("x")[i]) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]
    found = np.array([0.0 if v is None else v for v in measured.agg(*scales).first()]).reshape(-1, 2)
    model = QualityModel(found[:, 0], found[:, 1], features)
    known = materialize(
        measured.join(labels.where("label is not null").select("doc_id", F.col("label").cast("double").alias("y")), "doc_id")
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold <> 1")
    )
    products, targets = normal_equations(known.where("fold = 0"), model)
    if products.any():
        model.weights = np.linalg.solve(products + ridge * np.eye(len(products)), targets)
    calibrate(known.where("fold = 2"), model)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``labels`` has ``doc_id, label``."""
    measured = materialize(text_statistics(docs))
    model = fit(measured, labels, features, ridge)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": model.score(_vectors(batch))})

    scored = measured.mapInPandas(score, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
