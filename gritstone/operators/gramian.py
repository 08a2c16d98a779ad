"""Sums of products of all pairs of columns from one scan.

Each task multiplies matrices of values and of filled cells and passes on one
packed result, centred on its own shift of each column; groups of tasks are added up
before anything reaches the driver, which holds one matrix at a time. The number of
scans does not depend on the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.runtime import share_package

# Bytes of packed results that one group of tasks adds up.
GROUP_BYTES = 64 << 20
# Cells of a multiplied block.
BLOCK_CELLS = 1 << 20


@dataclass
class Gramian:
    """Sums over the rows in which both columns of a pair are filled; values are less the shift of their column.

    ``n[i, j]`` counts rows, ``first`` sums column i, ``second`` its squares, ``product`` i times j.
    """

    shift: np.ndarray
    n: np.ndarray
    first: np.ndarray
    second: np.ndarray
    product: np.ndarray

    @staticmethod
    def empty(size: int) -> Gramian:
        return Gramian(np.full(size, np.nan), *[np.zeros((size, size)) for _ in range(4)])

    @staticmethod
    def unpacked(data: bytes, size: int) -> Gramian:
        flat = np.frombuffer(data, np.float64)
        return Gramian(flat[:size].copy(), *flat[size:].reshape(4, size, size).copy())

    def packed(self) -> bytes:
        return np.concatenate([self.shift, *[m.ravel() for m in (self.n, self.first, self.second, self.product)]]).tobytes()

    def add_rows(self, values: np.ndarray) -> None:
        """Add rows of a matrix; missing cells are NaN."""
        filled = ~np.isnan(values)
        # The middle value of the first rows that have any: exact for a constant column.
        for i in np.flatnonzero(np.isnan(self.shift) & filled.any(axis=0)):
            self.shift[i] = np.median(values[filled[:, i], i])
        with np.errstate(invalid="ignore", over="ignore"):
            moved = np.where(filled, values - self.shift, 0.0)
            mask = filled.astype(np.float64)
            self.n += mask.T @ mask
            self.first += moved.T @ mask
            self.second += (moved * moved).T @ mask
            self.product += moved.T @ moved

    def moved(self, shift: np.ndarray) -> Gramian:
        """The same sums with other shifts; a column without values has none."""
        with np.errstate(invalid="ignore", over="ignore"):
            step = np.where(np.isnan(self.shift) | np.isnan(shift) | (self.shift == shift), 0.0, self.shift - shift)
            down, across = step[:, None], step[None, :]
            first = self.first + down * self.n
            second = self.second + 2 * down * self.first + down * down * self.n
            product = self.product + down * self.first.T + across * self.first + down * across * self.n
        return Gramian(np.where(np.isnan(shift), self.shift, shift), self.n, first, second, product)

    def plus(self, other: Gramian) -> Gramian:
        mine = self.moved(other.shift) if np.isnan(self.shift).any() else self
        theirs = other.moved(mine.shift)
        return Gramian(mine.shift, *[a + b for a, b in zip((mine.n, mine.first, mine.second, mine.product), (theirs.n, theirs.first, theirs.second, theirs.product))])

    def centred(self) -> Gramian:
        """With the mean of each column as its shift."""
        count = np.diag(self.n)
        with np.errstate(invalid="ignore"):
            return self.moved(np.where(count > 0, self.shift + np.diag(self.first) / np.maximum(count, 1), np.nan))


def gramian(base: DataFrame, size: int, matrix=None) -> Gramian:
    """Sums over all rows of ``base``, whose columns are ``size`` doubles; ``matrix`` reads a batch otherwise."""
    share_package(base.sparkSession)

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])

    read = matrix or columns
    rows = max(1, BLOCK_CELLS // size)
    fan = max(2, GROUP_BYTES // (8 * (4 * size * size + size)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Gramian.empty(size)
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                sums.add_rows(read(batch.slice(begin, rows)))
        node = TaskContext.get().partitionId() // fan
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sums.packed()], pa.binary())], ["node", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = Gramian.empty(size)
        for data in group["sums"]:
            total = total.plus(Gramian.unpacked(data, size))
        return pd.DataFrame({"node": group["node"].iloc[:1], "sums": [total.packed()]})

    parts = base.mapInArrow(multiply, "node long, sums binary")
    total = Gramian.empty(size)
    for row in parts.groupBy("node").applyInPandas(add, "node long, sums binary").select(F.col("sums")).collect():
        total = total.plus(Gramian.unpacked(bytes(row.sums), size))
    return total.centred()
