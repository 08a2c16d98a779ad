"""A logarithmic family of sorted arrays: keys with the smallest document that has them."""

from __future__ import annotations

import numpy as np


def grouped(keys: np.ndarray, docs: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its smallest document; the order of the rows, and each one's key in it."""
    order = np.argsort(keys, kind=kind)
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.minimum.reduceat(docs[order], np.flatnonzero(first)), order, np.cumsum(first) - 1


def smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its smallest document, from sorted runs."""
    return grouped(keys, docs, "stable")[:2]


class LogIndex:
    """Sorted arrays of growing size; a new batch is scanned against them and joins them as one more array.

    Arrays of about equal size are merged, so there are logarithmically many and every entry is moved
    logarithmically often. ``limit`` bounds the entries kept; beyond it the largest array is let go.
    """

    def __init__(self, limit: int | None = None):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self._limit = limit

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The smallest document of each key; the largest integer where the key is new."""
        found = np.full(len(keys), np.iinfo(np.int64).max)
        for level_keys, level_docs in self.levels:
            at = np.minimum(np.searchsorted(level_keys, keys), len(level_keys) - 1)
            found = np.where(level_keys[at] == keys, np.minimum(found, level_docs[at]), found)
        return found

    def scan(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Add a batch and give the smallest document of each of its keys, the batch included.

        The arrays are searched in the order of the keys, and keys with a document as small do not join them again.
        """
        if not len(keys):
            return np.empty(0, np.int64)
        keys, low, order, place = grouped(keys, docs)
        known = self.find(keys)
        fresh = low < known
        self._append(keys[fresh], low[fresh])
        found = np.empty(len(order), np.int64)
        found[order] = np.minimum(low, known)[place]
        return found

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        if len(keys):
            self._append(*grouped(keys, docs)[:2])

    def _append(self, keys: np.ndarray, docs: np.ndarray) -> None:
        if not len(keys):
            return
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (k2, d2), (k1, d1) = self.levels.pop(), self.levels.pop()
            self.levels.append(smallest(np.concatenate([k1, k2]), np.concatenate([d1, d2])))
        if self._limit is not None and sum(len(k) for k, _ in self.levels) > self._limit:
            self.levels = self.levels[1:]
