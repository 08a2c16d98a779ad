"""Anchors: positions chosen by content, such that every window of a text contains a whole anchored substring.

In every window of ``window`` bytes the ``key``-byte substring with the smallest
hash is its anchor, the left-most one on ties. Equal windows have their anchor at
the same place, whatever surrounds them, and about two of ``window - key + 2``
positions are anchors: a sparse suffix array over them misses no match of a
window's length.
"""

from __future__ import annotations

import numpy as np

from gritstone.llm.bytehash import Ranges


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the left-most minimum of every ``width`` neighbouring values."""
    at = np.arange(len(values), dtype=np.int32 if len(values) < 2**31 else np.int64)
    low, span = values, 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.minimum(low[step:], low[: len(low) - step])
        span += step
    return at


def anchors(data: bytes, window: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of each anchor, and the first and last start of the windows that it belongs to."""
    if len(data) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    hashes = Ranges(data).windows(key)
    chosen = sliding_argmin(hashes, window - key + 1)
    first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    at = chosen[first].astype(np.int64)
    return hashes[at], at, first, last
