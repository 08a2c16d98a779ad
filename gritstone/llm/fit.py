"""Best-fit-decreasing on integer sizes and lower bounds on the number of bins."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class CapacityTree:
    """Segment tree over free capacities that finds the smallest one of at least a given size."""

    def __init__(self, width: int):
        self._leaves = 1
        while self._leaves < width + 1:
            self._leaves *= 2
        self._open = [0] * (2 * self._leaves)  # bins with a free capacity in the node's range

    def add(self, free: int, change: int) -> None:
        i = free + self._leaves
        while i:
            self._open[i] += change
            i //= 2

    def best(self, size: int) -> int | None:
        """Smallest free capacity >= size that a bin has."""
        tree, i = self._open, size + self._leaves
        if tree[i]:
            return size
        while i > 1:  # climb until a right sibling holds a bin, then go down its left-most path
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < self._leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self._leaves
            i //= 2
        return None


def best_fit_decreasing(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins. Equal sizes are placed in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, waiting, count = CapacityTree(width), defaultdict(list), 0
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable"):
        size = int(sizes[i])
        free = tree.best(size)
        if free is None:
            b, free, count = count, width, count + 1
        else:
            b = waiting[free].pop()
            tree.add(free, -1)
        bins[i], offsets[i] = b, width - free
        waiting[free - size].append(b)
        tree.add(free - size, 1)
    return bins, offsets, count


def bins_needed(sizes: np.ndarray, width: int) -> int:
    """Lower bound on the bins of any packing, the best of several dual feasible functions.

    A dual feasible function maps sizes so that any sizes that fit a bin keep a sum of at most 1; the sum over all
    items is then a bound. Used are the identity, the functions that round large sizes up to a whole bin and small
    ones down to nothing, and the ones that round to multiples of 1/k.
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=width + 1).astype(np.int64)
    value = np.arange(width + 1)
    volume = counts * value
    best = -(-int(volume.sum()) // width)
    count_sum, volume_sum = np.cumsum(counts), np.cumsum(volume)
    for small in range(1, width // 2 + 1):
        large = int(count_sum[-1] - count_sum[width - small])
        middle = int(volume_sum[width - small] - volume_sum[small - 1])
        best = max(best, large + -(-middle // width))
    for k in range(1, 51):
        steps = value * (k + 1)
        exact = steps % width == 0
        mapped = np.where(exact, value * k, (steps // width) * width)  # in units of 1 / (k * width)
        best = max(best, -(-int((counts * mapped).sum()) // (k * width)))
    return best
