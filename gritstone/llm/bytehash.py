"""Vectorised hashes of byte ranges, for use inside tasks.

A buffer's prefix sums of ``code(byte) * base**position`` modulo 2**64 give the
hash of any range by one subtraction and one multiplication with the inverse
power, so all words, shingles or windows of a text are hashed without a loop
over them. Byte codes are random 64-bit numbers and a mixer spreads the result.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_powers = {"n": 0}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values, one to one."""
    x = values.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        up = np.full(size, BASE, U64)
        down = np.full(size, INVERSE, U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


class Ranges:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: bytes | np.ndarray):
        raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray)) else data
        up, self._down = _powers_up_to(len(raw) + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(len(raw) + 1, U64)
            np.cumsum(CODES[raw] * up[: len(raw)], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes, as :meth:`hash` gives them."""
        with np.errstate(over="ignore"):
            return mix((self._sums[size:] - self._sums[:-size]) * self._down[: len(self._sums) - size] + U64(size))


def words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words (runs without ASCII white space) joined by single spaces, lower-cased A-Z, with starts and ends."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; one for all words of a shorter text, none without words."""
    joined, starts, ends = words(text)
    if not len(starts):
        return np.empty(0, U64)
    k = min(width, len(starts))
    return np.unique(Ranges(joined).hash(starts[: len(starts) - k + 1], ends[k - 1 :]))
