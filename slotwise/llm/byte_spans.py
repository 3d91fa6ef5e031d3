"""Spans of bytes chosen by content, and hashes of byte ranges, as numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

from .words import mixed

GRAM = 24
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POSITION = np.uint64((1 << 24) - 1)
#: Texts are read in parts of at most this many bytes, which overlap by one window less a byte.
PART = 1 << 23


@functools.cache
def _table() -> np.ndarray:
    return np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest text so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return cls.up, cls.down


class Ranges:
    """Hashes of ranges of one text."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_table()[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One per range [start, end); equal bytes have equal hashes."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of all ranges of ``size`` bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Every window of a text once, gathered in runs that share an anchor.

    The anchor of a window is its gram with the least hash (the first of equals), so that equal windows
    have equal anchors at equal places. Returns, per run, the first window's start, the number of
    windows, the anchor's hash, a hash of all that the run's windows cover and of the anchor's place in
    it, and where the anchor starts.
    """
    empty, hashless = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    none = empty, empty, hashless, hashless, empty
    if len(data) < window:
        return none
    out = []
    for base in range(0, len(data) - window + 1, PART):
        part = data[base : base + PART + window - 1]
        ranges = Ranges(part)
        grams = ranges.every(GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams & ~_POSITION) | place, window - GRAM + 1)
        anchor = (least & _POSITION).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([starts, [len(anchor)]]))
        at = anchor[starts]
        covered = ranges.hashes(starts, starts + count - 1 + window)
        covered = mixed(covered + (count + ((at - starts) << 20)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((starts + base, count, grams[at], covered, at + base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]
