"""Elias-Fano sequences in numpy, laid out so that they can be memory-mapped and are read where they lie."""

from __future__ import annotations

import numpy as np

_ONE, _SIX, _WORD = np.uint64(1), np.uint64(6), np.uint64(63)
#: Rows whose low bits are packed at a time; a multiple of 64, so that each part ends at a word's end.
_ROWS = 1 << 18


def _low_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of every value, one after another in 64-bit words, and a word of zeros."""
    parts = []
    for k in range(0, len(values), _ROWS):
        bits = np.unpackbits(np.ascontiguousarray(values[k : k + _ROWS], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts.append(np.packbits(bits[:, :width].ravel(), bitorder="little"))
    raw = np.concatenate([*parts, np.zeros(8, np.uint8)])
    return np.append(raw, np.zeros(-len(raw) % 8 + 8, np.uint8)).view(np.uint64)


def _nth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) in each word."""
    at = np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= count
        k = np.where(up, k - count, k)
        words = np.where(up, words >> np.uint64(half), words)
        at += np.where(up, half, 0)
    return at


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits in unary, sampled ranks of the unary bits.

    ``ranks`` holds the number of set bits before each 64-bit word of the unary bits; select starts from it and ends in
    the word, so nothing is unpacked when a sequence is opened. ``find``, ``access`` and ``steps`` take arrays.
    """

    PARTS = ("head", "low", "high", "ranks")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.width = (int(x) for x in head)
        self.low, self.high, self.ranks = low, high, ranks

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        values, n = np.asarray(values, np.uint64), len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = np.zeros(-(-(n + (universe >> width) + 1) // 64) * 64 + 64, np.uint8)  # a word of zeros comes last
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.uint32)
        low = _low_bits(values, width) if width else np.zeros(2, np.uint64)
        return {"head": np.array([n, width], np.int64), "low": low, "high": high, "ranks": np.cumsum(count, dtype=np.uint32) - count}

    @classmethod
    def named(cls, levels: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*(levels[f"{name}.{part}"] for part in cls.PARTS))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> _SIX).astype(np.int64), bit & _WORD
        x = (self.low[word] >> shift) | ((self.low[word + 1] << (_WORD - shift)) << _ONE)
        return x & np.uint64((1 << self.width) - 1)

    def _ones(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of the unary bits."""
        word = np.searchsorted(self.ranks, k.astype(np.uint32), side="right") - 1
        return word * 64 + _nth_bit(self.high[word], k - self.ranks[word].astype(np.int64))

    def _zeros(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th unset bit of the unary bits."""
        before = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
        word = np.searchsorted(before, k, side="right") - 1
        return word * 64 + _nth_bit(~self.high[word], k - before[word])

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return ((self._ones(at) - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def steps(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at and after each place, as signed numbers."""
        return self.access(at).astype(np.int64), self.access(np.asarray(at) + 1).astype(np.int64)

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the elements whose high bits are ``bucket``: the run of set bits after the unset bit before it."""
        bit = np.zeros(len(bucket), np.int64)
        later = np.flatnonzero(bucket > 0)
        bit[later] = self._zeros(bucket[later] - 1) + 1
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        window = (self.high[word] >> shift) | ((self.high[np.minimum(word + 1, len(self.high) - 1)] << (_WORD - shift)) << _ONE)
        run = np.bitwise_count((window ^ (window + _ONE)) >> _ONE).astype(np.int64)
        first = bit - bucket
        long = np.flatnonzero(run >= 63)
        run[long] = self._zeros(bucket[long]) - bit[long]
        return first, first + run

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: place of the first element >= value, within [first, last) if given, and whether it is equal."""
        values = np.asarray(values, np.uint64)
        part = values & np.uint64((1 << self.width) - 1)
        lo, hi = self._bucket((values >> np.uint64(self.width)).astype(np.int64))
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        top = hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < part[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        equal = lo < top
        at = np.flatnonzero(equal)
        equal[at] = self._low(lo[at]) == part[at]
        return lo, equal


def laid_out(levels: dict[str, np.ndarray]) -> tuple[list[bytes], list[tuple[str, str, int, int]]]:
    """The arrays as bytes to be written one after another, and their directory: name, type, length, place."""
    chunks, directory, at = [], [], 0
    for name, values in levels.items():
        raw = np.ascontiguousarray(values)
        directory.append((name, raw.dtype.str, len(raw), at))
        chunks.append(raw.tobytes() + b"\0" * (-raw.nbytes % 8))
        at += len(chunks[-1])
    return chunks, directory


def opened(raw, directory: list[tuple[str, str, int, int]]) -> dict[str, np.ndarray]:
    """The arrays of a mapped file or of a buffer, where they lie."""
    return {name: np.frombuffer(raw, kind, n, at) if n else np.zeros(0, kind) for name, kind, n, at in directory}
