"""Fingerprints by majority, and the pigeonring filter on their differences.

A fingerprint's bits are cut into ``m`` segments that form a ring. If two fingerprints differ in at most ``t`` bits, then
from some segment on every chain of 1, 2, .. m consecutive segments holds at most ``t * length / m`` differences. Pairs
without such a chain are dropped before the full Hamming distance is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kestrelqc.llm.words import mixed

_COLUMNS = mixed(np.arange(1001, 1065, dtype=np.uint64))
#: Pairs that are compared at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Ring:
    """How fingerprints are compared: bits, differing bits allowed, segments, and how many segments a chain spans."""

    bits: int = 64
    most: int = 4
    segments: int = 5
    chain: int = 4

    @property
    def cuts(self) -> list[tuple[int, int]]:
        at = [self.bits * i // self.segments for i in range(self.segments + 1)]
        return list(zip(at, at[1:]))

    def budget(self, length: int) -> int:
        return min(self.most, int(self.most * length / self.segments + 1e-9))

    def masks(self) -> np.ndarray:
        """Bits of the chain of each length from each segment on, as 64-bit words: segments x chain x words."""
        chains = np.zeros((self.segments, self.chain, self.bits), np.uint8)
        for i in range(self.segments):
            for length in range(1, self.chain + 1):
                a, b = self.cuts[(i + length - 1) % self.segments]
                chains[i, length - 1 :, a:b] = 1
        return np.ascontiguousarray(np.packbits(chains, axis=2)).view(np.uint64)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of fingerprints with 16-bit segments (rows of 64-bit words): whether a chain stays within its budgets
        from some segment on, and the distance within ``most``. No pair within ``most`` is lost."""
        apart = np.bitwise_count((a ^ b).view(np.uint16)).astype(np.int16)
        total, open_ = apart, apart <= self.budget(1)
        for length in range(2, self.chain + 1):
            total = total + np.roll(apart, 1 - length, axis=1)
            open_ &= total <= self.budget(length)
        out = open_.any(axis=1)
        out[out] = apart[out].sum(axis=1) <= self.most
        return out


def majority(own: np.ndarray, columns: int) -> bytes:
    """SimHash of a set of hashes: of 64 x ``columns`` bits those set in over half of its elements' hashes. Elements go through in blocks."""
    count = np.zeros(columns * 64, np.int64)
    for k in range(0, len(own), 1 << 12):
        bits = np.unpackbits(mixed(own[k : k + (1 << 12), None] ^ _COLUMNS[:columns]).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(own)).tobytes()


def expanded(lo: np.ndarray, hi: np.ndarray, of: np.ndarray):
    """Pairs ``(of[k], j)`` for ``lo[k] <= j < hi[k]``, at most about ``PAIRS`` at once."""
    size = hi - lo
    keep = size > 0
    lo, size, of = lo[keep], size[keep], of[keep]
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        if b == a + 1 and size[a] > PAIRS:
            for k in range(0, int(size[a]), PAIRS):
                n = min(PAIRS, int(size[a]) - k)
                yield np.full(n, of[a]), lo[a] + k + np.arange(n)
        else:
            n = size[a:b]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(of[a:b], n), np.repeat(lo[a:b], n) + inner
        a = b


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each row's is a row of its group that has itself) after joining the groups of ``i[k]`` and ``j[k]``."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def run_ends(key: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, where its run of equal keys ends."""
    last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return last[np.searchsorted(last, np.arange(len(key)), "right")]
