"""Words of many texts at once, in numpy: borders, hashes, n-gram hashes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials over the bytes modulo 2**64
with random coefficients, so each is a difference of two running sums; they do not depend on place, process or run.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_ODD, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of ``n`` texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray  # bytes of all texts, a newline after each
    bounds: np.ndarray  # where each text begins in data; one more for the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], between: np.ndarray = SPACE) -> Words:
        """``between`` says of each byte whether it stands between words; a newline must."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        space = between[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]  # the newline at the end closes the last word
        return cls(data, bounds, starts, ends, np.searchsorted(starts, bounds))

    @functools.cached_property
    def _running(self) -> np.ndarray:
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_values()[self.data] * _powers(len(self.data) + 1)[0][: len(self.data)], out=run[1:])
        return run

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes."""
        return mixed((self._running[ends] - self._running[starts]) * _powers(len(self.data) + 1)[1][starts] + (ends - starts).astype(np.uint64))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """Hash of each word."""
        return self.spans(self.starts, self.ends)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they all lie in one text."""
        h = self.hashes
        count = max(0, len(h) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out = out * _ODD + h[k : k + count]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mixed(out), text[n - 1 :] == text[:count]


def chunks(texts, limit: int = 1 << 19):
    """Lists of consecutive texts as bytes (null as empty), each of ``limit`` bytes or one text more."""
    out, size = [], 0
    for t in texts:
        b = (t.as_buffer().to_pybytes() if t.is_valid else b"") if hasattr(t, "as_buffer") else (t or "").encode()
        out.append(b)
        size += len(b)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out
