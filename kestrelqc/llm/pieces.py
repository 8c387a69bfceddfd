"""The pre-tokenizer of the byte-level vocabularies, as one compiled ``re`` pattern.

``public_tokenizers.PATTERN`` uses ``\\p{L}``, ``\\p{N}`` and ``\\s``; here these three classes are written out, which the
standard ``re`` engine scans several times faster. Their members are asked of the tiktoken library itself, whose
Unicode tables may be of another version than Python's.
"""

from __future__ import annotations

import functools
import re
import sys

import tiktoken


@functools.cache
def members(kind: str, end: int = sys.maxunicode + 1) -> str:
    """All characters of a class below ``end``, in order, by the library's tables."""
    every = "".join(map(chr, [*range(min(end, 0xD800)), *range(0xE000, end)]))
    library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    return bytes(library.encode_ordinary(every)).decode()


def _ranges(kind: str, end: int) -> str:
    out, start, last = [], None, -2
    for c in map(ord, members(kind, end)):
        if c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def _compiled(end: int):
    letters, digits, spaces = _ranges(r"\p{L}", end), _ranges(r"\p{N}", end), _ranges(r"\s", end)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall


#: Texts without a character from here on are scanned with classes that are a bitmap.
LATIN = 0x250
beyond_latin = re.compile(f"[^\x00-{chr(LATIN - 1)}]").search


def pieces(text: str) -> list[str]:
    """The pieces of a text that are encoded separately."""
    return _compiled(sys.maxunicode + 1 if not text.isascii() and beyond_latin(text) else LATIN)(text)


class _Young(dict):
    """Takes what it lacks from the older generation, or encodes it."""

    old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.encode_one(piece)
        self[piece] = out
        return out


class Memo:
    """Ids of pieces, as bytes (little-endian, unsigned, 32 bits), in two generations of about ``limit`` entries each.

    ``encode_one`` gets a piece not met lately; ``encode_many``, if given instead, all such pieces of some texts, in the
    order of their code points, and gives their ids in that order.
    """

    def __init__(self, encode_many=None, limit: int = 200_000, chunk_chars: int = 1 << 20, encode_one=None):
        self.encode_one, self.encode_many, self.limit, self.chunk_chars = encode_one, encode_many, limit, chunk_chars
        self.young = self._new({})

    def _new(self, old: dict[str, bytes]) -> _Young:
        young = _Young()
        young.old, young.encode_one = old, self.encode_one
        return young

    def encode(self, texts):
        """Ids of each of the texts, in order."""
        held, chars = [], 0
        for text in texts:
            held.append(pieces(text))
            chars += len(text)
            if chars >= self.chunk_chars:
                yield from self._encode(held)
                held, chars = [], 0
        yield from self._encode(held)

    def _encode(self, lists: list[list[str]]):
        if len(self.young) >= self.limit:
            self.young.old = {}
            self.young = self._new(dict(self.young))
        young = self.young
        if self.encode_many:
            old, new = young.old, []
            for p in set().union(*lists).difference(young):
                if (known := old.get(p)) is None:
                    new.append(p)
                else:
                    young[p] = known
            new.sort()
            young.update(zip(new, self.encode_many(new), strict=True))
        for x in lists:
            yield b"".join(map(young.__getitem__, x))
