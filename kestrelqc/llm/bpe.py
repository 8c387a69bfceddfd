"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can stand last in that prefix's encoding. Storing that token for each
prefix gives the whole encoding by walking back, lets bytes be appended without touching what is stored, and after an
edit leaves all prefixes before it as they are.

A token may follow another if the two encode to themselves when their bytes are joined (:meth:`PrefixBPE.stable`).
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship
from kestrelqc.llm.pieces import Memo

COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


class PrefixBPE:
    """Encoder and decoder for the ranks of a ``.tiktoken`` file."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 100_000):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.longest = max(map(len, ranks))
        #: Every end of a token, and the token if it is one, else -1.
        self.ends: dict[bytes, int] = {}
        for k in ranks:
            for i in range(len(k) - 1, -1, -1):
                self.ends.setdefault(k[i:], ranks.get(k[i:], -1))
        self._stable: dict[int, bool] = {}
        self._edge: dict[int, tuple[list, list] | None] = {}
        self.limit = limit
        self.memo = Memo(self.encode_pieces, limit)

    @classmethod
    def load(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, the leftmost first, until none has a rank."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if rank is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side; with -1 on the left, whether ``right`` does alone."""
        key = left << 32 | right
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) >= 4 * self.limit:
                self._stable.clear()
            found = self._stable[key] = self._judge(left, right)
        return found

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The parts that in turn stand at a token's right and left edge while it is merged, each with the rank of the
        merge that ends it. None unless those ranks rise, so that merges on the two sides of a border can be put in order."""
        try:
            return self._edge[token]
        except KeyError:
            pass
        data = self.bytes_of[token]
        parts, log, get = [data[i : i + 1] for i in range(len(data))], [], self.ranks.get
        right, left = [[parts[-1], None]], [[parts[0], None]]
        while len(parts) > 1:
            rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if rank is None:
                break
            log.append(rank)
            if at == len(parts) - 2:
                right[-1][1] = rank
                right.append([parts[at] + parts[at + 1], None])
            if at == 0:
                left[-1][1] = rank
                left.append([parts[0] + parts[1], None])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        proper = parts == [data] and log == sorted(log)
        found = self._edge[token] = (right, left) if proper else None
        return found

    def _judge(self, left: int, right: int) -> bool:
        """Walk both edges of the border in the order of their merges; a merge across it that comes first settles it."""
        if left < 0:
            return self.merged(self.bytes_of[right]) == [right]
        a, b = self._edges(left), self._edges(right)
        if a is None or b is None:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a, b, i, j, get, never = a[0], b[1], 0, 0, self.ranks.get, 1 << 62
        while True:
            (x, ends_x), (y, ends_y) = a[i], b[j]
            ends_x, ends_y = never if ends_x is None else ends_x, never if ends_y is None else ends_y
            across = get(x + y)
            if across is not None and across < ends_x and across <= ends_y:  # of equal ranks the leftmost goes first
                return False
            if ends_x == never == ends_y:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], starts: list[int]) -> None:
        """Fill the tables of prefixes up to ``len(data)``; the entries that are there already stay."""
        get, known = self.ends.get, self._stable.get
        for i in range(len(last), len(data) + 1):
            found = []
            for j in range(i - 1, -1, -1):
                token = get(data[j:i])
                if token is None:
                    break
                if token >= 0:
                    found.append((j, token))
            for j, token in reversed(found):
                before = last[j]
                if self.stable(before, token) if (ok := known(before << 32 | token)) is None else ok:
                    last.append(token)
                    starts.append(j)
                    break
            else:
                raise ValueError(f"no token can end prefix {i} of {data!r}")

    def encode_piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        return [token] if token is not None else Prefixes(self, data).ids()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids. Sorted pieces share beginnings, so each starts from the table of the one before."""
        table, out = Prefixes(self), []
        for piece in pieces:
            data = piece.encode()
            token = self.ranks.get(data)
            ids = [token] if token is not None else table.become(data).ids()
            out.append(array.array("I", ids).tobytes())
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return next(self.memo.encode([text]))

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The table of one piece: ``last[i]`` ends the encoding of the first ``i`` bytes, and begins at ``starts[i]``."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last, self.starts = bpe, data, [-1], [0]
        bpe.extend(data, self.last, self.starts)

    def append(self, more: bytes) -> Prefixes:
        """Add bytes at the end; no stored prefix changes."""
        self.data += more
        self.bpe.extend(self.data, self.last, self.starts)
        return self

    def become(self, data: bytes) -> Prefixes:
        """Turn into the table of ``data``, keeping what stands for the bytes that both begin with."""
        n = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            n += 1
        del self.last[n + 1 :], self.starts[n + 1 :]
        self.data = data
        self.bpe.extend(data, self.last, self.starts)
        return self

    def splice(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replace bytes ``start:end``; prefixes up to ``start`` are kept.

        After the edit, computing stops as soon as one token's worth of consecutive prefixes begin past the edit and
        have the tokens they had before: all later prefixes are then unchanged.
        """
        old, shift = self.last, len(new) - (end - start)
        old_starts = self.starts
        self.data = self.data[:start] + new + self.data[end:]
        self.last, self.starts = old[: start + 1], old_starts[: start + 1]
        same = 0
        for i in range(start + 1, len(self.data) + 1):
            self.bpe.extend(self.data[:i], self.last, self.starts)
            past = i - shift >= end + 1
            same = same + 1 if past and self.last[i] == old[i - shift] and self.starts[i] >= start + len(new) else 0
            if same >= self.bpe.longest:
                rest = range(i + 1, len(self.data) + 1)
                self.last += [old[k - shift] for k in rest]
                self.starts += [old_starts[k - shift] + shift for k in rest]
                break
        return self

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i = self.starts[i]
        return out[::-1]


@functools.cache
def encoder(path: str) -> PrefixBPE:
    """One encoder for each worker process and file."""
    return PrefixBPE.load(path)


def encode_decode(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode ``text``: counts and digests by document, and with ``with_ids`` the ids as ``array<int>``.

    A null text counts as empty: no ids, and digests of nothing. Texts are never cut. Rows come out once for each
    row in, repeated or not; a null ``doc_id`` stays null; other columns are not read. No shuffle.
    """
    ship(documents.sparkSession)

    def run(batches):
        bpe = encoder(path)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, size, ids = [], [], [], [], []
            for packed in bpe.memo.encode(text.as_py() or "" for text in batch.column("text")):
                decoded = bpe.decode(memoryview(packed).cast("I"))
                n.append(len(packed) // 4)
                a.append(sha(packed).hexdigest())
                b.append(sha(decoded).hexdigest())
                size.append(len(decoded))
                if with_ids:
                    ids.append(packed)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(size, pa.int64())]
            if with_ids:
                ends = np.cumsum([0, *n], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *["ids"] * with_ids])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS + ", ids array<int>" * with_ids)
