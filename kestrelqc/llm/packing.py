"""Token ids in files of fixed-width bit packing.

File format (all integers little-endian)::

    "KTOK1\\0\\0\\0"
    blocks: every BLOCK ids as ceil(n * bits / 64) words of 64 bits, the id i of a block at bit i * bits
    doc ids (int64; null as the smallest value) and starts in the file (int64), by document
    block offsets in the file (int64), one more than there are blocks
    footer: bits, block, documents, tokens, blocks, offset of the doc ids (6 x int64), "KTOK1END"

A block can be read alone, so any document costs a seek and the unpacking of the blocks that it lies in.
"""

from __future__ import annotations

import array
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import new_path, ship
from kestrelqc.llm.pieces import LATIN, Memo, beyond_latin
from kestrelqc.llm.store import create, opened

MAGIC, END = b"KTOK1\0\0\0", b"KTOK1END"
BLOCK = 16_384
NO_ID = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits that hold the ids one after another, ``bits`` each."""
    n = -len(ids) // 64 * -1
    grid = np.zeros((n, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    out = np.zeros((bits, n), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[word] |= grid[i] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= grid[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)[: -(-len(ids) * bits // 64)]


def unpack(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of :func:`pack`."""
    n = -(-count // 64)
    grid = np.zeros((n, bits), np.uint64)
    grid.reshape(-1)[: len(words)] = words
    grid = np.ascontiguousarray(grid.T)
    mask, out = np.uint64((1 << bits) - 1), np.empty((64, n), np.uint32)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        got = grid[word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | grid[word + 1] << np.uint64(64 - shift)
        out[i] = got & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:count]


class Writer:
    """Writes one file; ids of a document may come in any size."""

    def __init__(self, f, bits: int, block: int = BLOCK):
        self.f, self.bits, self.block = f, bits, block
        self.docs, self.starts, self.offsets, self.tokens = [], [], [], 0
        self.held, self.held_n = [], 0
        self.at = f.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= 8 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            self.offsets.append(self.at)
            self.at += self.f.write(pack(ids[k : min(k + self.block, end)], self.bits).astype("<u8").tobytes())
        self.held, self.held_n = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        tail = np.array([self.bits, self.block, len(self.docs), self.tokens, len(self.offsets), self.at], "<i8")
        for x in (self.docs, self.starts, [*self.offsets, self.at], tail):
            self.f.write(np.asarray(x, "<i8").tobytes())
        self.f.write(END)


class Reader:
    """Random access to one file."""

    def __init__(self, f):
        self.f = f
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(size - 56)
        tail = f.read(56)
        if tail[48:] != END:
            raise ValueError("not a whole token file")
        self.bits, self.block, n, self.tokens, blocks, at = map(int, np.frombuffer(tail[:48], "<i8"))
        f.seek(at)
        index = np.frombuffer(f.read(8 * (2 * n + blocks + 1)), "<i8")
        self.docs, self.starts, self.offsets = index[:n], np.append(index[n : 2 * n], self.tokens), index[2 * n :]

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``end - 1``, in one read."""
        if end <= first:
            return np.zeros(0, np.uint32)
        self.f.seek(int(self.offsets[first]))
        raw = self.f.read(int(self.offsets[end] - self.offsets[first]))
        base, out = self.offsets[first], []
        for k in range(first, end):
            count = min(self.block, self.tokens - k * self.block)
            out.append(unpack(np.frombuffer(raw, "<u8", -(-count * self.bits // 64), int(self.offsets[k] - base)), self.bits, count))
        return np.concatenate(out)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at ``start:end`` of the file."""
        first = start // self.block
        got = self.blocks(first, -(-end // self.block))
        return got[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class LibraryEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, each distinct piece being encoded once.

    Pieces go through the library's own model. Texts with characters past Latin go to the library whole, so that its
    tables of Unicode count, and so do texts with an added token's string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = [b for b in range(256) if b not in set(plain)]
        #: The vocabulary's letter for each byte.
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.space = self.letters[ord(" ")]
        self.memo = Memo(encode_one=self._piece, chunk_chars=1)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.space)
        else:
            spelled = "".join(map(self.letters.__getitem__, piece.encode()))
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [not t.isascii() and beyond_latin(t) is not None or any(x in t for x in self.added) for t in texts]
        quick = self.memo.encode(t for t, o in zip(texts, odd, strict=True) if not o)
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if o else np.frombuffer(next(quick), "<u4") for t, o in zip(texts, odd, strict=True)]


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_packed(documents: DataFrame, tokenizer: str, end_id: int | None = 2, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``text`` and write the ids in ascending order of ``doc_id``, one file a partition.

    Returns ``file, first_token, tokens, documents`` by file, in order. One shuffle, of the texts, by range of
    ``doc_id``; rows with equal ``doc_id`` keep the order of their texts' hashes. A null text is an empty document
    (its end id alone), a null ``doc_id`` comes first. An empty table gives no file.
    """
    spark = documents.sparkSession
    ship(spark)
    path = path or new_path(spark, "tokens")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches):
        tokens, file = library_encoder(tokenizer), None
        bits = bits_for(max(tokens.vocabulary, (end_id or 0) + 1))
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        k = TaskContext.get().partitionId()
        name = f"{path}/part-{k:06d}.tok"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with create(name) as f:
            file = Writer(f, bits)
            for batch in (x for many in ([first], batches) for x in many):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts), strict=True):
                    file.add(doc_id, np.concatenate([ids, tail]))
            file.close()
        yield pa.RecordBatch.from_pylist([{"k": k, "file": name, "tokens": file.tokens, "documents": len(file.docs)}])

    # One row a file: as many as partitions.
    files, at = sorted(rows.mapInArrow(run, "k long, file string, tokens long, documents long").collect()), 0
    out = []
    for f in files:
        out.append((f.file, at, f.tokens, f.documents))
        at += f.tokens
    return spark.createDataFrame(out, "file string, first_token long, tokens long, documents long")


def read_packed(files: DataFrame, documents_at_once: int = 256) -> DataFrame:
    """Per document of the files of :func:`write_packed`: ``doc_id, start, n_tokens, ids_crc32``."""
    ship(files.sparkSession)
    n = max(1, min(files.count(), 10_000))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as f:
                    r = Reader(f)
                    for a in range(0, len(r.docs), documents_at_once):
                        b = min(a + documents_at_once, len(r.docs))
                        base = int(r.starts[a])
                        ids, at = r.ids(base, int(r.starts[b])).astype("<u4"), r.starts[a : b + 1] - base
                        crc = [zlib.crc32(ids[at[i] : at[i + 1]]) for i in range(b - a)]
                        docs = r.docs[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(r.starts[a:b] + row["first_token"], pa.int64()), pa.array(np.diff(r.starts[a : b + 1]), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
