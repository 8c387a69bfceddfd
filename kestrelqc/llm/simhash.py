"""SimHash fingerprints, linked where few bits differ, with the pigeonring filter (see ``ring``).

With fewer differing bits than segments, the segment that a chain within its budgets begins with is equal in both
fingerprints, and the next differs in one bit at most. So fingerprints meet by the values of two consecutive segments,
one of them with each bit of its second segment turned; the longer chains prune, and the Hamming distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, sized, written
from kestrelqc.operators.graph import components
from kestrelqc.llm.joins import attached
from kestrelqc.llm.nearcopies import survivors
from kestrelqc.llm.ring import Ring, expanded, run_ends, united
from kestrelqc.llm.words import chunks

#: Rows under one key above which the key's rows are dealt to several tasks; fingerprints that are dealt out at once.
HOT_ROWS, BATCH = 4096, 1 << 12

#: Four of 64 bits, found without loss.
EXACT = Ring()


def contract_fingerprint(text: bytes, shingle: int = 4) -> bytes:
    """64 bits: XXH64 with seed 42 of each space-joined shingle of words, A-Z in lower case."""
    words = text.lower().split()  # on bytes, both touch ASCII only
    if not words:
        return bytes(8)
    data, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(data, 42)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    view = memoryview(data)
    joined = b"".join([digest(view[a:b], 42) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)])
    # A doc's shingles go through in blocks, so a very long text needs no more memory than its hashes.
    raw, count, n = np.frombuffer(joined, np.uint8).reshape(-1, 8), np.zeros(64, np.int64), len(joined) // 8
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(raw[k : k + (1 << 14)], axis=1)
        for j in range(0, len(bits), 255):
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > n).tobytes()


def fingerprints(documents: DataFrame, shingle: int = 4, columns: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or ``columns``) and the 64-bit ``fp`` of every whole text, as binary. A null text has no words."""
    ship(documents.sparkSession)
    columns = columns or ["doc_id"]
    kinds = dict(documents.dtypes)

    def run(batches):
        for batch in batches:
            out = [contract_fingerprint(t, shingle) for part in chunks(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.binary())], names=[*columns, "fp"])

    return documents.select(*columns, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "fp binary"]))


def _bit_slice(bits: np.ndarray, a: int, b: int) -> np.ndarray:
    """Value of the bits ``a:b`` of each row of 0 and 1."""
    return bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)[::-1])


def _matrix(column) -> np.ndarray:
    """Fingerprints of an Arrow column as rows of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])).reshape(n, -1)


def _keys(fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which fingerprints meet: ``key`` (a segment's number, its value and the next one's), whether a bit of
    the next segment is turned in it, and the row it is of.

    Of two values that differ in one bit one has an even number of set bits; only that one is sent to its neighbours.
    """
    bits = np.unpackbits(fp, axis=1)
    key, turned, row = [], [], []
    for i, (a, b) in enumerate(ring.cuts):
        c, d = ring.cuts[(i + 1) % ring.segments]
        first, second = _bit_slice(bits, a, b), _bit_slice(bits, c, d)
        base = (np.int64(i) << 48) + (first << 24)
        key.append(base + second)
        turned.append(np.zeros(len(fp), bool))
        row.append(np.arange(len(fp)))
        even = np.flatnonzero(np.bitwise_count(second) % 2 == 0)
        for k in range(d - c):
            key.append(base[even] + (second[even] ^ (1 << k)))
            turned.append(np.ones(len(even), bool))
            row.append(even)
    return np.concatenate(key), np.concatenate(turned), np.concatenate(row)


def forest(group: np.ndarray, segment: np.ndarray, turned: np.ndarray, side: np.ndarray, fp: np.ndarray, ring: Ring) -> np.ndarray:
    """Label of each row: rows of equal ``group`` that a path of links joins get the same label.

    ``group`` is ascending, and in a group the rows that are ``turned`` come last; these meet only the others. Rows of
    ``side`` 1 or 2 meet only the other side's (a key's rows that are dealt out by pairs of blocks).
    """
    n = len(group)
    label = np.arange(n)
    masks, words = ring.masks(), np.ascontiguousarray(fp).view(np.uint64)
    home = np.flatnonzero(~turned)
    for i, j in expanded(home + 1, run_ends(group)[home], home):
        new = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[new], j[new]
        if not len(i):
            continue
        apart = words[i] ^ words[j]
        for length in range(2, ring.chain + 1):
            near = np.bitwise_count(apart & masks[segment[i], length - 1]).sum(axis=1) <= ring.budget(length)
            i, j, apart = i[near], j[near], apart[near]
        near = np.bitwise_count(apart).sum(axis=1) <= ring.most
        label = united(label, i[near], j[near])
    return label


def near_links(classes: DataFrame, ring: Ring) -> DataFrame:
    """Links ``a, b`` that join the rows of ``classes`` (``node`` long and unique, ``fp`` binary and distinct) as near pairs do.

    Every near pair ends up joined by a path of links; not every pair is a link itself, so a group of any size gives
    fewer links than it has rows, at each segment. Keys have about 26 bits, and a class has 38 rows of them on average,
    however many classes there are. A key with over ``HOT_ROWS`` rows is dealt to a task for each pair of its blocks.
    """
    if ring.most >= ring.segments or ring.budget(2) > 1:
        raise ValueError("fewer differing bits than segments, and one at most in two, are needed to find every pair")
    ship(classes.sparkSession)

    def deal(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                key, turned, row = _keys(_matrix(part.column("fp")), ring)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(turned), part.column("node").take(take), part.column("fp").take(take)], names=["key", "turned", "node", "fp"])

    dealt = classes.select("node", "fp").mapInArrow(deal, "key long, turned boolean, node long, fp binary")
    hot = written(dealt.where("not turned").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).alias("blocks")), "hot")
    if hot.isEmpty():
        dealt = dealt.withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    else:
        block = F.pmod(F.xxhash64("node"), "blocks")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.join(sized(hot), "key", "left").withColumns({"block": F.coalesce(block, F.lit(0)), "other": other})
        pair = F.least("block", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("block", "other")
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        dealt = dealt.withColumns({"pair": pair, "side": side})
    dealt = dealt.select("key", "pair", "turned", F.col("side").cast("int").alias("side"), "node", "fp")

    def link(batches):
        held = None
        for batch in _ended(batches):
            t = pa.Table.from_batches([batch]) if batch is not None else None
            if held is not None:
                t = held if t is None else pa.concat_tables([held, t])
            if t is None or not t.num_rows:
                continue
            key, pair = t.column("key").to_numpy(), t.column("pair").to_numpy()
            new = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            end = t.num_rows
            if batch is not None:  # the last group may go on in the next batch
                end = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            held = t.slice(end) if batch is not None else None
            if not end:
                continue
            t, key, group = t.slice(0, end), key[:end], np.concatenate([[0], np.cumsum(new)])[:end]
            label = forest(group, key >> 48, t.column("turned").to_numpy(), t.column("side").to_numpy(), _matrix(t.column("fp")), ring)
            node = t.column("node").to_numpy()
            at = np.flatnonzero(label != np.arange(len(label)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at])], names=["a", "b"])

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "turned").mapInArrow(link, "a long, b long")


def _ended(batches):
    yield from batches
    yield None


def linked(prints: DataFrame, ring: Ring) -> DataFrame:
    """``prints`` (``doc_id`` and ``fp``) with ``component_id``, the smallest ``doc_id`` that a path of links reaches.

    Equal fingerprints form a class that is compared once; links are between rows, so rows that share an id are joined
    only if their fingerprints are. A null ``doc_id`` is never the smallest: the component of null ids alone is null. A
    null ``fp`` is like no other: its row's component is the row itself. Rows that repeat come out as often.
    """
    prints = written(prints, "prints")
    classes = written(prints.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(written(near_links(classes, ring), "near"))
    # Only classes with a link to another.
    named = written(classes.join(roots.withColumnRenamed("v", "node"), "node").select("fp", "root", "least"), "named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = attached(prints, written(named, "named"))
    return out.select("doc_id", "fp", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``: 4-word shingles, 64 bits, 4 or fewer apart."""
    out = linked(fingerprints(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), EXACT)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents without near copies, whole rows: of each component the row of the smallest ``doc_id`` stays.

    Near copies have a Jaccard similarity of their word shingles of 0.8 or more (see ``nearcopies``). Rows are told apart
    by id and text: rows that share an id stay if their texts are no near copies. A null id is larger than any; of
    rows of one id in a component the one whose text has the least hash stays, and of rows that also share the text
    one. Rows without a word all stay.
    """
    return survivors(documents, shingle)
