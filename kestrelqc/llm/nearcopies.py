"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.

Every text has a fingerprint of 512 bits, the majority of its shingles' hashes. A pair is compared by pigeonring chains
of the fingerprints, then by the full Hamming distance, and then by the sets themselves, which decide: nothing is linked
on a sketch alone. At the similarity a bit differs with probability 0.15 (0.19 in the worst of short texts), so the bound
of 140 bits is passed by a near copy in one case of a million.

With so many differing bits no pair must share a segment, and segments that nearly all pairs share one of are so short that
unlike texts share them too: the comparisons would grow with the square of the corpus. So texts meet by bands of minima of
their shingles: at a similarity of 0.8 one of the ``BANDS`` bands agrees but in 6 of 100,000 cases, by calculation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, sized, written
from kestrelqc.operators.graph import components
from kestrelqc.llm.joins import attached
from kestrelqc.llm.ring import Ring, expanded, majority, run_ends, united
from kestrelqc.llm.words import Words, chunks, mixed

#: The least similarity that is a near copy, as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 6
#: Fingerprints of two texts at the similarity lie within the bound; the shorter one goes with the bands.
SHORT, WIDE = Ring(128, 48, 8, 4), Ring(512, 140, 32, 6)
#: Rows above which the rows of a band are linked to one of them instead of being compared, and above which a loose group
#: is cut into blocks.
RUN_ROWS, GROUP_ROWS = 4096, 512

_SALTS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """Distinct hashes of the ``shingle``-word runs of each text, ascending; A-Z in lower case.

    Fewer words than a shingle: the whole sequence is one. Without a word the set is empty.
    """
    w = Words.of([t.lower() for t in texts])
    h, _ = w.ngrams(shingle)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if 0 < b - a < shingle:
            out.append(mixed(np.array([sum(int(x) * (2 * i + 1) for i, x in enumerate(w.hashes[a:b])) % (1 << 64)], np.uint64)))
        else:
            out.append(np.unique(h[a : max(a, b - shingle + 1)]))
    return out


def digest(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    at = np.arange(len(own), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.array([mixed(own * at).sum(dtype=np.uint64), mixed(own ^ at).sum(dtype=np.uint64)], np.uint64).tobytes()


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(own), 1024):
        np.minimum(out, ((own[k : k + 1024, None] ^ _SALTS[0]) * (_SALTS[1] | np.uint64(1))).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[k::ROWS])
    return h.view(np.int64)


def _ended(batches):
    yield from batches
    yield None


def _rows_of(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` (a hash of the text, which tells rows of one id apart) and ``text``."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def prints(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id``, ``th``, ``fp`` (digest of the shingles), ``sim`` and ``bands`` of every whole text; the last three are null without a word."""
    ship(documents.sparkSession)
    names, kinds = ["doc_id", "th", "fp", "sim", "bands"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for texts in chunks(batch.column("text")):
                for own in shingle_sets(texts, shingle):
                    out.append((digest(own), majority(own, SHORT.bits // 64), band_keys(minima(own)).tobytes()) if len(own) else (None, None, None))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True))], names=names)

    return _rows_of(documents).mapInArrow(run, "doc_id long, th long, fp binary, sim binary, bands binary")


def _fixed(column, words: int) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def near_in_runs(key: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Label of each row: rows of equal ``key`` (ascending) that a path of near fingerprints joins get the same."""
    label, every = np.arange(len(key)), np.arange(len(key))
    for i, j in expanded(every + 1, run_ends(key), every):
        new = label[i] != label[j]
        i, j = i[new], j[new]
        near = SHORT.near(sim[i], sim[j])
        label = united(label, i[near], j[near])
    return label


def loose_links(classes: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all rows (``node``, ``sim``, ``bands``) that share a band and have near fingerprints.

    Rows are sorted by band over all tasks by range, so that a band of any size spreads over tasks. The rows of a band
    of over ``RUN_ROWS`` rows, or at a border of tasks, are all linked to its first row that a task sees, and the driver
    links those that cross borders, two a task: more is joined here than need be, and never less.
    """
    spark = classes.sparkSession
    ship(spark)
    words = SHORT.bits // 64

    def explode(batches):
        for batch in batches:
            if batch.num_rows:
                key = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node").take(at), batch.column("sim").take(at)], names=["key", "node", "sim"])

    def found(a, b, border: bool):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), border))], names=["a", "b", "border"])

    def link(batches):
        run, size, star = [], 0, True  # the open run: its rows (of a star the first alone), and whether it is one
        ends = []

        def closed(last: bool):
            if star or last:
                key, node = run[0][0], np.concatenate([r[1] for r in run])
                if last or not ends:
                    ends.append((int(key[0]), int(node[0])))
                yield found(np.full(len(node) - 1, node[0]), node[1:], False)
            elif size > 1:
                node = np.concatenate([r[1] for r in run])
                label = near_in_runs(np.zeros(size, np.int64), np.concatenate([r[2] for r in run]))
                at = np.flatnonzero(label != np.arange(size))
                yield found(node[label[at]], node[at], False)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, sim = batch.column("key").to_numpy(), batch.column("node").to_numpy(), _fixed(batch.column("sim"), words)
            start = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)).tolist()
            if run and key[0] == run[0][0][0]:
                part = slice(0, start[1])
                start = start[1:]
                size += part.stop
                run.append((key[part], node[part], sim[part]))
                if size > RUN_ROWS:
                    star = True
                if star:
                    every = np.concatenate([r[1] for r in run])
                    yield found(np.full(len(every) - 1, every[0]), every[1:], False)
                    run = [(run[0][0][:1], run[0][1][:1], run[0][2][:1])]
            if len(start) > 1:
                if run:
                    yield from closed(False)
                    a, star = start[0], False
                else:  # the first run of the task may have begun in another
                    run, size, a = [(key[: start[1]], node[: start[1]], sim[: start[1]])], start[1], start[1]
                    start = start[1:]
                    if len(start) > 1:
                        yield from closed(False)
                        star = False
                if len(start) > 1:
                    b = start[-2]
                    label = near_in_runs(key[a:b], sim[a:b])
                    at = np.flatnonzero(label != np.arange(b - a))
                    if len(at):
                        yield found(node[a:b][label[at]], node[a:b][at], False)
                    run, size = [(key[b:], node[b:], sim[b:])], len(key) - b
        if run:
            yield from closed(True)
            yield found([k for k, _ in ends], [n for _, n in ends], True)

    rows = written(classes.select("node", "sim", "bands").mapInArrow(explode, "key long, node long, sim binary"), "bands")
    links = written(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(link, "a long, b long, border boolean").distinct(), "loose")
    by: dict[int, int] = {}
    more = []
    for r in links.where("border").collect():  # two a task
        if r["b"] != by.setdefault(r["a"], r["b"]):
            more.append((by[r["a"]], r["b"]))
    links = links.where("not border").select("a", "b")
    return links.unionByName(spark.createDataFrame(more, "a long, b long")) if more else links


def verified(sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Label of each row: rows that are ``known`` to be joined, or that a path of near copies joins, get the same.

    Rows of side 1 and 2 meet the other side only. ``prints`` are wide fingerprints; pairs that they leave are compared by
    their sets, unless a path joins them already.
    """
    n = len(sets)
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    label, size = first[back], np.array([len(s) for s in sets])
    for i in range(1, n):
        at = np.flatnonzero((label[:i] != label[i]) & ((side[:i] == 0) | (side[:i] != side[i])) & (DEN * np.minimum(size[:i], size[i]) >= NUM * np.maximum(size[:i], size[i])))
        if not len(at):
            continue
        at = at[WIDE.near(prints[at], np.broadcast_to(prints[i], (len(at), prints.shape[1])))]
        while len(at):
            j = int(at[0])
            both = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            at = at[1:]
            if DEN * common >= NUM * (len(both) - common):
                a, b = sorted((int(label[i]), int(label[j])))
                label[label == b] = a
                at = at[label[at] != a]
    return label


def compared(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` of ``rows`` (``root, part, side, node, known, wide, own``), each ``root, part`` compared in one task."""
    names = ["root", "part", "side", "node", "known", "wide", "own"]

    def link(batches):
        held: list[tuple] = []
        for batch in _ended(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True) if batch is not None else [None]:
                if held and (row is None or row[:2] != held[0][:2]):
                    prints = np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1)
                    label = verified([np.frombuffer(r[6], np.uint64) for r in held], prints, np.array([r[2] for r in held]), np.array([r[4] for r in held]))
                    at = np.flatnonzero(label != np.arange(len(label)))
                    if len(at):
                        ids = np.array([r[3] for r in held])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at])], names=["a", "b"])
                    held = []
                if row is not None and not (held and row[2:4] == held[-1][2:4]):  # a row that repeats
                    held.append(row)

    return rows.select(*names).repartition("root", "part").sortWithinPartitions("root", "part", "node", "side").mapInArrow(link, "a long, b long")


def near_links(documents: DataFrame, classes: DataFrame, shingle: int = 5) -> DataFrame:
    """Links ``a, b`` that join the nodes of ``classes`` (``node, fp, sim, bands`` and ``lead``: id and text of one of its rows) as pairs of the similarity do.

    The texts of loose groups, and no others, are read again for their shingles. A group of over ``GROUP_ROWS`` classes is
    cut into blocks, each compared by itself. Then one of the largest component of each block meets those of the others, and
    at last all rows that are not in the group's largest component so far, in blocks of their own, meet every block. So
    no pair is left out, and a group that is nearly all one component costs little more than its rows.
    """
    roots = written(components(loose_links(classes)), "loose")
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("blocks")).where("blocks > 1")
    wanted = classes.select("node", "fp", "lead").join(roots.withColumnRenamed("v", "node"), "node")
    wanted = written(wanted.join(sized(written(blocks, "blocks")), "root", "left").select("node", "fp", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.col("lead.doc_id").alias("id"), F.col("lead.th").alias("h")), "wanted")
    texts = _rows_of(documents).join(sized(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("root", "blocks", "node", "fp", "text")
    names = ["root", "blocks", "node", "wide", "own"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def read(batches):
        for batch in batches:
            known = zip(*(batch.column(c).to_pylist() for c in ("root", "blocks", "node", "fp")), strict=True)
            for texts in chunks(batch.column("text")):
                rows = [(root, many, node, majority(own, WIDE.bits // 64), own.tobytes()) for own, (root, many, node, fp) in zip(shingle_sets(texts, shingle), known) if len(own) and digest(own) == fp]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = texts.mapInArrow(read, "root long, blocks long, node long, wide binary, own binary")
    side = lambda k: F.lit(k).alias("side")
    block = F.pmod(F.xxhash64("node"), "blocks")
    if roots.isEmpty():
        return roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    sets = written(found, "sets")
    links = written(compared(sets.select("*", block.alias("part"), side(0), F.col("node").alias("known"))), "links")
    hot = sets.where("blocks > 1").withColumn("part", block)
    if hot.isEmpty():
        return links

    def labelled(links: DataFrame) -> DataFrame:
        names = components(links).select(F.col("v").alias("node"), F.col("root").alias("label"))
        return written(hot.select("root", "blocks", "part", "node").distinct().join(names, "node", "left").withColumn("known", F.coalesce("label", "node")).drop("label"), "known")

    known = labelled(links)
    largest = known.groupBy("root", "blocks", "part", "known").agg(F.count("*").alias("n"), F.min("node").alias("node")).groupBy("root", "blocks", "part").agg(F.max(F.struct("n", "node"))["node"].alias("node"))
    some = hot.drop("part", "root", "blocks").join(largest, "node")
    links = written(links.unionByName(compared(some.select("*", side(0), F.col("node").alias("known")).withColumn("part", F.pmod(F.xxhash64("part"), F.ceil(F.col("blocks") / GROUP_ROWS))))), "links")
    known = labelled(links)
    main = known.groupBy("root", "known").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "known"))["known"].alias("main"))
    odd = known.join(main, "root").where(F.col("known") != F.col("main"))
    heaps = written(odd.groupBy("root").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("heaps")), "heaps")
    if heaps.isEmpty():
        return links
    rows = hot.select("node", "wide", "own").join(known.join(heaps, "root").join(main, "root"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("heaps") - 1))
    stay = rows.withColumn("heap", every).select("root", (F.col("part") * F.col("heaps") + F.col("heap")).alias("part"), side(2), "node", "known", "wide", "own")
    visit = rows.where(F.col("known") != F.col("main")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    visit = visit.select("root", (F.col("block") * F.col("heaps") + F.pmod(F.xxhash64("node", F.lit(1)), "heaps")).alias("part"), side(1), "node", "known", "wide", "own")
    return links.unionByName(compared(stay.unionByName(visit)))


def groups(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, th`` (hash of the text), ``fp`` and ``leader`` of every row: the row (``doc_id, th``) that stands for its component.

    Texts of one set of shingles form a class that is compared once. The leader has the smallest ``doc_id`` of its
    component, nulls last, and of these the least hash. A text without a word has null ``fp`` and ``leader``.
    """
    rows = written(prints(documents, shingle), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    classes = written(rows.where("fp is not null").groupBy("fp").agg(least.alias("lead"), F.count("*").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(written(near_links(documents, classes, shingle), "near"))
    joined = written(classes.join(roots.withColumnRenamed("v", "node"), "node").select("fp", "root", "lead"), "joined")
    leaders = joined.join(joined.groupBy("root").agg(F.min("lead").alias("leader")), "root").select("fp", "leader")
    named = classes.join(leaders, "fp", "left").select("fp", "n", F.coalesce("leader", "lead").alias("leader"))
    return attached(rows.select("doc_id", "th", "fp"), written(named, "named"))


def survivors(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component, whole; see ``simhash.keep_one``."""
    found = written(groups(documents, shingle), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("th") == F.col("leader.th"))
    some = found.where("fp is not null")
    gone = written(some.where(~stays).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "gone")
    again = written(some.where(stays).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).count().where("count > 1").drop("count"), "again")
    every = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_hash"), every)
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th"))
    kept = rows.join(sized(gone), same, "left_anti")
    if not again.isEmpty():
        repeated = kept.join(sized(again), same, "left_semi").groupBy("_own", "_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(sized(again), same, "left_anti").unionByName(repeated)
    return kept.select("row.*").select(documents.columns)
