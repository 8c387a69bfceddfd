"""Benchmark decontamination by the q-gram lemma.

A text that aligns with a passage of ``w`` characters within ``k`` edits shares at least ``w + 1 - q - k * q`` of its
q-grams, all on diagonals that lie within ``k`` of each other. Benchmark items are cut into overlapping passages; shared
q-grams are counted in overlapping bands of diagonals; bands that meet the bound are verified by banded alignment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship
from kestrelqc.llm.words import Words

Q, PASSAGE, STRIDE = 8, 100, 50
#: Shorter passages beside: any run of ``SHORT + SHORT_STRIDE - 1`` = 75 characters of an item (13 words or so) holds one whole.
SHORT, SHORT_STRIDE = 60, 16
#: Edits allowed, as a share of a passage; fewer where the lemma would not bind.
EDITS = 0.1
#: Items of fewer normalised characters are found only whole, without an edit, between borders of words.
MIN_CHARS = 24
#: Characters of benchmark text that one pass over the documents looks for (a few hundred MB of index at most).
BLOCK_CHARS = 4_000_000
TEXT_CHARS = 1 << 19
#: No region that aligns with a passage is longer; entries of the index that are counted at once; entries of a text from
#: which on its repetitions are looked for.
REACH, ENTRIES, HEAVY = 128, 1 << 17, 1 << 16
#: Pairs of a text and a passage up to which they are counted in a table.
BINS = 1 << 22

_BEYOND = re.compile(r"[^\x00-\xff]")
_FOLD = bytearray(b" " * 256)
for _c in range(256):
    if chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if ord(chr(_c).lower()) < 256 else _c
_FOLD = bytes(_FOLD)


def normalised(text: str) -> bytes:
    """One byte a character: lower case, and a space for each run of others than letters and digits.

    Characters past Latin-1 are folded to 64 byte values, which keeps different words different.
    """
    text = text.lower()
    if not text.isascii():
        text = _BEYOND.sub(lambda m: chr(0xC0 + (ord(m[0]) * 2654435761 >> 7) % 63) if m[0].isalnum() else " ", text)
    return b" ".join(text.encode("latin-1").translate(_FOLD).split())


@dataclass
class Index:
    """Distinct passages of a block of benchmark items, and the q-grams of the items in ascending order.

    A passage is indexed where it stands first. Places in items are numbered through all items.
    """

    held: list[list[int]]  # by passage: the items that hold it, each as often as it does
    size: np.ndarray  # by passage
    budget: np.ndarray
    bound: np.ndarray
    text: np.ndarray  # passages x PASSAGE bytes, zero-padded
    grams: np.ndarray  # distinct
    first: np.ndarray  # grams[i] has the entries first[i]:first[i + 1]
    entry: np.ndarray  # places in items, ascending in a gram
    item: np.ndarray  # by place: the number of its item
    around: np.ndarray  # the passages around a place are around[bounds[place]:bounds[place + 1]]
    bounds: np.ndarray
    begins: np.ndarray  # by passage: its first place
    maybe: np.ndarray  # by 20 bits of hash
    whole: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: hashes of the short items, ascending, and their passages

    @property
    def least(self) -> int:
        """The smallest bound of any passage."""
        return int(self.bound[: len(self.begins)].min())

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        held: dict[bytes, list[int]] = {}
        whole_held: dict[bytes, list[int]] = {}
        begins: dict[bytes, int] = {}
        places, length = [], 0
        for item, text in items:
            t = normalised(text or "")
            if len(t) < MIN_CHARS:
                if t:
                    whole_held.setdefault(t, []).append(item)
                continue
            for size, stride in ((PASSAGE, STRIDE), (SHORT, SHORT_STRIDE)) if len(t) > SHORT else ((PASSAGE, STRIDE),):
                last = max(0, len(t) - size)
                for a in sorted({*range(0, last, stride), last}):
                    held.setdefault(t[a : a + size], []).append(item)
                    begins.setdefault(t[a : a + size], length + a)
            places.append(t)
            length += len(t)
        rows, short = sorted(held, key=len), list(whole_held)
        n, every = len(rows), [*rows, *short]
        size = np.array([len(r) for r in every], np.int64)
        budget = np.minimum((size * EDITS).astype(np.int64), (size - Q) // Q)
        budget[n:] = 0
        text = np.zeros((len(every), PASSAGE), np.uint8)
        for i, r in enumerate(every):
            text[i, : len(r)] = np.frombuffer(r, np.uint8)
        begin = np.array([begins[r] for r in rows], np.int64)
        grams_of = size[:n] - Q + 1
        at = np.repeat(begin - np.cumsum(grams_of) + grams_of, grams_of) + np.arange(int(grams_of.sum()))
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(length + 1))
        place = np.unique(at)  # a gram at a place of a passage lies in the passage's item
        gram = qgrams(np.frombuffer(b"".join(places), np.uint8))[place]
        item = np.repeat(np.arange(len(places)), [len(t) for t in places])
        by = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[by], return_index=True)
        around, entry = np.repeat(np.arange(n), grams_of)[order], place[by]
        maybe = np.zeros(1 << 20, bool)
        maybe[_slot(grams)] = True
        whole = {}
        for words in {r.count(b" ") + 1 for r in short}:
            at = np.array([n + i for i, r in enumerate(short) if r.count(b" ") + 1 == words])
            h = np.concatenate([Words.of([every[i]]).ngrams(words)[0] for i in at])
            by = np.argsort(h)
            whole[words] = h[by], at[by]
        return cls([held[r] for r in rows] + [whole_held[r] for r in short], size, budget, size + 1 - Q - budget * Q, text, grams, np.append(first, len(gram)), entry, item, around, bounds, begin, maybe, whole)


def qgrams(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number."""
    n = max(0, len(data) - Q + 1)
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    for k in range(min(Q, n)):
        part = padded[k : k + (n - k + Q - 1) // Q * Q]
        out[k::Q] = part.view("<u8") if part.flags.c_contiguous else np.ascontiguousarray(part).view("<u8")
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def aligned(passages: np.ndarray, sizes: np.ndarray, budgets: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits that turn each passage into a part of its region (row by row), by alignment in a band.

    ``regions`` is as wide as the longest passage and the band; the part may begin on any of the region's first
    diagonals, as many as ``regions`` is wider than the passages.
    """
    n, m = passages.shape
    band = regions.shape[1] - m + 1
    far = np.int32(1 << 20)
    steps = np.arange(band, dtype=np.int32)
    row = np.zeros((n, band), np.int32)  # by diagonal
    best = np.full(n, far, np.int32)
    best[sizes == 0] = 0
    for i in range(m):
        cost = row + (regions[:, i : i + band] != passages[:, i : i + 1])
        cost[:, :-1] = np.minimum(cost[:, :-1], row[:, 1:] + 1)  # a character of the passage is missing
        row = np.minimum.accumulate(cost - steps, axis=1) + steps  # characters of the region are extra
        ended = sizes == i + 1
        if ended.any():
            best[ended] = row[ended].min(axis=1)
    return best


def may_align(passages: np.ndarray, sizes: np.ndarray, budgets: np.ndarray, regions: np.ndarray, q: int = 3) -> np.ndarray:
    """Whether so many short q-grams of each passage stand on the region's first diagonals as its edits must leave whole."""
    n, m = passages.shape
    met = np.zeros((n, m - q + 1), bool)
    for d in range(regions.shape[1] - m + 1):
        same = regions[:, d : d + m] == passages
        met |= same[:, :-2] & same[:, 1:-1] & same[:, 2:]
    met &= np.arange(m - q + 1) <= (sizes - q)[:, None]
    return met.sum(axis=1) >= sizes + 1 - q - budgets * q


def whole_items(index: Index, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of normalised texts: where each short item stands first, by (text, passage): (0, start, end)."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not index.whole:
        return found
    w = Words.of(texts)
    for words, (known, passage) in index.whole.items():
        h, inside = w.ngrams(words)
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        for x in np.flatnonzero(inside & (hi > lo)).tolist():
            of = int(np.searchsorted(w.bounds, w.starts[x], "right")) - 1
            a, b = int(w.starts[x] - w.bounds[of]), int(w.ends[x + words - 1] - w.bounds[of])
            for p in passage[lo[x] : hi[x]].tolist():
                if bytes(index.text[p, : index.size[p]]) == texts[of][a:b]:
                    found.setdefault((of, p), (0, a, b))
    return found


def first_contexts(texts: list[bytes], at: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (ascending) are the first of their text with what stands up to ``REACH`` characters around them.

    A region that a passage aligns with is shorter than ``REACH``. If a place in it is left out, the whole region
    stands in the text before, so the first copy of every region keeps all its places: nothing is lost, and a text that
    repeats itself costs no more than what it repeats. Texts of few entries are left as they are.
    """
    if not len(at):
        return np.zeros(0, bool)
    start = np.maximum(at - REACH, bounds[text])
    h = Words.of(texts).spans(start, np.minimum(at + REACH, bounds[text + 1] - 1)) + (at - start).astype(np.uint64)
    order = np.lexsort((at, h, text))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])])
    keep = np.zeros(len(at), bool)
    keep[order[new]] = True
    return keep


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """Of normalised texts: (text, passage, edits, start, end) for each passage found, with the fewest edits."""
    found = whole_items(index, texts)
    if not len(index.grams):
        return [(*k, *v) for k, v in sorted(found.items())]
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    g = qgrams(data)
    at = np.flatnonzero(index.maybe[_slot(g)])
    k = np.minimum(np.searchsorted(index.grams, g[at]), len(index.grams) - 1)
    same = index.grams[k] == g[at]
    at, k = at[same], k[same]
    text = np.searchsorted(bounds, at, "right") - 1
    heavy = np.bincount(text, index.first[k + 1] - index.first[k], len(texts)) > HEAVY
    if heavy.any():
        same = ~heavy[text]
        same[~same] = first_contexts(texts, at[~same], text[~same], bounds)
        at, k, text = at[same], k[same], text[same]
    # So many places, or entries of one place, at once that their entries stay few.
    candidates: list[tuple] = []
    first, last = index.first[k], index.first[k + 1]
    for part in _parts(last - first, text, ENTRIES):
        blocks = -(-int((last[part] - first[part]).sum()) // ENTRIES)
        cut = [index.first[k[part]] if not c else index.first[k[part] + 1] if c == blocks else _up_to(index, k[part], len(index.item) * c // blocks) for c in range(blocks + 1)]
        for lo, hi in zip(cut, cut[1:]):
            candidates.append(_in_bands(index, bounds, at[part], text[part], lo, hi))
            if sum(len(c[0]) for c in candidates) >= ENTRIES:
                _align(index, texts, data, bounds, candidates, found)
                candidates = []
    if candidates:
        _align(index, texts, data, bounds, candidates, found)
    return [(*k, *v) for k, v in sorted(found.items())]


def _up_to(index: Index, k: np.ndarray, place: int) -> np.ndarray:
    """For each of the grams ``k`` its first entry in the item of ``place`` or later."""
    begin = int(np.searchsorted(index.item, index.item[min(place, len(index.item) - 1)]))
    u, back = np.unique(k, return_inverse=True)
    return np.array([index.first[x] + np.searchsorted(index.entry[index.first[x] : index.first[x + 1]], begin) for x in u], np.int64)[back]


def _near_diagonals(index: Index, at: np.ndarray, text: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which hits (place in the texts, its text, place in the items) share an item's band of diagonals with so many others as
    a passage's bound at least. Bands are counted by a hash, so some more may stay."""
    band = (at - entry + (1 << 40)) >> 4  # wider than any passage's; each counts for its band and the next
    key = (band + index.item[entry] * 0x9E3779B97F4A7C1 + text * 0xBF58476D1CE4E5B) * 0x2545F4914F6CDD1D
    bits = max(12, (2 * len(at)).bit_length())
    slot = lambda x: (x >> 20) & ((1 << bits) - 1)
    one, two = slot(key), slot(key + 0x2545F4914F6CDD1D)
    count = np.bincount(one, minlength=1 << bits)
    count += np.bincount(two, minlength=1 << bits)
    return np.maximum(count[one], count[two]) >= index.least


def _in_bands(index: Index, bounds: np.ndarray, at: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (passage, text, band) by the entries ``lo:hi`` of each place: bands of diagonals in which the bound is met.

    Hits are counted for whole items first; those that may matter are then counted for the passages around their place.
    """
    n, many = hi - lo, len(index.size)
    entry = index.entry[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    at, of = np.repeat(at, n), np.repeat(text, n)
    keep = _near_diagonals(index, at, of, entry)
    entry, at, of = entry[keep], at[keep], of[keep]
    lo, hi = index.bounds[entry], index.bounds[entry + 1]
    n = hi - lo
    p = index.around[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    entry, at, of = np.repeat(entry, n), np.repeat(at, n), np.repeat(of, n)
    key = of * many + p
    # Fewer in all than the bound: no band can reach it.
    low = int(text[0]) * many
    bins = (int(text[-1]) + 1) * many - low
    if bins <= BINS:
        keep = np.flatnonzero(np.bincount(key - low, minlength=bins)[key - low] >= index.bound[p])
    else:
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[inverse] >= index.bound[p])
    p, key, of, at, entry = p[keep], key[keep], of[keep], at[keep], entry[keep]
    if not len(p):
        return p, of, of
    diagonal = at - bounds[of] - (entry - index.begins[p]) + PASSAGE
    width = index.budget[p] + 1
    band = diagonal // width
    span = int(band.max()) + 2
    both = np.concatenate([key * span + band, key * span + band - 1 * (band > 0)])  # bands overlap by half
    u, count = np.unique(both, return_counts=True)
    p, of, band = u // span % many, u // span // many, u % span
    keep = count >= index.bound[p]
    p, of, band = p[keep], of[keep], band[keep]
    return p, of, band


def _regions(index: Index, data: np.ndarray, bounds: np.ndarray, p: np.ndarray, of: np.ndarray, band: np.ndarray):
    """Where the band of each candidate begins, and its region; all passages have one budget."""
    budget, longest = int(index.budget[p[0]]), int(index.size[p].max())
    start = bounds[of] + band * (budget + 1) - PASSAGE - budget
    place = start[:, None] + np.arange(longest + 3 * budget + 3)
    inside = (place >= bounds[of][:, None]) & (place < bounds[of + 1][:, None] - 1)
    return start, longest, np.where(inside, data[np.clip(place, 0, len(data) - 1)], np.uint8(0))


def _align(index: Index, texts: list[bytes], data: np.ndarray, bounds: np.ndarray, candidates: list[tuple], found: dict) -> None:
    """Align the candidates (passage, text, band), and add what is within its budget to ``found``."""
    p, of, band = (np.concatenate(x) for x in zip(*candidates, strict=True))
    for budget in np.unique(index.budget[p]).tolist():
        same = np.flatnonzero(index.budget[p] == budget)
        same = same[np.argsort(index.size[p[same]], kind="stable")]
        keep = []
        for c in range(0, len(same), 4096):
            at = same[c : c + 4096]
            _, longest, region = _regions(index, data, bounds, p[at], of[at], band[at])
            keep.append(at[may_align(index.text[p[at], :longest], index.size[p[at]], index.budget[p[at]], region)])
        same = np.concatenate(keep)
        for c in range(0, len(same), 4096):
            at = same[c : c + 4096]
            start, longest, region = _regions(index, data, bounds, p[at], of[at], band[at])
            edits = aligned(index.text[p[at], :longest], index.size[p[at]], index.budget[p[at]], region)
            for x in np.flatnonzero(edits <= budget).tolist():
                text, passage, begin = int(of[at[x]]), int(p[at[x]]), int(start[x] - bounds[of[at[x]]])
                new = (int(edits[x]), max(0, begin), min(len(texts[text]), begin + int(index.size[passage]) + 3 * budget + 3))
                if (text, passage) not in found or new < found[text, passage]:
                    found[text, passage] = new


def _parts(weight: np.ndarray, group: np.ndarray, limit: int):
    """Slices between groups of about ``limit`` in weight, or of one group."""
    if not len(weight):
        return
    total = np.cumsum(weight)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    a, base = 0, 0
    while a < len(weight):
        fit_ = ends[(ends > a) & (total[ends - 1] - base <= limit)]
        b = int(fit_[-1]) if len(fit_) else int(ends[ends > a][0])
        yield slice(a, b)
        a, base = b, int(total[b - 1])


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """The benchmark's items in lists of about ``chars`` characters, in no order. Null texts are no items."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text") + 50)).first()[0] or 0
    n = max(1, -(-total // chars))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        got = [(r["item_id"], r["text"]) for r in part.collect()]
        if got:
            yield got


def held_texts(column):
    """Lists of consecutive texts, normalised, of about ``TEXT_CHARS`` characters."""
    held, size = [], 0
    for t in column:
        held.append(normalised(t.as_py() or ""))
        size += len(held[-1])
        if size >= TEXT_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, passages, edits, start, end`` for each benchmark item that a document holds a passage of.

    ``passages`` counts the item's passages found, ``edits`` is the least edit distance, and ``start`` and ``end`` bound
    the regions in the normalised text. Every whole text is compared with every item: items go out in blocks of bounded
    size, with one pass over the documents for each block. Null texts hold nothing; a null id stays null; documents
    that repeat come out as often. An empty benchmark gives no row. No shuffle.
    """
    spark = documents.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, passages long, edits long, start long, end long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index.of(items))

        def run(batches, index=index):
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                a = 0
                for held in held_texts(texts):
                    by: dict[tuple[int, int], list[int]] = {}
                    for text, passage, edits, start, end in search(index.value, held):
                        for item in index.value.held[passage]:
                            one = by.setdefault((text, item), [0, edits, start, end])
                            one[:] = [one[0] + 1, min(one[1], edits), min(one[2], start), max(one[3], end)]
                    if by:
                        yield pa.RecordBatch.from_pylist([{"doc_id": ids[a + t], "item_id": i, "passages": v[0], "edits": v[1], "start": v[2], "end": v[3]} for (t, i), v in by.items()], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passages", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
                    a += len(held)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns, whatever these are called."""
    spark = documents.sparkSession
    ship(spark)
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index.of(items))

        def run(batches, index=index):
            for batch in batches:
                keep, a = np.ones(batch.num_rows, bool), 0
                for held in held_texts(batch.column("text")):
                    keep[[a + f[0] for f in search(index.value, held)]] = False
                    a += len(held)
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
