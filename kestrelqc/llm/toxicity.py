"""Toxicity of texts in which words may be disguised.

A noisy channel is undone first: where characters stand for letters (``1d10t``), letters are spaced out (``i d i o t``,
``i.d.i.o.t``) or repeated (``idiooot``), a lattice of what may have been meant is decoded by Viterbi under a trigram
model of characters. The restored text is scored by a logistic regression on whole words and word beginnings.

The trigrams are counted over all documents; the rest is fitted on at most ``SAMPLE`` labelled ones, those of least hash.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, written
from kestrelqc.llm.words import Words, chunks

#: Bound on the labelled documents that the model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Word beginnings of so many bytes are features, beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 10, 12)
MIN_DOCS, MIN_LOG_ODDS, FEATURES = 5, 1.5, 3000
#: A feature whose share of toxic documents is surely (three deviations) this high is enough by itself.
ENOUGH = 0.85

#: What a character may stand for. Fixed values.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
_LEET = re.escape("".join(STANDS_FOR))
_LETTER = r"[^\W\d_]"
_NO_LETTER = re.compile(r"\d").match
_ANY = rf"(?:[^\W_]|[{_LEET}])"
#: Three or more single letters or signs, whatever stands between them; three or more parts of up to three, with other signs
#: than spaces between; a word with a sign at any place; a letter three times or more. No form has a greatest length.
SUSPECT = re.compile(
    rf"(?P<spaced>(?<!{_ANY})(?:{_ANY}(?:(?:(?!{_ANY})[\W_])++{_ANY}(?!{_ANY})){{2,}}+|{_ANY}{{1,3}}(?:(?:(?!{_ANY})[^\w\s]){{1,3}}{_ANY}{{1,3}}(?!{_ANY})){{2,}}+))"
    rf"|(?<!{_ANY})(?:(?![{_LEET}])[^\W_])*+[{_LEET}]{_ANY}*+"
    rf"|(?<!\w){_LETTER}*?({_LETTER})\2\2{_LETTER}*"
)
#: Numbers, prices and runs of punctuation stand for themselves.
_PLAIN = re.compile(r"[$€+|!]*\d+[$€+|!]*|[!|+]+|(.)\1*", re.S)
#: Signs that end or part words in plain text, so at a word's ends they are cheaply no letter.
_POINTS = "!|+"

#: Characters that are not seen: soft hyphen, zero-width spaces and joiners, marks of direction. Fixed values.
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_FOREIGN = re.compile(f"[{_UNSEEN}]+|[\uff01-\uff5e\U0001d400-\U0001d7ff\u2460-\u24ff]")
#: Words of one letter, which may stand before a spaced word.
_SINGLE = "ai"


def plain_letters(text: str) -> str:
    """Lower case; full-width, mathematical and circled letters as plain ones; without characters that are not seen."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = _FOREIGN.sub(lambda m: "" if m[0][0] in _UNSEEN else unicodedata.normalize("NFKC", m[0]).lower(), text)
    return text


# Symbols of the character model: 0 between words, then a-z, bytes of other letters.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = np.arange(32, 96)
SYMBOL[0xC2:0xE0] = np.arange(96, 126)
SYMBOL[0xE0:] = 126
_BETWEEN = SYMBOL == 0


@functools.cache
def _classes() -> np.ndarray:
    """Bits by code point: 1 stands in a form (a letter, a digit or a sign), 2 a sign or digit that stands for a letter,
    4 a letter, 8 between words (white space), 16 a character of words, 32 a digit, 64 a sign of plain text."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        alnum = x.isalnum()
        out[c] = (alnum or x in STANDS_FOR) + 2 * (x in STANDS_FOR) + 4 * (alnum and not _NO_LETTER(x)) + 8 * x.isspace() + 16 * (alnum or x == "_") + 32 * x.isdecimal() + 64 * (x in _POINTS)
    return out


def starts(texts: list[str]) -> list[list[int]]:
    """For each text the places where ``SUSPECT`` may match: the pattern is tried there and nowhere else.

    All forms begin where a run of letters, digits and signs does, or a run of characters of words: runs with a sign
    (but for numbers, or points alone), three runs in a row that are short, and runs with a letter three times.
    """
    data = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[data]
    inside = np.concatenate([[0], kind & 1, [0]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [[] for _ in texts]
    length = end - begin
    # Sums by reduceat run on to the next run's begin; what stands between runs has none of these bits.
    signs, digits, points = (np.add.reduceat(kind >> k & 1, begin, dtype=np.int64) for k in (1, 5, 6))
    found = [begin[(signs > 0) & (digits < length) & (points < length)]]
    space = np.concatenate([[0], np.cumsum((kind >> 3) & 1)])
    word = np.concatenate([[0], np.cumsum((kind >> 4) & 1)])
    gap = begin[1:] - end[:-1]
    tight = (gap <= 3) & (space[begin[1:]] == space[end[:-1]]) & (word[begin[1:]] == word[end[:-1]])
    if len(begin) > 2:
        single = length == 1
        found.append(begin[:-2][single[:-2] & single[1:-1] & single[2:]])
        short = length <= 3
        found.append(begin[:-2][short[:-2] & short[1:-1] & short[2:] & tight[:-1] & tight[1:]])
    triple = np.flatnonzero((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (kind[:-2] & 4 > 0)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(triple):
        words = np.concatenate([[0], kind >> 4 & 1])
        first = np.flatnonzero(words[1:] > words[:-1])
        found.append(first[np.searchsorted(first, triple, "right") - 1])
    at = np.unique(np.concatenate(found))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cut = np.searchsorted(at, bounds)
    return [(at[a:b] - base).tolist() for a, b, base in zip(cut[:-1].tolist(), cut[1:].tolist(), bounds[:-1].tolist(), strict=True)]


@dataclass
class Model:
    keys: np.ndarray  # hashes of features, ascending
    weights: np.ndarray
    floors: np.ndarray  # least score of a text with the feature
    bias: float
    trigrams: np.ndarray  # counts -> log probabilities, 128 x 128 x 128

    def __post_init__(self):
        self.memo: dict[str, str] = {}

    def restored(self, texts: list[str]) -> list[tuple[str, list[str]]]:
        """Each text as it is meant, in lower case, and the spaced words found that begin with a letter that is a word, without it."""
        texts, out = [plain_letters(t) for t in texts], []
        for text, places in zip(texts, starts(texts), strict=True):
            parts, more, done = [], [], 0
            for at in places:
                if at < done or (m := SUSPECT.match(text, at)) is None:
                    continue
                known = self._decoded(m)
                parts += [text[done:at], known]
                done = m.end()
                if m["spaced"] is not None and known[:1] in _SINGLE and known != m[0]:
                    more.append(known[1:])
            out.append(("".join([*parts, text[done:]]) if parts else text, more))
        return out

    def restore(self, text: str) -> str:
        return self.restored([text])[0][0]

    def readings(self, texts: list[str]) -> list[str]:
        """Restored texts, each followed by the other readings of its spaced words."""
        return [" ".join([text, *more]) if more else text for text, more in self.restored(texts)]

    def _decoded(self, m: re.Match) -> str:
        found = m[0]
        known = self.memo.get(found)
        if known is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            plain = _PLAIN.fullmatch(found) or m["spaced"] and sum(c not in _POINTS and (c.isalnum() or c in STANDS_FOR) for c in found) < 3
            known = found if plain else self.decode(found, m["spaced"] is not None)
            if len(found) <= 64:
                self.memo[found] = known
        return known

    def decode(self, text: str, spaced: bool = False) -> str:
        """The likeliest meant text of a disguised one."""
        return viterbi(lattice(text, spaced), self.trigrams).decode("utf-8", "replace").strip()

    def score(self, texts: list[str]) -> np.ndarray:
        out, floor = np.full(len(texts), self.bias), np.zeros(len(texts))
        w, hashes, text = features(self.readings(texts))
        if len(self.keys) and len(hashes):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            pair = np.unique(text[hit] * len(self.keys) + at[hit])  # each feature once a text
            np.add.at(out, pair // len(self.keys), self.weights[pair % len(self.keys)])
            np.maximum.at(floor, pair // len(self.keys), self.floors[pair % len(self.keys)])
        return np.maximum(1 / (1 + np.exp(-out)), floor)


def lattice(text: str, spaced: bool = False) -> list[list[tuple[bytes, float]]]:
    """What each part of a disguised text may stand for, with the cost of each way."""
    out: list[list[tuple[bytes, float]]] = []
    # A sign at every other place is a gap as well.
    between = text[1] if len(text) >= 5 and len(text) % 2 and text[1] in STANDS_FOR and not text[1].isdigit() and set(text[1::2]) == {text[1]} else None
    inner = len(text.lstrip(_POINTS)), len(text.rstrip(_POINTS))
    i = 0
    while i < len(text):
        c = text[i]
        if spaced and not (c.isalnum() or c in STANDS_FOR):
            j = i + 1
            while j < len(text) and not (text[j].isalnum() or text[j] in STANDS_FOR):
                j += 1
            out.append([(b"", 0.0), (b" ", -0.5)])  # gaps inside a spaced word, or a border of words
            i = j
            continue
        j = i + 1
        while j < len(text) and text[j] == c:
            j += 1
        letters = [(x, -0.5) for x in STANDS_FOR.get(c, "")] or ([(c, 0.0)] if c.isalpha() else [(" ", -1.0)])
        if c in STANDS_FOR:
            # No letter after all; a run at an end costs as one.
            letters.append((" ", -1.0 / (j - i) if c in _POINTS and (i >= inner[1] or j <= len(text) - inner[0]) else -12.0))
        n = j - i
        ways = [(b"", -1.0), (b" ", -1.5)] if c == between and i % 2 else []
        for x, cost in letters:
            b = x.encode()
            ways.append((b * min(n, 4), cost * n))
            if n >= 3:
                ways += [(b, cost - 1.0), (b * 2, cost - 1.5)]
        out.append(ways)
        i = j
    return out


def viterbi(parts: list[list[tuple[bytes, float]]], trigrams: np.ndarray) -> bytes:
    """The likeliest way through a lattice. The last two symbols are the state, and every state is kept."""
    best: dict[tuple[int, int], tuple[float, bytes]] = {(0, 0): (0.0, b"")}
    for ways in [*parts, [(b" ", 0.0)]]:
        nxt: dict[tuple[int, int], tuple[float, bytes]] = {}
        for (a, b), (score, out) in best.items():
            for add, cost in ways:
                s, x, y = score + cost, a, b
                for byte in add:
                    z = int(SYMBOL[byte])
                    s += float(trigrams[x, y, z]) if y or z else 0.0
                    x, y = y, z
                if (x, y) not in nxt or nxt[x, y][0] < s:
                    nxt[x, y] = (s, out + add)
        best = nxt
    return max(best.values())[1]


def features(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings of lower-case texts, with the number of their text."""
    w = Words.of([t.encode() for t in texts], _BETWEEN)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    hashes, of = [w.hashes ^ np.uint64(0x5851F42D4C957F2D)], [text]
    for n in PREFIXES:
        at = np.flatnonzero(w.ends - w.starts >= n)
        hashes.append(w.spans(w.starts[at], w.starts[at] + n))
        of.append(text[at])
    return w, np.concatenate(hashes), np.concatenate(of)


def trigram_counts(w: Words) -> np.ndarray:
    s = SYMBOL[w.data]
    keep = np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)]) if len(s) else np.zeros(0, bool)
    s = np.concatenate([[0, 0], s[keep]])
    return np.bincount((s[:-2] << 14) + (s[1:-1] << 7) + s[2:], minlength=1 << 21)


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, toxic`` of at most ``sample`` labelled ids of ``documents`` whose crc32 modulo 4 is not 2, those of least hash."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return ids.join(documents.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for 0/1 features in coordinates, by Nesterov's gradient steps."""
    w, b, v, vb = np.zeros(n), -2.0, np.zeros(n), 0.0
    degree = np.maximum(np.bincount(cols, minlength=n), 1)
    width = max(1.0, np.bincount(rows, minlength=len(y)).max() if len(rows) else 1.0)
    step = 4.0 / (width * degree + 4 * ridge)
    for k in range(rounds):
        z = np.bincount(rows, (w + 0.9 * v)[cols], len(y)) + b + 0.9 * vb
        g = 1 / (1 + np.exp(-z)) - y
        v = 0.9 * v - 0.3 * step * (np.bincount(cols, g[rows], n) + ridge * w)
        vb = 0.9 * vb - 0.3 * 4.0 / len(y) * g.sum()
        w, b = w + v, b + vb
    return w, b


def surely(hits: np.ndarray, trials: np.ndarray, z: float = 3.0) -> np.ndarray:
    """Lower end of Wilson's interval for a share."""
    share = hits / np.maximum(trials, 1)
    return (share + z * z / (2 * trials) - z * np.sqrt(share * (1 - share) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the sample, and the trigrams on all documents. Without a label of each kind every text scores the share of toxic labels (0.1 without any).

    One pass over the documents counts trigrams and picks the sample's texts; both are written, the sample with one
    text of each id. Nothing after it reads the documents again.
    """
    ship(documents.sparkSession)
    ids = written(labelled(documents, labels, sample), "labelled")

    def read(batches):
        total = np.zeros(1 << 21, np.int64)
        for batch in batches:
            for texts in chunks(batch.column("text")):
                total += trigram_counts(Words.of([plain_letters(t.decode()).encode() for t in texts], _BETWEEN))
            some = batch.filter(pa.compute.is_valid(batch.column("toxic")))
            if some.num_rows:
                none = pa.nulls(some.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, some.column("doc_id"), some.column("toxic"), some.column("text")], names=["k", "n", "doc_id", "toxic", "text"])
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), none, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.string())], names=["k", "n", "doc_id", "toxic", "text"])

    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left")
    seen = written(every.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(read, "k long, n long, doc_id long, toxic int, text string"), "seen")
    counts = np.zeros(1 << 21)
    for r in seen.where("k is not null").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 2 ** 21
        counts[r["k"]] = r["n"]
    rows = seen.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = written(rows.repartition(16, "doc_id").select("toxic", "text"), "sample")
    counts = counts.reshape(128, 128, 128)
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, np.log(p3).astype(np.float32))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def by_feature(batches):
        for batch in batches:
            toxic, at = np.array(batch.column("toxic").to_pylist()), 0
            for texts in chunks(batch.column("text"), 1 << 20):
                _, h, of = features(sent.value.readings([t.decode() for t in texts]))
                y = toxic[at : at + len(texts)]
                at += len(texts)
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
                h, of = h[new], of[new]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(first):
                    t = np.add.reduceat(y[of].astype(np.int64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(t), pa.array(np.diff(np.append(first, len(h))) - t)], names=["h", "t", "n"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nn = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not nt or not nn:
        share = nt / (nt + nn) if nt + nn else 0.1
        model.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("n") + 0.5) / (nn + 1))
    chosen = rows.mapInArrow(by_feature, "h long, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    chosen = chosen.where(F.col("t") >= MIN_DOCS).where(odds >= MIN_LOG_ODDS).orderBy(F.desc(odds * F.col("t")), "h").limit(FEATURES).collect()
    keys = np.array([r["h"] for r in chosen], np.int64).view(np.uint64)
    model.keys = np.sort(keys)
    t, n = (np.array([r[c] for r in chosen], float)[np.argsort(keys)] for c in "tn")
    low = surely(t, t + n)
    model.floors = np.where(low >= ENOUGH, low, 0.0)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def present(batches):
        for batch in batches:
            toxic, at = batch.column("toxic").to_pylist(), 0
            for texts in chunks(batch.column("text"), 1 << 20):
                m = sent.value
                _, h, of = features(m.readings([t.decode() for t in texts]))
                k = np.minimum(np.searchsorted(m.keys, h), max(0, len(m.keys) - 1))
                hit = m.keys[k] == h if len(m.keys) else np.zeros(len(h), bool)
                found: list[set[int]] = [set() for _ in texts]
                for a, b in zip(of[hit].tolist(), k[hit].tolist(), strict=True):
                    found[a].add(b)
                yield pa.RecordBatch.from_arrays([pa.array([int(y == 1) for y in toxic[at : at + len(texts)]], pa.int32()), pa.array([sorted(x) for x in found], pa.list_(pa.int32()))], names=["y", "x"])
                at += len(texts)

    got = rows.mapInArrow(present, "y int, x array<int>").collect()  # at most SAMPLE rows of feature numbers
    y = np.array([r["y"] for r in got])
    size = np.array([len(r["x"]) for r in got])
    cols = np.array([k for r in got for k in r["x"]], np.int64)
    model.weights, model.bias = _logistic(np.repeat(np.arange(len(y)), size), cols, y, len(model.keys))
    return model


def scores(model: Model, column) -> np.ndarray:
    """Score of each text of an Arrow column."""
    return np.concatenate([np.zeros(0), *(model.score([t.decode() for t in texts]) for texts in chunks(column))])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) and ``predicted`` (1 from 0.3 on) of every whole text.

    A null text scores as an empty one, by the bias alone. Rows are scored one by one, repeated or not; a null id stays
    null; other columns are not read. No shuffle.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = scores(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the threshold, with all their columns, whatever these are called."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(sent.value, batch.column("text")) < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
