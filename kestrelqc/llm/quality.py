"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed to a fixed number of bins. One multinomial over the bins is fitted to the documents that are
trusted, another to the raw corpus; a text's score is the mean over its n-grams of the logarithm of their ratio.
Both multinomials are counted over every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, sized
from kestrelqc.llm.words import SPACE, Words, chunks

ORDER, BINS, SMOOTHING = 4, 1 << 16, 1.0
#: Nats per n-gram; texts below are rejected.
MIN_SCORE = -0.5
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Up to so many trusted ids are sent to every task; past it, documents and ids are shuffled to meet.
BROADCAST_IDS = 1_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_BLANK = b" \t\r\x0b\x0c"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def bins_of(data: np.ndarray) -> np.ndarray:
    """Bin of the n-gram at each byte of ``data`` (fewer than ``ORDER`` bytes: none)."""
    n = max(0, len(data) - ORDER + 1)
    h = np.zeros(n, np.uint32)
    for k in range(ORDER):
        h = h << np.uint32(8) | data[k : k + n]
    return h * np.uint32(2654435761) >> np.uint32(16)


def _per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])


def base_counts(texts: list[bytes], w: Words) -> dict[str, np.ndarray]:
    """The five counts of the rules, by text."""
    space = SPACE[w.data]
    out = {
        "n_words": np.diff(w.first),
        "word_chars": _per_text(_LEAD[w.data] & ~space, w.bounds),
        "n_symbols": _per_text(_SYMBOL[w.data], w.bounds),
    }
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(_BLANK)]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup)
    h, whole = w.ngrams(WINDOW)
    at = np.flatnonzero(whole)
    text = np.searchsorted(w.first, at, "right") - 1
    key = h[at] + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    np.add.at(mark, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(mark[:-1]) > 0, w.first)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose every non-null quality label is 1."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("trusted"))


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Logarithm of trusted over raw probability by bin, from every n-gram of every document.

    Tasks count; a shuffle of at most ``BINS`` rows a task adds up; ``BINS`` rows reach the driver whatever the input.
    Without a trusted document both multinomials are the raw one, and every score is 0.
    """
    spark = documents.sparkSession
    ship(spark)
    ids = sized(trusted_ids(labels), BROADCAST_IDS)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left").select("text", "trusted")

    def run(batches):
        raw, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            trusted, at = batch.column("trusted").to_pylist(), 0
            for texts in chunks(batch.column("text")):
                data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
                size = np.array([len(t) + 1 for t in texts])
                found = bins_of(data)
                inside = np.ones(len(data), bool)
                for k in range(ORDER):  # no n-gram spans two texts
                    last = np.cumsum(size) - 1 - k
                    inside[last[last >= 0]] = False
                inside = inside[: len(found)]
                raw += np.bincount(found[inside], minlength=BINS)
                of_trusted = np.repeat([x is True for x in trusted[at : at + len(texts)]], size)[: len(found)]
                good += np.bincount(found[inside & of_trusted], minlength=BINS)
                at += len(texts)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bin", "raw", "good"])

    counts = rows.mapInArrow(run, "bin int, raw long, good long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        raw[r["bin"]], good[r["bin"]] = r["raw"], r["good"]
    if not good.any():
        good = raw
    p, q = good + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def verdicts(column, table: np.ndarray, min_score: float) -> dict[str, np.ndarray]:
    """Every column of ``RESULT`` for the texts of an Arrow column."""
    parts = []
    for texts in chunks(column):
        w = Words.of(texts)
        c = base_counts(texts, w)
        score = table[bins_of(w.data)]
        total = np.concatenate([[0.0], np.cumsum(score)])
        a, b = w.bounds[:-1], np.maximum(w.bounds[1:] - ORDER, w.bounds[:-1])  # without the newline after the text
        n = b - a
        a, b = np.minimum(a, len(score)), np.minimum(b, len(score))
        c["score"] = np.round(np.where(n > 0, (total[b] - total[a]) / np.maximum(n, 1), 0.0), 9)
        c["base_failed"] = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        c["kept"] = ~c["base_failed"] & (c["score"] >= min_score)
        parts.append(c)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def judge(documents: DataFrame, ratio: np.ndarray, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id`` with counts, score and verdict (``RESULT``) for every document.

    A null text has no words. A text without an n-gram scores 0. ``base_failed``: fewer than 20 words, or over 30 % of
    the words lie in 8-word windows found twice or more. ``kept``: not ``base_failed``, and the score is ``min_score`` or
    more. Rows are judged one by one: repeated rows all come out, null ids stay null. Other columns are not read. Whole
    texts, no shuffle.
    """
    ship(documents.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = verdicts(batch.column("text"), ratio, min_score)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c[x]) for x in names)], names=["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {RESULT}")


def keep(documents: DataFrame, ratio: np.ndarray, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns, whatever these are called."""
    ship(documents.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdicts(batch.column("text"), ratio, min_score)["kept"]))

    return documents.mapInArrow(run, documents.schema)
