"""Language identification with bit-sliced Bloom filters over n-grams.

A table has one row of bits a slot, one bit a language, in as many words as the languages need. An n-gram is looked up in the slots of its hashes; the AND of
these rows has a bit for every language that contains the n-gram (and, at a known rate, for some that do not). A text's
counts of set bits by language, less the expected false ones, decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, written
from kestrelqc.llm.words import chunks

#: Bound on the labelled documents of a language that are learned from (in expectation, by hash).
SAMPLE = 3000
#: Slots are as many as ``ROOM`` times the n-grams of the language that has most, a power of two within the bounds.
ROOM, LEAST_BITS, MOST_BITS, HASHES = 16, 16, 24, 2
SIZES = (3, 4)
#: A language contains an n-gram met so often at least, and at this share at least of its rate in any language.
MIN_COUNT, MIN_SHARE = 3, 0.05

has_letter = re.compile(r"[^\W\d_]").search
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 256)


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  # by slot and word: a bit for each language
    false_rate: np.ndarray  # by language


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (as numbers) of lower-case texts, and the number of the text of each. None has a gap inside."""
    data = np.frombuffer(b"\n" + b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
    d = _FOLD[data].astype(np.uint64)
    letter = d != 0x20
    out, of = [], []
    for n in SIZES:
        count = max(0, len(d) - n + 1)
        ok = np.ones(count, bool)
        for k in range(1, n - 1):
            ok &= letter[k : k + count]
        at = np.flatnonzero(ok)
        v = np.full(len(at), n, np.uint64)
        for k in range(n):
            v = v << np.uint64(8) | d[at + k]
        out.append(v)
        of.append(np.searchsorted(ends, at + 1, "right") - 1)  # the first byte may be the gap before the text
    return np.concatenate(out), np.concatenate(of)


def slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each n-gram in a table of ``2 ** bits``."""
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [(h >> np.uint64(64 - bits * (k + 1)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


def fit(documents: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from documents with text and language whose crc32 modulo 3 is not 1, a bounded sample of each language.

    Any number of languages is learned. The sample is written once; n-grams are counted, chosen and put into the table by
    tasks, and the driver gets the table alone. A document without an id is not learned from.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False)))
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Filters([], np.zeros((1 << LEAST_BITS, 1), np.uint64), np.zeros(0))
    # A share of the 64 bits of a hash, so that no language is too common to be sampled.
    last = lambda n: min((1 << 63) - 1, ((sample << 64) // n if n > sample else 1 << 64) - (1 << 63))
    cut = spark.createDataFrame([(r["lang"], last(r["count"])) for r in sizes], "lang string, last long")
    rows = written(rows.join(F.broadcast(cut), "lang").where(F.xxhash64("doc_id") <= F.col("last")).select("lang", "text"), "sample")

    def count(batches):
        for batch in batches:
            lang, at = np.array(batch.column("lang").to_pylist(), object), 0
            for texts in chunks(batch.column("text")):
                g, of = grams([t.decode().lower().encode() for t in texts])
                own = lang[at : at + len(texts)]
                at += len(texts)
                for x in set(own.tolist()):
                    v, n = np.unique(g[(own == x)[of]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(v), pa.string()), pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    found = rows.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    total = found.groupBy("lang").agg(F.sum("n").alias("total"))
    found = found.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    found = found.withColumn("top", F.max("rate").over(Window.partitionBy("g"))).where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= MIN_SHARE * F.col("top")))
    found = written(found.select("lang", "g"), "grams")
    most = found.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * most - 1).bit_length()))
    number = spark.createDataFrame([(x, i // 64, 1 << i % 64 if i % 64 < 63 else -(1 << 63)) for i, x in enumerate(languages)], "lang string, word int, bit long")

    def put(batches):
        for batch in batches:
            g, take = batch.column("g").to_numpy().astype(np.uint64), pa.array(np.tile(np.arange(batch.num_rows), HASHES))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots(g, bits)).astype(np.int32)), batch.column("word").take(take), batch.column("bit").take(take)], names=["slot", "word", "bit"])

    table = np.zeros((1 << bits, -(-len(languages) // 64)), np.uint64)
    filled = found.join(F.broadcast(number), "lang").select("g", "word", "bit").mapInArrow(put, "slot int, word int, bit long")
    got = filled.groupBy("slot", "word").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most the table
    table[got["slot"].to_numpy(), got["word"].to_numpy()] = got["bit"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([np.mean(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    return Filters(languages, table, fill**HASHES)


def predict(filters: Filters, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    plain = [t.decode() for t in texts]
    found = np.array([has_letter(t) is not None for t in plain], bool)
    n_lang = len(filters.languages)
    if not n_lang:
        return ["und"] * len(texts), np.zeros(len(texts))
    g, of = grams([t.lower().encode() for t in plain])
    mask = None
    for s in slots(g, len(filters.rows).bit_length() - 1):
        mask = filters.rows[s] if mask is None else mask & filters.rows[s]
    n = np.bincount(of, minlength=len(texts))
    hits = np.stack([np.bincount(of, mask[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), len(texts)) for i in range(n_lang)], axis=1)
    true = np.maximum(hits - n[:, None] * filters.false_rate, 0) / (1 - filters.false_rate)
    best = true.argmax(axis=1)
    score = np.clip(true[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
    return [filters.languages[b] if f else "und" for b, f in zip(best, found)], np.where(found, score, 0.0)


def identified(documents: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. The
    score is the share of the text's n-grams that the language contains. Ties go to the first language by name. Rows
    are judged one by one, repeated or not; a null id stays null. No shuffle.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(filters)  # 32 MB a 64 languages at most

    def run(batches):
        for batch in batches:
            lang, score = [], [np.zeros(0)]
            for texts in chunks(batch.column("text")):
                a, b = predict(sent.value, texts)
                lang += a
                score.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
