"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelqc.llm import chat, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.quality import fit, judge

    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.packing import read_packed, write_packed

    return read_packed(write_packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.toxicity import fit, scored

    documents = table(spark, sf_dir, "documents")
    out = scored(documents, fit(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.langid import fit, identified

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identified(documents, fit(documents)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.chat import log_of, read_back, write_formatted

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(write_formatted(log_of(rows)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrelqc.llm.warc import read_records, written_records

    rows = read_records(written_records(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_packed_tokens": op6_packed_tokens,
    "op7_simhash": op7_simhash,
    "op9_toxicity": op9_toxicity,
    "op8_chat_format": op8_chat_format,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {"op2_sharding": sharding.sql(), "op8_chat_format": chat.SQL, "op10_warc": warc.sql()}
