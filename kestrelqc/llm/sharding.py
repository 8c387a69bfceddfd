"""Sharding by extendible hashing, with DataFrame functions alone.

A row's hash has 24 bits of its key's MD5 and 24 bits of the row's own number, so that even rows of one key can be told
apart. A directory is indexed by hash prefixes: it starts as one bucket, and only buckets over the byte limit are
split, on their next bit. The sums of all prefixes at all depths come from one roll-up of the distinct hashes; a bucket is
a prefix that fits while its parent does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import sized, written

KEY_BITS, ROW_BITS = 24, 24
DEPTH = KEY_BITS + ROW_BITS
SHARD_BYTES = 16 << 20


def hashed(documents: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """``key, h, n_bytes`` (and ``more`` columns): 48 bits of hash and the text's bytes in UTF-8 (null: none). A null key hashes as an empty one."""
    key_hash = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    row_hash = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return documents.select(F.col(key).alias("key"), (F.shiftleft(key_hash, ROW_BITS) + row_hash).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *more)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``depth, prefix, shard_bytes, shard_rows`` of the buckets of ``rows`` (``h, n_bytes``).

    Row hashes matter only in buckets that the key's bits leave too large, so prefixes of the key's bits are rolled up for
    all rows, and longer ones only for those. One row over the limit is a bucket by itself.
    """
    over = (F.col("b") > limit) & (F.col("n") > 1)

    def rolled(sums: DataFrame, depths: range) -> DataFrame:
        """Sums of every prefix; ``sums`` has one row for each prefix of the last depth."""
        last = depths[-1]
        return sums.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("p", last - d).alias("prefix")) for d in depths])).alias("x"), "b", "n").groupBy("x.depth", "x.prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))

    by_key = rows.groupBy(F.shiftright("h", ROW_BITS).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    sums = rolled(by_key, range(KEY_BITS + 1))
    hot = written(by_key.where(over).select("p"), "hot")
    if not hot.isEmpty():
        by_row = rows.withColumn("k", F.shiftright("h", ROW_BITS)).join(sized(hot.withColumnRenamed("p", "k")), "k", "left_semi").groupBy(F.col("h").alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        sums = sums.unionByName(rolled(by_row, range(KEY_BITS + 1, DEPTH + 1)))
    sums = written(sums, "prefixes")
    parents = sums.where(over & (F.col("depth") < DEPTH)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    fits = sums.where(~over | (F.col("depth") == DEPTH))
    root = fits.where("depth = 0")
    split = fits.join(sized(parents), ["depth", "prefix"], "left_semi")
    return written(root.unionByName(split).select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows")), "directory")


def sharded(documents: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, shard, depth, shard_bytes, shard_rows`` for every row: ``shard`` is the bucket's prefix in binary.

    Every shard's texts take ``limit`` bytes at most, unless it is one row. Shards are named by the bits they share
    (``*`` if none), so no name is a beginning of another. Repeated rows may go to different shards once their key's 24
    bits are used up. An empty table has no shard.

    No text is shuffled. A row meets the directory at the depths that it has, which are few; it is sent to all tasks if
    it is counted small.
    """
    rows = written(hashed(documents, key, text), "hashes")
    buckets = directory(rows, limit)
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # 49 at most
    if not depths:
        depths = [0]
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", DEPTH - d).alias("prefix")) for d in sorted(depths)])).alias("x")
    met = rows.select("key", "n_bytes", at).select("key", "n_bytes", "x.depth", "x.prefix").join(sized(buckets), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return met.select("key", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def write_shards(documents: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the rows to ``path/shard=<bits>`` as Parquet, one file a shard; returns all shards and their sizes.

    A table that has a column ``shard`` keeps it: the folders then have the name ``shard_`` (and so on). An empty table
    gives no shard.

    The rows are written once with their 48 bits of hash, so that the directory and the files see the same row hashes;
    rows of one key that are over the limit are split by these until they fit.
    """
    h = hashed(documents.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text", "row")
    rows = written(h, "hashes")
    buckets = directory(rows.select("h", "n_bytes"), limit)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # 49 at most
    shard = F.lit(None).cast("string")
    for d in depths:
        part = buckets.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{d}"), (F.lit("*") if d == 0 else F.expr(f"lpad(bin(prefix), {d}, '0')")).alias(f"s{d}"))
        rows = rows.withColumn(f"p{d}", F.shiftright("h", DEPTH - d)).join(sized(part), f"p{d}", "left")
        shard = F.coalesce(shard, F.col(f"s{d}"))
    name, taken = "shard", {c.lower() for c in documents.columns}
    while name in taken:
        name += "_"
    rows.select("row.*", shard.alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return buckets.select("shard_bytes", "shard_rows", "depth", "prefix")


def sql(limit: int = SHARD_BYTES) -> str:
    """The same rows in DuckDB (where the key's 24 bits are enough)."""
    sums = "\n        UNION ALL ".join(f"SELECT {d} AS depth, h >> {KEY_BITS - d} AS prefix, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM rows_ GROUP BY ALL" for d in range(KEY_BITS + 1))
    return f"""
    WITH rows_ AS (
        SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {KEY_BITS // 4}))::BIGINT AS h
        FROM documents),
    sums AS (
        {sums}),
    buckets AS (
        SELECT c.depth, c.prefix, c.b, c.n FROM sums c
        WHERE NOT (c.b > {limit} AND c.n > 1)
          AND (c.depth = 0 OR EXISTS (SELECT 1 FROM sums p WHERE p.depth = c.depth - 1 AND p.prefix = c.prefix >> 1 AND p.b > {limit} AND p.n > 1)))
    SELECT r.doc_id, r.n_bytes, CASE WHEN b.depth = 0 THEN '*' ELSE lpad(bin(b.prefix), b.depth, '0') END AS shard,
           b.depth::INTEGER AS depth, b.b AS shard_bytes, b.n AS shard_rows
    FROM rows_ r JOIN buckets b ON b.prefix = r.h >> ({KEY_BITS} - b.depth)"""
