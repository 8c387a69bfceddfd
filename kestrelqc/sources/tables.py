"""Observations from Parquet tables: the shapes that checks take, read or derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelqc.operators.series import densify

SERIES_SQL = """
    slots AS (
        SELECT n.series_id, s.ts FROM (SELECT DISTINCT event_type AS series_id FROM events) n,
            (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS b FROM events)) s),
    hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, max(value)::FLOAT AS value FROM events GROUP BY ALL),
    series AS (SELECT slots.series_id, slots.ts, hourly.value FROM slots LEFT JOIN hourly USING (series_id, ts))"""

STATIONS_SQL = """
    stations AS (
        SELECT c_nationkey AS slice_id, c_custkey AS station_idx, 60 + ((c_custkey * 37) % 97) * 0.01::DOUBLE AS lat,
            10 + ((c_custkey * 53) % 89) * 0.02::DOUBLE AS lon, (c_custkey % 53) * 10.0::DOUBLE AS elev, c_acctbal / 1000 AS value
        FROM customer),
    located AS (
        SELECT *, cos(radians(lat)) * cos(radians(lon)) * 6371 AS x, cos(radians(lat)) * sin(radians(lon)) * 6371 AS y,
            sin(radians(lat)) * 6371 AS z FROM stations)"""


def read_series(spark: SparkSession, path: str, series: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """``series_id, ts, value`` (float) of a Parquet table."""
    return spark.read.parquet(path).select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("float").alias("value"))


def read_stations(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """``slice_id, station_idx, lat, lon, elev, value`` of a Parquet table, from columns named in ``names`` where they differ."""
    names = names or {}
    return spark.read.parquet(path).select(*(F.col(names.get(c, c)).alias(c) for c in ("slice_id", "station_idx", "lat", "lon", "elev", "value")))


def write_flags(flags: DataFrame, path: str, partition: str | None = None) -> None:
    """Write flagged rows as Parquet, with a folder for each value of ``partition`` if given."""
    writer = flags.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of the largest value of each type of event, from the first hour that has one to the last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    return densify(events, first, last, "1 hour")


def customer_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station for each customer, a slice for each nation."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_nationkey").alias("slice_id"), k.alias("station_idx"), (F.lit(60) + ((k * 37) % 97) * F.lit(0.01)).alias("lat"),
        (F.lit(10) + ((k * 53) % 89) * F.lit(0.02)).alias("lon"), ((k % 53) * F.lit(10.0)).alias("elev"), (F.col("c_acctbal") / 1000).alias("value"),
    )


def triplets(stations: DataFrame) -> DataFrame:
    """Stations in complete groups of three consecutive numbers."""
    rows = stations.withColumn("slice_id", F.floor(F.col("station_idx") / 3))
    full = rows.groupBy("slice_id").agg(F.count("*").alias("n")).where("n = 3").select("slice_id")
    return rows.join(full, "slice_id", "left_semi").select(*stations.columns)
