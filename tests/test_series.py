import datetime as dt
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kestrelqc.flags import InvalidArg, InvalidInputShape
from kestrelqc.operators.series import densify, dip_check, split_check, step_check

T0 = dt.datetime(2024, 1, 1)
NAN, INF = math.nan, math.inf


def frame(spark, *values, series="a"):
    rows = [(series, T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, value float")


def flags(df):
    return [r["flag"] for r in df.orderBy("ts").collect()]


def test_step_orders_of_severity(spark):
    df = frame(spark, 0.0, 1.0, 4.0, 14.0, None, 3.0)
    assert flags(step_check(df, 2, 5)) == ["Pass", "Warn", "Warn", "DataMissing", "DataMissing"]
    assert flags(step_check(df, 2, 5, severity="documented")) == ["Pass", "Warn", "Fail", "DataMissing", "DataMissing"]
    assert flags(step_check(frame(spark, 0.0, 5.0), 10, 2)) == ["Fail"]


def test_step_context(spark):
    df = frame(spark, *[float(i) for i in range(6)])
    assert len(flags(step_check(df, 2, 5, leading=3, trailing=2))) == 3
    assert len(flags(step_check(df, 2, 5, leading=3, trailing=2, trim_trailing=True))) == 1
    with pytest.raises(InvalidInputShape):
        step_check(df, 2, 5, leading=0)
    with pytest.raises(InvalidArg):
        step_check(df, 2, 5, severity="other")
    with pytest.raises(PySparkException, match="data"):
        step_check(df, 2, 5, leading=6).collect()


@pytest.mark.parametrize(
    ("values", "flag"),
    [((0, 1, 0), "Pass"), ((0, 3, 0), "Warn"), ((0, 6, 0), "Fail"), ((0, -6, 0), "Fail"), ((0, 10, 9), "Pass"), ((0, 10, 20), "Pass"), ((0, 10, 10), "Pass"), ((None, 1, 0), "DataMissing"), ((0, None, 0), "DataMissing"), ((0, 1, None), "DataMissing"), ((0, NAN, 0), "Pass"), ((0, INF, 0), "Pass")],
)
def test_dip(spark, values, flag):
    assert flags(dip_check(frame(spark, *[v if v is None else float(v) for v in values]), 4, 10)) == [flag]


def test_dip_shapes(spark):
    df = frame(spark, 0.0, 1.0, 0.0)
    for context in ((0, 1), (1, 0)):
        with pytest.raises(InvalidInputShape):
            dip_check(df, 4, 10, *context)
    with pytest.raises(PySparkException, match="data"):
        dip_check(df, 4, 10, 2, 1).collect()


def test_odd_numbers_in_steps(spark):
    assert flags(step_check(frame(spark, 0.0, NAN, 1.0, INF, INF, 0.0), 2, 5)) == ["Pass", "Pass", "Warn", "Pass", "Warn"]


def test_split_is_the_same(spark):
    values = [None if i % 11 == 0 else float((i * 37) % 50) for i in range(200)]
    df = frame(spark, *values).unionByName(frame(spark, *values[::-1], series="b"))
    key = lambda d: sorted(map(tuple, d.select("series_id", "ts", "flag").collect()))
    assert key(split_check(df, "dip", 20, 60, 3600, 86400)) == key(dip_check(df, 20, 60))
    assert key(split_check(df, "step", 20, 60, 3600, 7200)) == key(step_check(df, 20, 60))


def test_densify_and_empty(spark):
    df = frame(spark, 1.0, None, 3.0)
    out = densify(df, "2024-01-01 00:00:00", "2024-01-01 04:00:00", "1 hour").orderBy("ts").collect()
    assert [r["value"] for r in out] == [1.0, None, 3.0, None, None]
    assert dip_check(df.limit(0), 4, 10).count() == 0
    odd = spark.createDataFrame([(None, T0, 5.0), (None, T0, 7.0), ("b", None, 1.0)], df.schema)
    slots = densify(odd, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "1 hour").collect()
    assert sorted(((r["series_id"], r["value"]) for r in slots), key=str) == [("b", None), ("b", None), (None, 7.0), (None, None)]


def test_densify_by_the_calendar(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 3, 1), 3.0)], "series_id string, ts timestamp, value float")
    out = densify(df, "2024-01-01 00:00:00", "2024-04-01 00:00:00", "1 month").orderBy("ts").collect()
    assert [(r["ts"].month, r["value"]) for r in out] == [(1, None), (2, None), (3, 3.0), (4, None)]


def test_stream_as_batch(spark, tmp_path):
    from kestrelqc.streaming.series import check_stream

    values = [None if i % 7 == 0 else float((i * 29) % 40) for i in range(30)]
    df = frame(spark, *values).repartition(1).sortWithinPartitions("ts")
    for i, part in enumerate((values[:12], values[12:])):
        rows = [("a", T0 + dt.timedelta(hours=(12 * i) + k), v) for k, v in enumerate(part)]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = check_stream(stream, (10, 20), (15, 30)).writeStream.format("memory").queryName("flags").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["check"], r["ts"]): r["flag"] for r in spark.table("flags").collect()}
    for name, batch in (("step", step_check(df, 10, 20)), ("dip", dip_check(df, 15, 30))):
        assert {t: f for (c, t), f in got.items() if c == name} == {r["ts"]: r["flag"] for r in batch.collect()}


def test_context_of_each_series(spark):
    df = frame(spark, *map(float, range(12))).unionByName(frame(spark, *map(float, range(12)), series="bb"))
    own = F.length("series_id")
    for piece in (3 * 3600, 10**9):
        got = Counter(r["series_id"] for r in dip_check(df, 4, 10, leading=own, trailing=own + 1, piece=piece).collect())
        assert got == {"a": 12 - 3, "bb": 12 - 5}
    with pytest.raises(PySparkException, match="data"):
        step_check(df, 2, 5, leading=own - 1).collect()


def test_pieces_of_irregular_times(spark):
    rng = np.random.default_rng(3)
    rows = [(s, T0 + dt.timedelta(seconds=int(t)), None if rng.random() < 0.1 else float(rng.integers(0, 30))) for s in "ab" for t in np.unique(rng.integers(0, 10**6, 150))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value float").repartition(4)
    key = lambda d: sorted(map(str, d.collect()))
    for piece in (1, 1000, 40_000):
        assert key(dip_check(df, 8, 20, 2, 3, piece=piece)) == key(dip_check(df, 8, 20, 2, 3, piece=10**9))
        assert key(step_check(df, 8, 20, 2, piece=piece)) == key(step_check(df, 8, 20, 2, piece=10**9))


def test_odd_series(spark):
    rows = [(None, T0, 1.0), (None, T0 + dt.timedelta(hours=1), 9.0), ("a", None, 1.0), ("a", T0, 1.0), ("a", T0, 1.0), ("a", T0 + dt.timedelta(days=90), None)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value float").withColumns({"flag": F.lit("own"), "n": F.lit(0), "i": F.lit(0), "v": F.lit("v")})
    out = step_check(df, 2, 50)
    assert out.columns == [*df.columns, "flag_"]
    assert Counter((r["series_id"], r["flag_"], r["flag"]) for r in out.collect()) == {(None, "Warn", "own"): 1, ("a", "Pass", "own"): 2, ("a", "DataMissing", "own"): 1}
    numbers = spark.createDataFrame([("a", k, float(k * k)) for k in range(9)], "series_id string, ts long, value float")
    assert [r["flag"] for r in step_check(numbers, 5, 100, piece=2).orderBy("ts").collect()] == ["Pass"] * 3 + ["Warn"] * 5


def test_sources(spark, tmp_path):
    from kestrelqc.sources.tables import read_series, read_stations, write_flags

    spark.createDataFrame([("s", T0, 1.5, 60.0)], "name string, t timestamp, v double, lat double").write.parquet(f"{tmp_path}/in")
    assert tuple(read_series(spark, f"{tmp_path}/in", "name", "t", "v").first()) == ("s", T0, 1.5)
    names = {"slice_id": "t", "station_idx": "name", "lon": "lat", "elev": "v", "value": "v"}
    assert tuple(read_stations(spark, f"{tmp_path}/in", names).first()) == (T0, "s", 60.0, 60.0, 1.5, 1.5)
    for partition in (None, "flag"):
        write_flags(spark.createDataFrame([(1, "Pass"), (2, None)], "k int, flag string"), f"{tmp_path}/out", partition)
        assert sorted((r["k"], r["flag"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "Pass"), (2, None)]


def test_stream_of_late_equal_and_null_times(spark, tmp_path):
    from kestrelqc.streaming.series import check_stream

    at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    for i, part in enumerate(([(0, 0.0), (1, 30.0), (1, 99.0), (None, 5.0)], [(0, 7.0), (1, 8.0), (2, 0.0), (None, 1.0)])):
        spark.createDataFrame([("a", at(h), v) for h, v in part], "series_id string, ts timestamp, value float").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("series_id string, ts timestamp, value float").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = check_stream(stream, (10, 20), (15, 30)).writeStream.format("memory").queryName("odd").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r["check"], r["ts"]): r["flag"] for r in spark.table("odd").collect()}
    assert got == {("step", at(1)): "Warn", ("step", at(2)): "Warn", ("dip", at(1)): "Fail"}


def test_shared_folder(spark):
    from kestrelqc import cluster

    class Cluster:  # a session on a cluster without a shared folder
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

            class _jsc:
                sc = staticmethod(lambda: Cluster.jsc)

        class jsc:
            class getCheckpointDir:
                isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        cluster.shared_dir(Cluster)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    since = cluster.made()
    kept = cluster.settled(cluster.written(spark.range(5)).where("id > 1"), since)
    assert kept.count() == 3 and cluster.made() == since + 1
    with cluster.scope(spark):
        inside = cluster.written(spark.range(3)).inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(inside)
        cluster.ship(spark)
    assert not os.path.exists(inside) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size
