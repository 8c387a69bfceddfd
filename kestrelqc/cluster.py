"""What operators need of the cluster: a folder all executors share, tables written there, this package on executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets one of its own, and any other an error.

    On a cluster a folder of the driver's machine would be another one on each executor, and what they write there is lost.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kestrelqc-")
        atexit.register(shutil.rmtree, folder, True)
        found = "file://" + folder
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables and folders made here that are not removed yet.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kestrelqc-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, since: int = 0) -> None:
    """Remove what :func:`new_path` has named, from the ``since``-th on."""
    jvm = spark.sparkContext._jvm
    for path in _MADE[since:]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _MADE[since:]


def made() -> int:
    """How many tables and folders have been named so far and not removed."""
    return len(_MADE)


def settled(df: DataFrame, since: int, name: str = "table") -> DataFrame:
    """``df`` written as by :func:`written`, after which what was made from the ``since``-th on, and only served it, is removed."""
    out = written(df, name)
    path = _MADE.pop()
    removed(df.sparkSession, since)
    _MADE.append(path)
    return out


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Remove the intermediate tables that are made inside, and set the size of Arrow batches back, at the end.

    Results are lazy and read these tables: write or collect them inside. Paths that a caller names are never removed.
    """
    since, size = len(_MADE), spark.conf.get(_BATCH)
    try:
        yield
    finally:
        removed(spark, since)
        spark.conf.set(_BATCH, size)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python task gets at once: of whole texts, a few MB.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors (once for each application), and keep Arrow batches small.

    A batch takes memory several times: off-heap in the JVM on its way there and back, and in the Python worker. So where
    the session does not say how many rows a batch has, it is told ``BATCH_ROWS``; see :func:`scope`.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kestrelqc-zip-")
    path = os.path.join(folder, "kestrelqc.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("kestrelqc", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)  # served from here for as long as the application runs
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


def sized(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow table (ids and the like) for the right side of a join: sent to all tasks if counting finds at most ``most`` rows, else shuffled."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
