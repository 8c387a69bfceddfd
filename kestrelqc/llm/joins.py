"""A join in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import sized, written

#: Classes that are sent to all tasks at most, and rows of a key above which they meet their class where they are.
FEW, HOT_ROWS = 100_000, 1 << 14


def attached(rows: DataFrame, classes: DataFrame, key: str = "fp") -> DataFrame:
    """``rows`` with the other columns of their class in ``classes`` (``key``, ``n`` rows of it, others), null without one.

    Where classes are counted few they all go to all tasks. Else those of over ``HOT_ROWS`` rows do, which are fewer, and
    rows with a null key meet nothing, so neither gathers in one task; the rest is shuffled by key.
    """
    names, kinds = [c for c in classes.columns if c not in (key, "n")], dict(classes.dtypes)
    right = sized(classes, FEW)
    if right is not classes:
        return rows.join(right.drop("n"), key, "left").select(*rows.columns, *names)
    hot = written(classes.where(F.col("n") > HOT_ROWS), "hot")
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in names))
    some = rows.where(F.col(key).isNotNull())
    rare = some.join(sized(hot.select(key)), key, "left_anti").join(classes.where(F.col("n") <= HOT_ROWS).drop("n"), key, "left")
    return rare.unionByName(some.join(sized(hot.drop("n")), key)).select(*rows.columns, *names).unionByName(none)
