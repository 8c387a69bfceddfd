"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import written


def components(links: DataFrame) -> DataFrame:
    """For every end of a link (columns ``a`` and ``b``, longs): ``v, root``, one root for each component.

    In each round every vertex goes to the least of itself and its neighbours, in an order by hash, and that one to its
    own; links between the new vertices go on. A round at least halves the vertices that still have links, in
    expectation, so there are logarithmically many. Nothing but a row count reaches the driver. Null ends and loops
    are no links; repeated links count once.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        low = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", order("a"))["v"].alias("to"))
        low = written(low, "parents")
        up = low.select(F.col("v").alias("to"), F.col("to").alias("root"))
        step = written(low.join(up, "to").select("v", "root"), "parents")
        if found is None:
            found = step
        else:
            found = written(found.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root")), "roots")
        one, two = step.select(F.col("v").alias("a"), F.col("root").alias("x")), step.select(F.col("v").alias("b"), F.col("root").alias("y"))
        links = written(links.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return found
