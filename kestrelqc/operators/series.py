"""Checks of time series: each value against its neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelqc.flags import DATA_MISSING, FAIL, PASS, WARN, InvalidArg, InvalidInputShape, free_name
from kestrelqc.functions.values import number

SEVERITIES = ("observed", "documented")


def densify(df: DataFrame, start, end, step: str, series: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """One row for each series and slot from ``start`` to ``end`` (both inclusive), ``step`` apart (an interval in SQL).

    A slot without a row has a null value. Of rows in one slot the largest value counts. Rows off the grid, or without a
    time, are not taken. A null series is a series. An empty table gives no slot.
    """
    names = df.select(series).distinct()
    slots = names.select(series, F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step}"))).alias(ts))
    got = df.groupBy(F.col(series).alias("_s"), F.col(ts).cast("timestamp").alias("_t")).agg(F.max(value).cast("float").alias("_v"))
    return slots.join(got, F.col(series).eqNullSafe(F.col("_s")) & (F.col(ts) == F.col("_t")), "left").select(series, ts, F.col("_v").alias(value))


#: Seconds that a piece of a series spans: no task holds a longer stretch of one series.
PIECE = 30 * 86400


def _whole(name: str, n: int | Column, least: int) -> Column:
    """A count of context rows; one that is too small is an error, at once or on the row that has it."""
    if isinstance(n, int):
        if n < least:
            raise InvalidInputShape("data")
        return F.lit(n)
    wrong = F.raise_error(str(InvalidInputShape("data"))).cast("int")
    return F.when(n >= least, n.cast("int")).otherwise(wrong)


def _judged(df: DataFrame, flag, series: str, ts: str, value: str, leading: Column, trailing: Column, needed: Column, piece: int) -> DataFrame:
    """``df`` with the flag of previous, own and next value, without the context rows; too short a series is an error.

    Series are cut by time into pieces, each a window of its own. What a piece needs of the others (the value before it,
    the one after it, rows so far and in all) comes from one row a piece.
    """
    t = F.col(ts)
    seconds = t.cast("long") if dict(df.dtypes)[ts] in ("int", "bigint", "smallint") else F.unix_timestamp(t.cast("timestamp"))
    rows = df.select(
        F.struct(F.col(series).alias("s"), F.coalesce(F.floor(seconds / piece), F.lit(-(1 << 62))).alias("k")).alias("key"), t.alias("t"), F.col(value).cast("float").alias("v"),
        leading.alias("leading"), trailing.alias("trailing"), needed.alias("needed"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
    )
    ends = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("t", "v"))["v"].alias("first"), F.max(F.struct("t", "v"))["v"].alias("last"))
    order = Window.partitionBy("key.s").orderBy("key.k")
    ends = ends.select(
        "key", "n", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"), F.sum("n").over(Window.partitionBy("key.s")).alias("all"),
    )
    here = Window.partitionBy("key").orderBy("t")
    rows = rows.join(ends, "key").withColumn("i", F.row_number().over(here))
    p, x = F.when(F.col("i") == 1, F.col("before")).otherwise(F.lag("v").over(here)), F.when(F.col("i") == F.col("n"), F.col("after")).otherwise(F.lead("v").over(here))
    rows = rows.withColumns({"p": p, "x": x, "at": F.col("so_far") + F.col("i"), "short": F.col("all") < F.col("needed")})
    short = F.raise_error(str(InvalidInputShape("data"))).cast("string")
    rows = rows.withColumn("flag", F.when(F.col("short"), short).otherwise(flag(F.col("p"), F.col("v"), F.col("x"))))
    rows = rows.where(F.col("short") | ((F.col("at") > F.col("leading")) & (F.col("at") <= F.col("all") - F.col("trailing"))))
    return rows.select("row.*", F.col("flag").alias(free_name("flag", df.columns)))


def step_flag(p: Column, v: Column, high: float, max: float, severity: str = "observed") -> Column:
    """Flag of a value by its step from the one before."""
    size = number(F.abs(p - v))
    tests = [(size > F.lit(high).cast("float"), WARN), (size > F.lit(max).cast("float"), FAIL)]
    out = F.when(p.isNull() | v.isNull(), DATA_MISSING)
    for test, flag in tests if severity == "observed" else reversed(tests):
        out = out.when(test, flag)
    return out.otherwise(PASS)


def dip_flag(p: Column, v: Column, x: Column, high: float, max: float) -> Column:
    """Flag of a value that stands out from both neighbours by much the same."""
    p_, v_, x_ = number(p), number(v), number(x)
    before, after = F.abs(v_ - p_), F.abs(x_ - v_)
    total, uneven = number(after + before), number(F.abs(after - before))
    extreme = ((v_ > p_) & (v_ > x_)) | ((v_ < p_) & (v_ < x_))
    dip = extreme & (uneven < total * F.lit(0.35).cast("float"))
    return F.when(p.isNull() | v.isNull() | x.isNull(), DATA_MISSING).when(dip & (total > F.lit(max).cast("float")), FAIL).when(dip & (total > F.lit(high).cast("float")), WARN).otherwise(PASS)


def step_check(df: DataFrame, high: float, max: float, leading: int | Column = 1, trailing: int | Column = 0, severity: str = "observed", trim_trailing: bool = False, series: str = "series_id", ts: str = "ts", value: str = "value", piece: int = PIECE) -> DataFrame:
    """``df`` with a ``flag``, without each series' first ``leading`` rows, which are context.

    Null now or before: DataMissing. A step over ``high``: Warn; else over ``max``: Fail. So Fail needs ``max`` below
    ``high``; ``severity="documented"`` tests ``max`` first. NaN passes. Trailing context is judged too unless
    ``trim_trailing``. A series of ``leading`` rows or fewer, or no leading context, is an :class:`InvalidInputShape`.
    ``leading`` and ``trailing`` are numbers, or columns that have one value in a series.

    Series are windowed in pieces of ``piece`` seconds (whole numbers count as seconds), so one may be of any length.
    Arithmetic is in single precision. A null series is a series; null times come first; of equal times any is first. Columns
    keep their names: if the table has a column ``flag``, the result's is ``flag_``. An empty table gives no row.
    """
    if severity not in SEVERITIES:
        raise InvalidArg("severity", f"must be one of {', '.join(SEVERITIES)}")
    before, after = _whole("leading", leading, 1), _whole("trailing", trailing, 0)
    return _judged(df, lambda p, v, x: step_flag(p, v, high, max, severity), series, ts, value, before, after if trim_trailing else F.lit(0), before + 1, piece)


def dip_check(df: DataFrame, high: float, max: float, leading: int | Column = 1, trailing: int | Column = 1, series: str = "series_id", ts: str = "ts", value: str = "value", piece: int = PIECE) -> DataFrame:
    """``df`` with a ``flag``, without each series' first ``leading`` and last ``trailing`` rows, which are context.

    Null now, before or after: DataMissing. A strict extreme whose two steps differ by less than 35 % of their sum: Fail if the
    sum is over ``max``, else Warn if over ``high``. Else Pass, also for NaN and infinite neighbours. Context of less
    than one row on a side, or a series without a row to judge, is an :class:`InvalidInputShape`. Pieces, context by series
    and odd tables are as in :func:`step_check`.
    """
    before, after = _whole("leading", leading, 1), _whole("trailing", trailing, 1)
    return _judged(df, lambda p, v, x: dip_flag(p, v, x, high, max), series, ts, value, before, after, before + after + 1, piece)


def split_check(df: DataFrame, kind: str, high: float, max: float, period: int, split: int, severity: str = "observed", series: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """:func:`step_check` or :func:`dip_check` (``kind`` is ``step`` or ``dip``; one row of context) in pieces of ``split`` seconds, a multiple of ``period``."""
    if split < period or split % period:
        raise InvalidArg("split", "must be a multiple of period")
    if kind not in ("step", "dip"):
        raise InvalidArg("kind", "must be step or dip")
    if kind == "step":
        return step_check(df, high, max, severity=severity, series=series, ts=ts, value=value, piece=split)
    return dip_check(df, high, max, series=series, ts=ts, value=value, piece=split)
