"""Neighbours in space: a range join on grid cells.

Stations are rows ``slice_id, station_idx, lat, lon, elev, value``; a slice is one moment, and only stations of one slice
meet. ``station_idx`` numbers them; where order matters it is theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrelqc.cluster import ship, sized, written
from kestrelqc.flags import free_name
from kestrelqc.functions.geo import linear_km, squared_chord, squared_km, xyz

#: A cell this wide (km) holds the whole sphere's neighbours; a larger radius needs no grid.
WIDEST = 2 * 6371.0
#: Stations of a cell above which it is dealt to several tasks.
DENSE = 20_000
#: Cells of all slices up to which their list is sent to all tasks.
FEW_CELLS = 100_000
#: Centres of one place that are a row: the pairs of a row with a cell's stations are held at once.
BUNCH = 8


def located(stations: DataFrame) -> DataFrame:
    """Stations with ``x, y, z`` in km."""
    return stations.withColumns(xyz(F.col("lat"), F.col("lon")))


def sides(stations: DataFrame, others: DataFrame, radius: float | Column, mode: str, largest: float | None, own: list[Column], theirs: list[Column], dense: int = DENSE, stands_for: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Centres ``x, y, z, r2`` with ``own`` columns, and stations ``nx, ny, nz, j`` with ``theirs``, both by ``cell`` and ``block``.

    A row of ``others`` is one station, or as many as the column ``stands_for`` of ``theirs`` says.

    All that are within the radius of each other, and in one slice, meet in one cell and block, once. Cells that no station
    is in are left out, a crowded one is dealt to blocks. Nothing is sent to all tasks but the cells, if these are few.
    """
    own_radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    bound = linear_km(largest if isinstance(radius, Column) else radius, mode)
    place = xyz(F.col("lat"), F.col("lon"))
    there = place["x"].isNotNull() & ~F.isnan(place["x"]) & ~F.isnan(place["y"]) & ~F.isnan(place["z"])
    width = max(bound, 1e-3)
    slice_id = F.struct(F.col("slice_id").alias("id")).alias("slice")  # a null in it equals a null
    centre = stations.where(there).select(slice_id, *(place[k].alias(k) for k in "xyz"), squared_km(own_radius, mode).alias("r2"), *own)
    other = others.where(there).select(slice_id, *(place[k].alias(f"n{k}") for k in "xyz"), *theirs)
    keys = ["slice"]
    if width < WIDEST:
        near = [F.array(*(F.floor(F.col(k) / width) + d for d in (-1, 0, 1))) for k in "xyz"]
        for k, cells in zip("xyz", near, strict=True):
            centre = centre.withColumn(f"c{k}", F.explode(cells))
        other = other.withColumns({f"c{k}": F.floor(F.col(f"n{k}") / width) for k in "xyz"})
        keys += ["cx", "cy", "cz"]
    blocks = other.groupBy(*keys).agg(F.ceil((F.count("*") if stands_for is None else F.sum(stands_for)) / dense).alias("blocks"))
    cells = sized(written(blocks.withColumn("cell", F.monotonically_increasing_id()), "cells"), FEW_CELLS)
    other = other.join(cells, keys).withColumn("block", F.pmod(F.xxhash64("nx", "ny", "nz", "j"), F.col("blocks"))).drop(*keys, "blocks")
    centre = centre.join(cells, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop(*keys, "blocks")
    return centre, other


def crowds(stations: DataFrame, dense: int) -> DataFrame | None:
    """``place, parts``: the places of over ``dense`` stations of a slice, if there are any."""
    found = stations.groupBy(F.struct("slice_id", "lat", "lon").alias("place")).agg(F.ceil(F.count("*") / dense).alias("parts"))
    found = written(found.where("parts > 1"), "crowds")
    return None if found.isEmpty() else sized(found)


def bunched(stations: DataFrame, crowded: DataFrame | None, ident: str, row: Column, radius: Column | None = None) -> DataFrame:
    """``slice_id, lat, lon, part, bunch``, and ``r`` if there is a ``radius``: stations of a slice that share place and radius.

    ``bunch`` is an array of a ``row`` for each. A crowded place has several parts, so that no task holds all of it.
    """
    place, part = [F.col("slice_id"), F.col("lat"), F.col("lon")], F.lit(0).cast("long")
    points = stations.select(*place, *([] if radius is None else [radius.alias("r")]), row.alias("row"), F.xxhash64(F.col(ident)).alias("hash"))
    if crowded is not None:
        points = points.withColumn("place", F.struct(*place)).join(crowded, "place", "left")
        part = F.pmod(F.col("hash"), F.coalesce("parts", F.lit(1)))
    keys = ["slice_id", "lat", "lon", *([] if radius is None else ["r"]), "part"]
    return points.withColumn("part", part).groupBy(*keys).agg(F.collect_list("row").alias("bunch"))


def neighbours(stations: DataFrame, radius: float | Column, include_match: bool = False, mode: str = "squared_km", largest: float | None = None, carry: tuple[str, ...] = (), ident: str = "station_idx", dense: int = DENSE, own: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """Pairs ``slice_id, station_idx, neighbour_idx, distance`` (a chord in km) within the radius, inclusive.

    Without ``include_match`` pairs at exactly equal coordinates are left out, the station itself among them.
    ``radius`` is a number, or a column of the stations with ``largest`` as its bound. ``carry`` names columns of the
    neighbour that come along as ``n_<name>``, whatever they are called, ``own`` those of the station itself, as ``own_<name>``.
    ``ident`` names the column that tells stations apart. Neighbours are sought in ``others`` if given.
    Null or NaN coordinates, or a null radius, have no neighbours. A null ``slice_id`` is a slice. Rows that repeat are
    stations each, so their pairs repeat. Other columns do not matter.

    Each centre is sent to the 27 cells around it and meets the stations of a cell by equality, so a large slice is
    spread over its cells; a cell is as wide as the radius. A cell of over ``dense`` stations is dealt to several tasks:
    its stations once, the centres around it to each. Stations of one place meet others as one row, and pairs are told
    apart after that. Pairs are made where they meet: none is sorted, moved or kept, and no table of stations is sent to
    all tasks, however small it is taken to be.
    """
    member = F.struct(F.col(ident).alias("id"), *(F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(own)))
    other = F.struct(F.col(ident).alias("id"), *(F.col(f"`{c}`").alias(f"w{k}") for k, c in enumerate(carry)))
    varies = isinstance(radius, Column)
    crowded = crowds(stations, dense)
    here = bunched(stations, crowded, ident, member, radius if varies else None).withColumn("start", F.explode(F.sequence(F.lit(1), F.size("bunch"), F.lit(BUNCH))))
    here = here.withColumn("bunch", F.slice("bunch", F.col("start"), F.lit(BUNCH)))
    there = bunched(stations, crowded, ident, other) if others is None else bunched(others, crowds(others, dense), ident, other)
    bare = lambda more: F.col("bunch" if more else "bunch.id")  # noqa: E731  numbers alone are faster than rows of one
    mine = [F.col("slice_id").alias("s"), bare(own).alias("is")]
    theirs = [F.col("part").alias("j"), bare(carry).alias("js")]
    centre, other = sides(here, there, F.col("r") if varies else radius, mode, largest, mine, theirs, dense, F.size("js"))
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centre, other = (df.repartition(tasks, "cell", "block") for df in (centre, other))
    apart = squared_chord({k: F.col(k) for k in "xyz"}, {k: F.col(f"n{k}") for k in "xyz"})
    places = centre.join(other.hint("shuffle_hash"), ["cell", "block"]).withColumn("d2", apart).where(F.col("d2") <= F.col("r2"))
    if not include_match:
        places = places.where("x <> nx or y <> ny or z <> nz")
    pairs = places.select("s", "js", F.sqrt("d2").alias("d"), F.explode("is").alias("i")).select("s", "d", "i", F.explode("js").alias("j"))
    named = [F.col(f"j.w{k}").alias(f"n_{c}") for k, c in enumerate(carry)] + [F.col(f"i.m{k}").alias(f"own_{c}") for k, c in enumerate(own)]
    return pairs.select(F.col("s").alias("slice_id"), F.col("i.id" if own else "i").alias("station_idx"), F.col("j.id" if carry else "j").alias("neighbour_idx"), F.col("d").alias("distance"), *named)


#: Pairs that a kernel looks at at once: its matrices stay in a processor's cache.
AT_ONCE = 1 << 17


def meetings(stations: DataFrame, radius: float | Column, kernel: Callable, result: str, include_match: bool = False, mode: str = "squared_km", largest: float | None = None, own: dict[str, Column] | None = None, theirs: dict[str, Column] | None = None, both: dict[str, tuple[str, Column | None, Column | None]] | None = None, others: DataFrame | None = None, dense: int = DENSE) -> DataFrame:
    """What ``kernel`` makes of the pairs of :func:`neighbours`, where a row for each pair would be too many.

    The stations of a cell and block are held by one task, and centres go past them in batches. ``kernel(c, o, d2, near)``
    gets the columns ``both`` (name: type double or long, of the centre, of the other) as arrays, square distances and
    which pairs count. It returns numbers of centres, of others or None, and columns that the schema ``result`` names.
    Rows have ``own`` of the centre, ``theirs`` of the other if it gave numbers of others, and those columns; a station has as many as
    there are cells and blocks around it, so sums are to be added up.
    """
    own, theirs, both = own or {}, theirs or {}, both or {}
    lit = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    mine = [F.struct(*(c.alias(k) for k, c in own.items())).alias("own"), *(lit(c, kind).alias(f"v_{k}") for k, (kind, c, _) in both.items())]
    other = [F.xxhash64(F.col("station_idx"), *theirs.values(), *(c for _, _, c in both.values() if c is not None)).alias("j"), F.struct(*(c.alias(k) for k, c in theirs.items())).alias("with"), *(lit(c, kind).alias(f"v_{k}") for k, (kind, _, c) in both.items())]
    centre, other = sides(stations, stations if others is None else others, radius, mode, largest, mine, other, dense)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    values = [f"v_{k}" for k in both]
    first = other.select("cell", "block", F.lit(False).alias("asks"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), F.lit(0.0).alias("r2"), none(centre, "own"), "with", *values)
    rows = first.unionByName(centre.select("cell", "block", F.lit(True).alias("asks"), "x", "y", "z", "r2", "own", none(other, "with"), *values))
    spark = stations.sparkSession
    ship(spark)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "block").sortWithinPartitions("cell", "block", "asks")
    added = StructType.fromDDL(result)
    found = StructType([*centre.schema["own"].dataType.fields, *other.schema["with"].dataType.fields, *added.fields])
    return dealt.mapInArrow(partial(_meet, kernel, include_match, list(own), list(theirs), list(both), added.names), found)


def _plain(column: pa.Array) -> np.ndarray:
    return (pc.fill_null(column, float("nan")) if pa.types.is_floating(column.type) and column.null_count else column).to_numpy(zero_copy_only=False)


def _meet(kernel, include_match, own, theirs, both, names, batches):
    at, held, o, p = None, [], None, None
    for batch in batches:
        cell, block, asks = (np.asarray(_plain(batch.column(k))) for k in ("cell", "block", "asks"))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if at != (cell[a], block[a]):
                at, held, o = (cell[a], block[a]), [], None
            if not asks[a]:
                held.append(part)
                continue
            if o is None:
                there = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else part.slice(0, 0)
                o, p, held = {k: _plain(there.column(f"v_{k}")) for k in both}, [_plain(there.column(k)) for k in "xyz"], [there]
            if not len(p[0]):
                continue
            c, q, r2 = {k: _plain(part.column(f"v_{k}")) for k in both}, [_plain(part.column(k)) for k in "xyz"], _plain(part.column("r2"))
            step, out = max(1, AT_ONCE // len(p[0])), []
            for i in range(0, len(r2), step):
                d2 = None
                for u, v in zip(q, p, strict=True):
                    t = u[i : i + step, None] - v
                    t *= t
                    d2 = t if d2 is None else np.add(d2, t, out=d2)
                near = d2 <= r2[i : i + step, None]
                if not include_match and not d2.all():
                    m, n = np.nonzero(d2 == 0)
                    same = np.logical_and.reduce([u[i + m] == v[n] for u, v in zip(q, p, strict=True)])
                    near[m[same], n[same]] = False
                mine, other, more = kernel({k: v[i : i + step] for k, v in c.items()}, o, d2, near)
                out.append((mine + i, other, more))
            mine = pa.array(np.concatenate([m for m, _, _ in out]))
            columns = part.column("own").take(mine).flatten() if own else []
            if theirs:
                columns += held[0].column("with").take(pa.array(np.concatenate([n for _, n, _ in out]))).flatten()
            columns += [pa.array(np.concatenate([more[k] for _, _, more in out])) for k in names]
            yield pa.RecordBatch.from_arrays(columns, [*own, *theirs, *names])


def _count(c, o, d2, near):
    n = np.count_nonzero(near, axis=1)
    rows = np.flatnonzero(n)
    return rows, None, {"n": n[rows]}


def counted(stations: DataFrame, radius: float | Column, include_match: bool = False, mode: str = "squared_km", largest: float | None = None, dense: int = DENSE) -> DataFrame:
    """``slice_id, station_idx, n``: how many pairs of :func:`neighbours` a station has, of those that have any."""
    own = {c: F.col(c) for c in ("slice_id", "station_idx")}
    parts = meetings(stations, radius, _count, "n long", include_match, mode, largest, own, dense=dense)
    return parts.groupBy("slice_id", "station_idx").agg(F.sum("n").alias("n"))


def at_index(stations: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = ("lat", "lon", "elev")) -> DataFrame:
    """``wanted`` (with ``slice_id, station_idx``, or ``station_idx`` alone) with the coordinates of these stations.

    An index that no station has gives no row; a null matches a null slice only.
    """
    keys = [c for c in ("slice_id", "station_idx") if c in wanted.columns]
    right = stations.select(*(F.col(c).alias(f"_{c}") for c in keys), F.struct(*columns).alias("_at"))
    same = [wanted[c].eqNullSafe(right[f"_{c}"]) if c == "slice_id" else wanted[c] == right[f"_{c}"] for c in keys]
    return wanted.join(right, same).select(*(wanted[c] for c in wanted.columns), *(F.col(f"_at.{c}").alias(free_name(c, wanted.columns)) for c in columns))


def nearest(pairs: DataFrame, most: int, digits: int | None = None) -> DataFrame:
    """The ``most`` nearest neighbours of each station, with their ``rank``; equal distances by number.

    ``digits`` rounds distances before they are ranked.
    """
    distance = F.round("distance", digits) if digits is not None else F.col("distance")
    rank = F.row_number().over(Window.partitionBy("slice_id", "station_idx").orderBy(distance, "neighbour_idx"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def _nearest(most, slack, c, o, d2, near):
    d = np.where(near, np.sqrt(d2), np.inf)
    if d.shape[1] > most:
        near = near & (d <= np.partition(d, most - 1, axis=1)[:, most - 1, None] + slack)
    i, j = np.nonzero(near)
    order = np.lexsort((o["idx"][j], d[i, j], i))
    i, j = i[order], j[order]
    away, place = d[i, j], np.arange(len(i))
    first = np.append(True, (i[1:] != i[:-1]) | (away[1:] != away[:-1]))[: len(i)]
    few = place - np.maximum.accumulate(np.where(first, place, 0)) < most  # of equal distances no more than could be wanted
    return i[few], j[few], {"distance": away[few]}


def nearest_neighbours(stations: DataFrame, radius: float | Column, most: int, digits: int | None = None, mode: str = "squared_km", largest: float | None = None, dense: int = DENSE) -> DataFrame:
    """:func:`nearest` of the pairs of :func:`neighbours`, where all pairs would be too many to sort.

    The nearest of each cell and block are found where they meet, with all that ``digits`` might round to the same distance.
    """
    own = {c: F.col(c) for c in ("slice_id", "station_idx")}
    idx = F.coalesce(F.col("station_idx").cast("long"), F.lit(-(2**63)))
    slack = 0.0 if digits is None else 1.01 * 10.0**-digits
    found = meetings(stations, radius, partial(_nearest, most, slack), "distance double", False, mode, largest, own, {"neighbour_idx": F.col("station_idx")}, {"idx": ("long", None, idx)}, dense=dense)
    return nearest(found, most, digits)


def unflagged(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """Pairs whose neighbour's ``flag`` (in ``slice_id, station_idx, flag``) is Pass. A null slice matches a null slice."""
    good = flags.where("flag = 'Pass'").select(F.col("slice_id").alias("_slice"), F.col("station_idx").alias("_idx"))
    return pairs.join(good, F.col("slice_id").eqNullSafe(F.col("_slice")) & (F.col("neighbour_idx") == F.col("_idx")), "left_semi")


def unflagged_neighbours(stations: DataFrame, flags: DataFrame, radius: float | Column, **more) -> DataFrame:
    """:func:`unflagged` pairs of :func:`neighbours`: only stations that pass are sought, so no other pair is made."""
    good = flags.where("flag = 'Pass'").select(F.col("slice_id").alias("_slice"), F.col("station_idx").alias("_idx")).hint("merge")
    passed = stations.join(good, F.col("slice_id").eqNullSafe(F.col("_slice")) & (F.col("station_idx") == F.col("_idx")), "left_semi")
    return neighbours(stations, radius, others=passed, **more)


def gather(pairs: DataFrame, stations: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with columns of the neighbour, under free names. A null slice matches a null slice; repeated stations give a row each."""
    other = stations.select(F.col("slice_id").alias("_slice"), F.col("station_idx").alias("_idx"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_with"))
    found = pairs.join(other.hint("merge"), F.col("slice_id").eqNullSafe(F.col("_slice")) & (F.col("neighbour_idx") == F.col("_idx")))
    return found.select(*pairs.columns, *(F.col(f"_with.`{c}`").alias(free_name(c, pairs.columns)) for c in columns))
