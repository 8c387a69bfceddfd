"""Spatial consistency test: optimal interpolation in boxes of neighbours.

Stations are judged in order, and what one box decides the next one sees. No box crosses a gap of the outer radius, so a slice
falls apart into groups of stations that are judged in parallel: those whose cells, as wide as that radius, are joined
by a path of adjacent cells. One rule is the whole slice's: sweeps end after one that fails no station. So groups are judged
through all sweeps, keep their flags after each, and the slice's sums say which sweep was the last.
The linear algebra of a box is numpy's; a box has at most ``num_max`` stations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelqc.cluster import ship, written
from kestrelqc.flags import DATA_MISSING, FAIL, INCONCLUSIVE, INVALID, ISOLATED, PASS, InvalidArg
from kestrelqc.functions.geo import RADIUS_KM, linear_km, xyz
from kestrelqc.functions.stats import DEFAULT_SLOPE
from kestrelqc.operators.buddy import numbered, with_results
from kestrelqc.operators.graph import components


def validated(num_min: int, num_max: int, num_iterations: int, min_elev_diff: float, min_horizontal_scale: float, vertical_scale: float, inner_radius: float, outer_radius: float) -> None:
    """Raise :class:`InvalidArg` for the first parameter that is out of range."""
    rules = [
        ("num_min", num_min < 2, "a box needs two stations at least"),
        ("num_max", num_max < num_min, "a box may not have fewer stations at most than it needs at least"),
        ("num_iterations", num_iterations < 1, "at least one sweep is needed"),
        ("min_elev_diff", min_elev_diff <= 0, "heights must differ by more than nothing"),
        ("min_horizontal_scale", min_horizontal_scale <= 0, "a scale is positive"),
        ("vertical_scale", vertical_scale <= 0, "a scale is positive"),
        ("inner_radius", inner_radius < 0, "a radius is not negative"),
        ("outer_radius", outer_radius < inner_radius, "the outer circle holds the inner one"),
    ]
    for name, wrong, reason in rules:
        if wrong:
            raise InvalidArg(name, reason)


def vertical_profile(elevs: np.ndarray, values: np.ndarray, num_min: int, min_elev_diff: float) -> np.ndarray:
    """Background value at each elevation: see :func:`kestrelqc.functions.stats.profile_lines`."""
    if elevs.min() == elevs.max():
        return np.full(len(values), values.mean())
    low, high = np.quantile(elevs, [0.05, 0.95])
    slope = DEFAULT_SLOPE
    if len(values) >= num_min and high - low >= min_elev_diff:
        i, j = np.triu_indices(len(values), 1)
        dz, dv = elevs[i] - elevs[j], values[i] - values[j]
        slope = np.median(np.divide(dv, dz, out=np.zeros(len(dz)), where=np.abs(dz) >= 1))
    return np.median(values - slope * elevs) + slope * elevs


def great_circles(unit: np.ndarray) -> np.ndarray:
    """Distances in km between all pairs of unit vectors, 0 between equal ones."""
    d = np.arccos(np.clip(unit @ unit.T, 0, 1)) * RADIUS_KM
    d[(unit[:, None, :] == unit[None, :, :]).all(axis=2)] = 0
    return d


def horizontal_scale(away: np.ndarray, least: float) -> float:
    """Decorrelation length of a box in km: the mean over stations of the 10 % quantile of the distances to the others, ``least`` at least."""
    n = len(away)
    others = away[~np.eye(n, dtype=bool)].reshape(n, n - 1)
    return max(least, np.quantile(others, 0.1, axis=1).mean())


def correlations(away: np.ndarray, elevs: np.ndarray, scale: float, vertical_scale: float) -> np.ndarray:
    """Background correlation of each pair of a box by its distance and its difference in height."""
    return np.exp(-0.5 * (away / scale) ** 2 - 0.5 * ((elevs[:, None] - elevs[None, :]) / vertical_scale) ** 2)


def residuals(unit, elevs, values, eps2, num_min_prof, min_elev_diff, min_horizontal_scale, vertical_scale):
    """Cross-validation residual and probability of gross error of each station of a box; None if singular."""
    away = great_circles(unit)
    corr = correlations(away, elevs, horizontal_scale(away, min_horizontal_scale), vertical_scale)
    d = values - vertical_profile(elevs, values, num_min_prof, min_elev_diff)
    try:
        inverse = np.linalg.inv(corr + np.diag(eps2))
    except np.linalg.LinAlgError:
        return None
    w = inverse @ d
    analysis, left_out = corr @ w - d, -w / np.diag(inverse)
    return left_out, left_out * analysis / max(0.01, float(np.mean(-d * analysis)))


def units(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors of the stations."""
    lat, lon = np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lon"].to_numpy(float))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


class Slice:
    """The stations of one group, in order, with a grid for searches."""

    def __init__(self, pdf: pd.DataFrame, outer_km: float):
        self.unit = units(pdf)
        self.around: dict[tuple, np.ndarray] = {}
        self.xyz = self.unit * RADIUS_KM
        self.outer, self.width = outer_km, max(outer_km, 1e-3)
        self.cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(self._cell(self.xyz)):
            if c is not None:
                self.cells.setdefault(c, []).append(i)

    def _cell(self, points: np.ndarray) -> list[tuple | None]:
        return [tuple(np.floor(p / self.width).astype(int)) if np.isfinite(p).all() else None for p in points]

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Stations within the outer radius of station ``i``, itself among them, and their distances."""
        if not np.isfinite(self.xyz[i]).all():
            return np.zeros(0, int), np.zeros(0)
        a, b, c = self._cell(self.xyz[i : i + 1])[0]
        at = self.around.get((a, b, c))
        if at is None:
            at = np.array(sorted(k for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) for k in self.cells.get((a + x, b + y, c + z), ())), int)
            self.around[a, b, c] = at
        d = np.sqrt(((self.xyz[at] - self.xyz[i]) ** 2).sum(axis=1))
        return at[d <= self.outer], d[d <= self.outer]


def judge_group(pdf: pd.DataFrame, num_min, num_max, inner, outer_km, num_iterations, num_min_prof, min_elev_diff, min_horizontal_scale, vertical_scale) -> pd.DataFrame:
    """Flags and probabilities of one group after each sweep, and how many stations each sweep has failed.

    ``pdf`` is in order, and has ``pos, neg, eps2`` and ``judge`` by station. A sweep that changes nothing ends the lists.
    """
    n, space = len(pdf), Slice(pdf, outer_km)
    elevs, values = pdf["elev"].to_numpy(float), pdf["value"].to_numpy(float)
    pos, neg, eps2 = (pdf[c].to_numpy(float) for c in ("pos", "neg", "eps2"))
    judge, missing = pdf["judge"].to_numpy(bool), pdf["missing"].to_numpy(bool)
    flags = np.full(n, PASS, object)
    flags[~np.isfinite(elevs) | ~np.isfinite(values)] = INVALID
    flags[missing] = DATA_MISSING
    chance = np.zeros(n)
    kept, chances, thrown_by = [], [], []
    for _ in range(num_iterations):
        thrown, checked, before = 0, ~judge | (flags != PASS), flags.copy()
        for i in range(n):
            if checked[i] or flags[i] != PASS:
                continue
            box, far = space.near(i)
            good = flags[box] == PASS
            box, far = box[good], far[good]
            if len(box) > num_max:
                nearest = np.lexsort((box, far))[:num_max]
                box, far = box[nearest], far[nearest]
            if len(box) < num_min:
                flags[i], checked[i] = ISOLATED, True
                continue
            found = residuals(space.unit[box], elevs[box], values[box], eps2[box], num_min_prof, min_elev_diff, min_horizontal_scale, vertical_scale)
            if found is None:
                flags[i], checked[i] = INCONCLUSIVE, True
                continue
            left_out, pog = found
            if not judge[box].all():
                checked[i] = True
            inside = judge[box] & (far <= inner)
            bad = inside & np.where(left_out < 0, pog > pos[box], pog > neg[box])
            chance[box[inside]] = np.maximum(chance[box[inside]], pog[inside])
            flags[box[bad]] = FAIL
            thrown += int(bad.sum())
            checked[box[inside]] = True
        kept.append(flags.astype(str))
        chances.append(chance.copy())
        thrown_by.append(thrown)
        if (flags == before).all():
            break
    first = [thrown_by, *[None] * (n - 1)]
    return pd.DataFrame({"_row": pdf["_row"], "flags": list(np.stack(kept, axis=1)), "chances": list(np.stack(chances, axis=1)), "thrown": first})


def slices(frames, by: str = "slice_id"):
    """Whole groups of frames sorted by ``by``, one by one; only the group that is not complete is held."""
    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = pdf[by]
        same = ((key == key.iloc[-1]) | (key.isna() & pd.isna(key.iloc[-1]))).to_numpy()
        held = pdf[same]
        for _, one in pdf[~same].groupby(by, dropna=False, sort=False):
            yield one
    if held is not None and len(held):
        yield held


def together(rows: DataFrame, outer_km: float) -> DataFrame:
    """``rows`` (``_row, slice, lat, lon``) with ``group``: stations of a slice in adjacent cells, and so on, have the same."""
    place, width = xyz(F.col("lat"), F.col("lon")), max(outer_km, 1e-3)
    cell = {f"c{k}": F.floor(place[k] / width) for k in "xyz"}
    there = F.coalesce(~F.isnan(place["x"]) & ~F.isnan(place["y"]) & ~F.isnan(place["z"]), F.lit(False))
    rows, keys = rows.withColumns(cell | {"there": there}), ["slice", "cx", "cy", "cz"]
    cells = written(rows.where("there").select(*keys).distinct().withColumn("cell", F.monotonically_increasing_id()), "cells")
    half = [(x, y, z) for x in (0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    step = F.explode(F.array(*(F.struct(*(F.lit(d).alias(k) for d, k in zip(way, "xyz", strict=True))) for way in half))).alias("step")
    beside = cells.select(*keys, F.col("cell").alias("a"), step).select("slice", *((F.col(f"c{k}") + F.col(f"step.{k}")).alias(f"c{k}") for k in "xyz"), "a")
    roots = components(beside.join(cells, keys).select("a", F.col("cell").alias("b")))
    cells = cells.join(roots.withColumnRenamed("v", "cell"), "cell", "left").select(*keys, F.coalesce("root", "cell").alias("found"))
    alone = -1 - F.col("_row")  # a station that is nowhere
    return rows.join(cells, keys, "left").withColumn("group", F.when(F.col("there"), F.col("found")).otherwise(alone)).drop(*keys[1:], "there", "found")


def sct(stations: DataFrame, num_min: int, num_max: int, inner_radius: float, outer_radius: float, num_iterations: int, num_min_prof: int, min_elev_diff: float, min_horizontal_scale: float, vertical_scale: float, pos=2.0, neg=2.0, eps2=0.5, mask: str | None = None, mode: str = "squared_km") -> DataFrame:
    """``stations`` with a ``flag`` and ``prob_gross_error``.

    Fewer than ``num_min`` usable stations within the outer radius: Isolated. An elevation or value that is not finite:
    Invalid; a null value: DataMissing; neither is used. A singular box: Inconclusive. ``pos``, ``neg`` and ``eps2`` are
    numbers or columns; stations where ``mask`` is not true are used and not judged. ``outer_radius`` is by default a
    square in km, as for other searches, while ``inner_radius`` is compared with a distance in km; in other modes both have
    the mode's unit. Coordinates off the globe are an :class:`InvalidArg`; a station without any is Isolated.

    Rows that repeat a station are stations each, in any order, and come out once each. A null ``slice_id`` is a slice; a null
    ``station_idx`` comes first. Columns keep their names: where the table has one of the result's, that gets a ``_``.
    An empty table gives no row.
    """
    validated(num_min, num_max, num_iterations, min_elev_diff, min_horizontal_scale, vertical_scale, inner_radius, outer_radius)
    low = {"eps2": "a ratio of variances is positive", "pos": "a number of deviations is not negative", "neg": "a number of deviations is not negative"}
    for name, c in (("eps2", eps2), ("pos", pos), ("neg", neg)):
        if isinstance(c, int | float) and (c <= 0 if name == "eps2" else c < 0):
            raise InvalidArg(name, low[name])
    ship(stations.sparkSession)
    col = lambda c: F.lit(float(c)) if isinstance(c, int | float) else c.cast("double")
    checked = lambda name, c, wrong, reason: F.when(wrong, F.raise_error(str(InvalidArg(name, reason))).cast("double")).otherwise(c)
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    given = numbered(
        stations, lat=checked("latlon", lat, (F.abs(lat) > 90) | (F.abs(lon) > 360), "off the globe"), lon=lon,
        elev=F.col("elev").cast("double"), value=F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))), missing=F.col("value").isNull(),
        pos=checked("pos", col(pos), col(pos) < 0, low["pos"]), neg=checked("neg", col(neg), col(neg) < 0, low["neg"]), eps2=checked("eps2", col(eps2), col(eps2) <= 0, low["eps2"]),
        judge=F.coalesce(F.col(f"`{mask}`"), F.lit(False)) if mask else F.lit(True),
    )
    inner = inner_radius if mode == "squared_km" else linear_km(inner_radius, mode)
    outer = linear_km(outer_radius, mode)
    rows = given.select(F.struct(F.col("_own.slice_id").alias("id")).alias("slice"), F.col("_own.station_idx").alias("station_idx"), *(c for c in given.columns if c != "_own"))
    rows = together(rows, outer)

    def run(frames):
        out, size = [], 0
        for pdf in slices(frames, "group"):
            out.append(judge_group(pdf.reset_index(drop=True), num_min, num_max, inner, outer, num_iterations, num_min_prof, min_elev_diff, min_horizontal_scale, vertical_scale))
            size += len(pdf)
            if size >= 10_000:
                yield pd.concat(out, ignore_index=True)
                out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    # Groups stream through their partition in order: many small ones cost no call each.
    sent = rows.drop("slice").repartition("group").sortWithinPartitions("group", "station_idx", "_row").select("_row", "group", "lat", "lon", "elev", "value", "missing", "pos", "neg", "eps2", "judge")
    judged = written(sent.mapInPandas(run, "_row long, flags array<string>, chances array<double>, thrown array<long>"), "sweeps")
    whose = rows.select("_row", "slice")
    sums = judged.where("thrown is not null").join(whose, "_row").select("slice", F.posexplode("thrown").alias("sweep", "n")).groupBy("slice", "sweep").agg(F.sum("n").alias("n"))
    # A sweep past the end of a group's list fails none in it.
    last = sums.groupBy("slice").agg(F.coalesce(F.min(F.when(F.col("n") == 0, F.col("sweep"))), F.max("sweep") + 1).alias("last"))
    at = F.least(F.col("last"), F.size("flags") - 1) + 1
    results = judged.join(whose.join(last, "slice"), "_row").select("_row", F.element_at("flags", at.cast("int")).alias("flag"), F.element_at("chances", at.cast("int")).alias("prob_gross_error"))
    return with_results(given, results, ["flag", "prob_gross_error"])


def box_statistics(boxes: DataFrame, min_horizontal_scale: float, vertical_scale: float) -> DataFrame:
    """What the test computes of a box: ``slice_id, i, j, h, dz, dh, s`` for each pair of its stations, itself included.

    Each slice of ``boxes`` is one box: great-circle distance and difference in height of the pair, the box's decorrelation
    length, and the pair's correlation. A box of one station has none.
    """
    ship(boxes.sparkSession)
    kinds = dict(boxes.dtypes)

    def run(frames):
        for pdf in slices(frames):
            n, i, elevs = len(pdf), pdf["station_idx"].to_numpy(), pdf["elev"].to_numpy(float)
            if n > 1:
                away = great_circles(units(pdf))
                scale = horizontal_scale(away, min_horizontal_scale)
                s, dz = correlations(away, elevs, scale, vertical_scale), np.abs(elevs[:, None] - elevs[None, :])
                yield pd.DataFrame({"slice_id": np.repeat(pdf["slice_id"].to_numpy()[:1], n * n), "i": np.repeat(i, n), "j": np.tile(i, n), "h": away.ravel(), "dz": dz.ravel(), "dh": scale, "s": s.ravel()})

    rows = boxes.select("slice_id", "station_idx", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "elev")))
    rows = rows.repartition("slice_id").sortWithinPartitions("slice_id", "station_idx")
    return rows.mapInPandas(run, f"slice_id {kinds['slice_id']}, i {kinds['station_idx']}, j {kinds['station_idx']}, h double, dz double, dh double, s double")
