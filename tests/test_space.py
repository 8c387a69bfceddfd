import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kestrelqc.flags import InvalidArg
from kestrelqc.functions.geo import great_circle
from kestrelqc.operators.buddy import buddy_check
from kestrelqc.operators.neighbours import gather, nearest, neighbours, unflagged
from kestrelqc.operators.sct import sct

# The coordinates, values and flags of the known cases of test_buddy_vectors and test_sct_vectors, and the
# parameters ARGS of the latter.
LONS = [60, 60.00011111, 60.00022222, 60.00033333, 60.00044444, 60.00055556, 60.00066667, 60.00077778, 60.00088889, 60.001]
SCHEMA = "slice_id int, station_idx int, lat double, lon double, elev double, value double"
NAN = math.nan


def stations(spark, lons, values, lats=60.0, elevs=0.0, slice_id=1):
    n = len(values)
    lats, elevs = (x if isinstance(x, list) else [x] * n for x in (lats, elevs))
    rows = [(slice_id, i, float(a), float(o), float(e), None if v is None else float(v)) for i, (a, o, e, v) in enumerate(zip(lats, lons, elevs, values, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def flags(df):
    return [r["flag"] for r in df.orderBy("slice_id", "station_idx").collect()]


def buddy(df, sweeps=2, num_min=1, threshold=1.0, elev=200.0, min_std=0.01, **more):
    return flags(buddy_check(df, 10000.0, num_min, threshold, elev, -0.0065, min_std, sweeps, **more))


def test_buddy_vectors(spark):
    assert buddy(stations(spark, LONS[:3], [0, 0, 1])) == ["Pass", "Pass", "Fail"]
    df = stations(spark, LONS, [0] * 8 + [0.1, 1])
    assert buddy(df) == ["Pass"] * 8 + ["Fail", "Fail"]
    assert buddy(df, sweeps=1) == ["Pass"] * 9 + ["Fail"]
    # In sequence the second outlier is judged after the first has failed.
    assert buddy(stations(spark, LONS, [0] * 8 + [1, 0.1]), sweeps=1) == ["Pass"] * 8 + ["Fail", "Fail"]


def test_buddy_branches(spark):
    assert buddy(stations(spark, LONS[:4], [0, 0, NAN, math.inf])) == ["Pass", "Pass", "Fail", "Fail"]
    assert buddy(stations(spark, LONS[:3], [0, 0, 9]), num_min=5) == ["Pass"] * 3
    assert buddy(stations(spark, LONS[:3], [0, 0, 9]), sweeps=0) == ["Pass"] * 3
    assert buddy(stations(spark, LONS[:3], [0, 0, 9], elevs=[0.0, 0.0, 900.0])) == ["Pass"] * 3
    assert buddy(stations(spark, LONS[:3], [0, 0, 9], elevs=[0.0, 0.0, 900.0]), elev=-1.0) == ["Pass", "Pass", "Fail"]
    assert buddy(stations(spark, [60, 60], [0, 9])) == ["Pass", "Pass"]  # one place
    masked = stations(spark, LONS[:3], [0, 0, 9]).withColumn("judge", F.col("station_idx") != 2)
    assert buddy(masked, mask="judge")[2] == "Pass"
    assert buddy(stations(spark, LONS[:3], [0, None, 1]))[1] == "DataMissing"
    assert buddy(stations(spark, LONS[:1], [0]).limit(0)) == []


def sequential(rows, radius_km, num_min, threshold, max_elev, gradient, min_std, sweeps):
    """The check as its definition says, station after station."""
    la, lo = np.radians([r[2] for r in rows]), np.radians([r[3] for r in rows])
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1) * 6371
    e, v = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    ok = np.isfinite(v)
    for _ in range(sweeps):
        before = ok.copy()
        for i in range(len(rows)):
            near = (np.sqrt(((p - p[i]) ** 2).sum(1)) <= radius_km) & (p != p[i]).any(1) & ok & (np.abs(e[i] - e) <= max_elev)
            if ok[i] and near.sum() >= num_min:
                b = v[near] + (e[i] - e[near]) * gradient
                var = (b * b).mean() - b.mean() ** 2
                sigma = max(math.sqrt(max(var * (1 + 1 / len(b)), 0)), min_std)
                ok[i] = not abs(v[i] - b.mean()) > threshold * sigma
        if (ok == before).all():
            break
    return ["Pass" if x else "Fail" for x in ok]


def test_buddy_random_against_sequence(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, 60 + rng.random() * 0.5, 10 + rng.random(), float(rng.integers(0, 400)), float(rng.normal() + 8 * (rng.random() < 0.1))) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = flags(buddy_check(df, 400.0, 5, 1.8, 200.0, -0.0065, 0.01, 4))
    assert got == sequential(rows, 20.0, 5, 1.8, 200.0, -0.0065, 0.01, 4)


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180)), 0.0, 0.0) for i in range(200)] + [(0, 200, NAN, 0.0, 0.0, 0.0), (0, 201, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for radius in (1000.0**2, 9000.0**2, 1e9):
        got = {(r["station_idx"], r["neighbour_idx"]) for r in neighbours(df, radius).collect()}
        expect = set()
        xyz = lambda r: np.array([math.cos(math.radians(r[2])) * math.cos(math.radians(r[3])), math.cos(math.radians(r[2])) * math.sin(math.radians(r[3])), math.sin(math.radians(r[2]))]) * 6371
        p = [xyz(r) for r in rows[:200]]
        for i in range(200):
            expect |= {(i, j) for j in range(200) if i != j and i % 2 == j % 2 and ((p[i] - p[j]) ** 2).sum() <= radius}
        assert got == expect
    one = nearest(neighbours(df, 9000.0**2), 3).where("station_idx = 0").orderBy("rank").collect()
    assert len(one) == 3 and one[0]["distance"] <= one[1]["distance"] <= one[2]["distance"]


def test_great_circle_rules(spark):
    d = lambda *a: spark.range(1).select(great_circle(*[F.lit(float(x)) for x in a])).first()[0]
    assert d(10, 20, 10, 20) == 0
    assert abs(d(0, 0, 0, 90) - 6371 * math.pi / 2) < 1e-6
    assert abs(d(0, 0, 0, 180) - 6371 * math.pi / 2) < 1e-6  # no more than a quarter
    with pytest.raises(PySparkException, match="latlon"):
        d(91, 0, 0, 0)


ARGS = dict(num_min=3, num_max=10, inner_radius=10000.0, outer_radius=10000.0, num_iterations=1, num_min_prof=0, min_elev_diff=100.0, min_horizontal_scale=10000.0, vertical_scale=200.0, pos=2.0, neg=2.0, eps2=0.5)


def test_sct_vectors(spark):
    df = stations(spark, [10, 10.01, 10.02], [0, 1, 100])
    out = sct(df, **ARGS).orderBy("station_idx").collect()
    assert [r["flag"] for r in out] == ["Pass", "Pass", "Fail"]
    assert np.allclose([r["prob_gross_error"] for r in out], [0.721, 0.679, 2.800], atol=2e-3)
    assert flags(sct(df, **ARGS | {"neg": 9.0, "pos": 9.0})) == ["Pass"] * 3
    assert flags(sct(df, **ARGS | {"num_min": 4})) == ["Isolated"] * 3
    bad = sct(stations(spark, [10, 10.01, 10.02, 10.03], [0, 1, 2, None], elevs=[NAN, 0.0, 0.0, 0.0]), **ARGS)
    assert flags(bad) == ["Invalid", "Isolated", "Isolated", "DataMissing"]


def test_sct_many_alike(spark):
    rng, n = np.random.default_rng(20), 10_000
    args = ARGS | dict(num_min=5, num_max=100, inner_radius=50000.0, outer_radius=150000.0, num_iterations=5, num_min_prof=20, min_elev_diff=200.0, pos=4.0, neg=8.0)
    df = stations(spark, list(rng.uniform(0, 1, n)), [1] * n, lats=list(rng.uniform(0, 1, n)), elevs=1.0).withColumn("judge", F.lit(True))
    assert set(flags(sct(df, mask="judge", **args))) == {"Pass"}


def plain_sct(rows, num_min, num_max, inner_radius, outer_radius, num_iterations, num_min_prof, min_elev_diff, min_horizontal_scale, vertical_scale, pos, neg, eps2):
    """The test of one slice as its definition says: rows (lat, lon, elev, value, judge) one after the other."""
    n = len(rows)
    quantile = lambda q, x: float(np.quantile(np.sort(x), q))
    xyz = [np.array([math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))]) for a, o, *_ in rows]
    flag = ["DataMissing" if r[3] is None else "Pass" if math.isfinite(r[2]) and math.isfinite(r[3]) else "Invalid" for r in rows]
    for _ in range(num_iterations):
        thrown, checked = 0, [False] * n
        for i in range(n):
            if not rows[i][4] or flag[i] != "Pass" or checked[i]:
                continue
            near = sorted((math.dist(xyz[i] * 6371, xyz[j] * 6371), j) for j in range(n))
            near = [(d, j) for d, j in near if d <= math.sqrt(outer_radius) and flag[j] == "Pass"][:num_max]
            if len(near) < num_min:
                flag[i] = "Isolated"
                continue
            box = [j for _, j in near]
            z, v = np.array([rows[j][2] for j in box]), np.array([rows[j][3] for j in box])
            m = len(box)
            if (z == z[0]).all():
                back = np.full(m, v.mean())
            else:
                slope = -0.0065
                if m >= num_min_prof and quantile(0.95, z) - quantile(0.05, z) >= min_elev_diff:
                    slope = quantile(0.5, [0.0 if abs(z[a] - z[b]) < 1 else (v[a] - v[b]) / (z[a] - z[b]) for a in range(m) for b in range(a + 1, m)])
                back = quantile(0.5, v - slope * z) + slope * z
            away = np.array([[0.0 if (xyz[a] == xyz[b]).all() else math.acos(max(0.0, min(1.0, float(xyz[a] @ xyz[b])))) * 6371 for b in box] for a in box])
            scale = max(min_horizontal_scale, sum(quantile(0.1, np.delete(away[a], a)) for a in range(m)) / m)
            s = np.exp(-0.5 * (away / scale) ** 2 - 0.5 * ((z[:, None] - z[None, :]) / vertical_scale) ** 2)
            inverse, d = np.linalg.inv(s + eps2 * np.eye(m)), v - back
            w = inverse @ d
            left, analysis = -w / np.diag(inverse), s @ w - d
            chance = left * analysis / max(0.01, float((-d * analysis).sum()) / m)
            for k, j in enumerate(box):
                if not rows[j][4]:
                    checked[i] = True
                elif near[k][0] <= inner_radius:
                    if chance[k] > (pos if left[k] < 0 else neg):
                        flag[j], thrown = "Fail", thrown + 1
                    checked[j] = True
        if not thrown:
            break
    return flag


@pytest.mark.parametrize("case", range(6))
def test_sct_random_against_the_definition(spark, case):
    rng = np.random.default_rng(30 + case)
    args = ARGS | dict(num_min=4, num_max=(8, 60)[case % 2], inner_radius=(0.0, 6.0, 30.0)[case % 3], outer_radius=(225.0, 400.0)[case % 2], num_iterations=3, num_min_prof=(6, 20)[case % 2], min_elev_diff=60.0, min_horizontal_scale=3.0, pos=1.6, neg=1.1)
    rows, by = [], {}
    for slice_id in (1, 2, None):
        centres = rng.uniform(0, 1, (4, 2)) * (1.0, 2.0)
        for i in range(60):
            lat, lon = centres[int(rng.integers(4))] + rng.normal(0, (0.05, 0.3)[i % 7 == 0], 2)
            elev = NAN if i == 7 else float(rng.integers(0, 40) * 10)
            value = None if i == 9 else math.inf if i == 11 else float(10 - 0.0065 * elev + rng.normal() + 9 * (rng.random() < 0.08))
            rows.append((slice_id, i, 60 + float(lat), 10 + float(lon), elev, value, bool(case < 3 or rng.random() < 0.7)))
            by.setdefault(slice_id, []).append(rows[-1][2:])
    df = spark.createDataFrame(rows, SCHEMA + ", judge boolean").repartition(3)
    got = {(r["slice_id"], r["station_idx"]): r["flag"] for r in sct(df, mask="judge", **args).collect()}
    assert len(got) == 180
    for slice_id, own in by.items():
        assert [got[slice_id, i] for i in range(60)] == plain_sct(own, **args)
    assert {"Pass", "Fail", "Isolated", "Invalid", "DataMissing"} <= set(got.values())


def test_sct_query_against_the_definition(spark):
    from conftest import SF

    from kestrelqc.plans.queries import ELEV_DIFF, NUM_MIN, QUERIES, RADIUS2
    from kestrelqc.sources.tables import customer_stations

    by = {}
    for r in customer_stations(spark, SF).orderBy("station_idx").collect():
        by.setdefault(r["slice_id"], []).append((r["station_idx"], (r["lat"], r["lon"], r["elev"], r["value"], True)))
    got = {(r["slice_id"], r["station_idx"]): r["flag"] for r in QUERIES["sct_boxes"](spark, SF).collect()}
    for k, rows in by.items():
        expect = plain_sct([r for _, r in rows], NUM_MIN, 100, 10.0, RADIUS2, 2, 20, ELEV_DIFF, 10.0, 200.0, 4.0, 8.0, 0.5)
        assert [got[k, i] for i, _ in rows] == expect


def test_sct_sweeps_are_the_whole_slices(spark):
    # Alone the row is quiet after a sweep; a far-off group that fails someone makes all go through another.
    far = {"inner_radius": 0.0, "outer_radius": 100.0, "num_iterations": 2, "num_min": 3, "pos": 1.0, "neg": 1.0}
    row = ([10.0, 10.17, 9.83], [1, 1, 1])
    other = ([40 + 0.01 * k for k in range(8)], [0, 0, 0, 50, 0, 0, 0, 0])
    assert flags(sct(stations(spark, *row), **ARGS | far)) == ["Pass", "Isolated", "Isolated"]
    both = flags(sct(stations(spark, row[0] + other[0], row[1] + other[1]), **ARGS | far))
    assert both[:3] == ["Isolated"] * 3 and "Fail" in both


def test_sct_arguments_by_station(spark):
    df = stations(spark, [10, 10.01, 10.02], [0, 1, 100]).withColumn("p", F.when(F.col("station_idx") == 2, 9.0).otherwise(2.0))
    assert flags(sct(df, **ARGS | {"pos": F.col("p"), "neg": F.col("p"), "eps2": F.lit(0.5)})) == ["Pass"] * 3
    for name in ("pos", "neg", "eps2"):
        with pytest.raises(PySparkException, match=name):
            sct(df, **ARGS | {name: F.col("p") - 5}).collect()
    with pytest.raises(PySparkException, match="latlon"):
        sct(stations(spark, [10, 400], [0, 1]), **ARGS).collect()


def odd_stations(spark):
    """Repeated stations, a null slice, null numbers and coordinates, and names that results have."""
    rows = [(s, i, 60.0, o, 0.0, v) for s in (1, None) for i, o, v in ((0, 10.0, 0.0), (1, 10.01, 0.0), (1, 10.01, 0.0), (2, 10.02, 0.1), (2, 10.02, 0.1), (3, 10.03, 9.0), (None, 10.04, 0.0), (4, None, 1.0), (5, 10.05, None))]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"flag": F.lit("own"), "x": F.lit("x"), "_row": F.lit(-1), "judge": F.lit(7), "prob_gross_error": F.lit(5)})


def test_odd_stations(spark):
    df = odd_stations(spark)
    near = neighbours(df, 1e6, carry=("x", "value")).collect()
    assert {r["n_x"] for r in near} == {"x"} and {r["slice_id"] for r in near} == {1, None}
    assert sum(r["slice_id"] is None for r in near) == len(near) / 2 and sum(r["station_idx"] == 1 for r in near) == 2 * 2 * 6
    flagged = df.withColumn("flag", F.when(F.col("station_idx") == 2, "Fail").otherwise("Pass"))
    pairs = neighbours(df.where("station_idx in (0, 1, 2)"), 1e6).dropDuplicates()
    assert Counter((r["slice_id"], r["neighbour_idx"]) for r in unflagged(pairs, flagged).collect()) == {(s, i): 2 for s in (1, None) for i in (0, 1)}
    found = gather(pairs.withColumn("x", F.lit("mine")), df.dropDuplicates(["slice_id", "station_idx"]), ["x", "value"])
    assert found.count() == 12 and found.columns[-3:] == ["x", "x_", "value"]
    checked_ = buddy_check(df, 1e6, 2, 2.0, 200.0, -0.0065, 0.01, 2)
    tested = sct(df, **ARGS | {"num_min": 3})
    for out, more in ((checked_, ["flag_"]), (tested, ["flag_", "prob_gross_error_"])):
        rows = out.collect()
        assert out.columns == [*df.columns, *more] and len(rows) == 18 and {r["flag"] for r in rows} == {"own"}
        for s in (1, None):
            got = sorted(((r["station_idx"] is not None, r["station_idx"] or 0, r["flag_"]) for r in rows if r["slice_id"] == s))
            assert [f for *_, f in got][:1] + [f for *_, f in got][-3:] == ["Pass", "Fail", {"buddy": "Pass", "sct": "Isolated"}["sct" if len(more) > 1 else "buddy"], "DataMissing"]
    assert buddy_check(df.limit(0), 1e6, 2, 2.0, 200.0, -0.0065, 0.01, 2).count() == 0 == sct(df.limit(0), **ARGS).count()


def test_crowded_cells(spark):
    rng = np.random.default_rng(21)
    df = stations(spark, list(rng.uniform(10, 10.5, 150)), [0.0] * 150, lats=list(rng.uniform(60, 60.3, 150)))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(neighbours(df, 100.0, dense=7)) == key(neighbours(df, 100.0))


def test_lookup_by_index(spark):
    from kestrelqc.operators.neighbours import at_index

    df = odd_stations(spark).where("station_idx in (0, 3)")
    wanted = spark.createDataFrame([(1, 3, "a"), (None, 0, "b"), (2, 0, "c"), (1, None, "d")], "slice_id int, station_idx int, lat string")
    got = sorted((r["slice_id"] or 0, r["station_idx"], r["lat"], r["lat_"], r["lon"]) for r in at_index(df, wanted).collect())
    assert got == [(0, 0, "b", 60.0, 10.0), (1, 3, "a", 60.0, 10.03)]


def test_median_slopes_of_blocks(spark, monkeypatch):
    from kestrelqc.functions import stats

    rng, rows = np.random.default_rng(22), []
    for g, n in enumerate((1, 2, 3, 40, 121)):
        rows += [(g, i, float(rng.integers(0, 60)) * (1.0 if g % 2 else 0.7), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, z double, v double")
    for block in (2048, 16):
        monkeypatch.setattr(stats, "BLOCK", block)
        got = {r["g"]: r["fitted"] for r in stats.median_slopes(df).collect()}
        for g in range(1, 5):
            own = [r for r in rows if r[0] == g]
            slopes = [0.0 if abs(a[2] - b[2]) < 1 else (a[3] - b[3]) / (a[2] - b[2]) for k, a in enumerate(own) for b in own[k + 1 :]]
            assert got[g] == pytest.approx(np.median(slopes), abs=1e-12), (block, g)
        assert set(got) == {1, 2, 3, 4}


def test_profiles_of_odd_rows(spark):
    from kestrelqc.functions.stats import profile_lines

    rows = [(None, i, 10.0 * i, 1.0 - 0.5 * i) for i in range(12)] + [("a", 0, 5.0, 2.0), ("a", 1, None, 3.0), ("a", 2, NAN, 3.0), ("a", 3, 1.0, math.inf)]
    got = {r["k"]: r for r in profile_lines(spark.createDataFrame(rows, "k string, i int, z double, v double"), ["k"], "z", "v", 5, 50.0, "i").collect()}
    assert got[None]["kind"] == "full" and got[None]["slope"] == pytest.approx(-0.05) and got[None]["intercept"] == pytest.approx(1.0)
    assert (got["a"]["kind"], got["a"]["intercept"]) == ("flat", 2.0)


@pytest.mark.parametrize(
    "wrong",
    [{"num_min": 1}, {"num_max": 2}, {"num_iterations": 0}, {"min_elev_diff": 0.0}, {"min_horizontal_scale": 0.0}, {"vertical_scale": 0.0}, {"inner_radius": -1.0}, {"outer_radius": 1.0}, {"eps2": 0.0}, {"pos": -1.0}, {"neg": -1.0}],
)
def test_sct_arguments(spark, wrong):
    with pytest.raises(InvalidArg, match=next(iter(wrong))):
        sct(stations(spark, [10], [0]), **ARGS | wrong)


def test_sct_isolation_order(spark):
    # C - A - B in a row: A has both, then B and C lose each other.
    far = {"inner_radius": 0.0, "outer_radius": 100.0, "num_iterations": 2, "num_min": 3}
    row = stations(spark, [10.0, 10.17, 9.83], [1, 1, 1])
    assert flags(sct(row, **ARGS | far)) == ["Pass", "Isolated", "Isolated"]


def test_queries_against_sql(spark, duck):
    from conftest import SF

    from kestrelqc.plans.queries import QUERIES, SQL

    for name in ("dip_check", "step_check_documented", "neighbours_with_distance", "buddy_one_sweep", "theil_sen_profile_full", "sct_triplets", "flag_summary"):
        got = QUERIES[name](spark, SF).toPandas()
        columns = sorted(got.columns)
        expect = duck.sql(SQL[name]).df()
        key = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))  # noqa: E731, B023
        assert key(got) == key(expect), name


@pytest.mark.parametrize("name", ["full", "basic", "flat"])
def test_whole_profiles_against_all_pairs(spark, name):
    from conftest import SF

    from kestrelqc.plans.queries import QUERIES
    from kestrelqc.sources.tables import customer_stations

    by = {}
    for r in customer_stations(spark, SF).collect():
        by.setdefault(r["slice_id"], []).append((50.0 if name == "flat" else r["elev"], r["value"]))
    got = {r["slice_id"]: r for r in QUERIES[f"theil_sen_profile_{name}"](spark, SF).collect()}
    assert set(got) == set(by)
    for k, rows in by.items():
        z, v = np.array(rows, float).T
        i, j = np.triu_indices(len(z), 1)
        dz = z[i] - z[j]
        if (z == z[0]).all():
            expect = ("flat", 0.0, v.mean())
        else:
            basic = len(z) < (1000 if name == "basic" else 5) or np.quantile(z, 0.95) - np.quantile(z, 0.05) < 100
            slope = -0.0065 if basic else np.median(np.where(np.abs(dz) < 1, 0.0, (v[i] - v[j]) / np.where(dz == 0, 1.0, dz)))
            expect = ("basic" if basic else "full", slope, np.median(v - slope * z))
        assert got[k]["kind"] == expect[0] and np.allclose((got[k]["slope"], got[k]["intercept"]), expect[1:], atol=2e-6), k


def scattered(spark, n=150, seed=21):
    rng = np.random.default_rng(seed)
    rows = [(int(i % 2), i, float(60 + rng.integers(0, 12) * 0.02), float(10 + rng.integers(0, 12) * 0.04), float(rng.integers(0, 400)), float(rng.normal() + 6 * (rng.random() < 0.1))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_where_they_meet(spark):
    # However small a table is taken to be, none of stations goes through the driver.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        pairs = neighbours(scattered(spark), 100.0)
        assert "ShuffledHashJoin" in plan(pairs) and plan(pairs).count("BroadcastHashJoin") == 2  # the cells, to both sides
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def joined_rows(df):
    """What the joins by hash of both sides have made, after ``df`` has run."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name, inner = node.nodeName(), node.children()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        elif name == "ShuffledHashJoin":
            found += node.metrics().apply("numOutputRows").value()
        nodes += [inner.apply(i) for i in range(inner.size())]
    return found


def test_stations_of_one_place_meet_as_one(spark):
    # 20 stations at each of 6 places, two apart: the join has a row for a pair of places, not of stations.
    rows = [(None if i % 3 else 1, i, 60.0 + i % 2 * 0.02, 10.0 + i % 3 * 0.04, float(i), float(i)) for i in range(120)]
    rows += [(1, 0, 60.0, 10.0, 5.0, 5.0), (1, None, 60.0, 10.04, 6.0, 6.0), (1, 500, None, 10.0, 7.0, 7.0), (1, 501, NAN, 10.0, 8.0, 8.0), (1, 502, -60.0, 180.0, 9.0, 9.0), (1, 503, -60.0, -180.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for include in (False, True):
        for dense in (1, 7, 20_000):
            pairs = neighbours(df, 100.0, include, carry=("elev",), own=("value",), dense=dense)
            got = Counter(tuple(r[c] for c in ("slice_id", "station_idx", "neighbour_idx", "own_value", "n_elev")) for r in pairs.collect())
            xyz = [None if r[2] is None or math.isnan(r[2]) else [6371 * f for f in (math.cos(math.radians(r[2])) * math.cos(math.radians(r[3])), math.cos(math.radians(r[2])) * math.sin(math.radians(r[3])), math.sin(math.radians(r[2])))] for r in rows]
            expect = Counter((a[0], a[1], b[1], a[5], b[4]) for a, p in zip(rows, xyz, strict=True) for b, q in zip(rows, xyz, strict=True) if a[0] == b[0] and p and q and math.dist(p, q) <= 10 and (include or p != q))
            assert got == expect, (include, dense)
            if dense == 20_000:
                assert 0 < joined_rows(pairs) < sum(expect.values()) / 20
    varied = neighbours(df, F.when(F.col("station_idx") % 2 == 0, 0.01).otherwise(100.0), largest=100.0)
    assert {r["station_idx"] % 2 for r in varied.where("station_idx < 500 and distance > 1").collect()} == {1}


def test_rounded(spark):
    from kestrelqc.functions.values import rounded

    rng = np.random.default_rng(23)
    values = [*map(float, rng.normal(size=3000) * 20), *(k / 2000 for k in range(-2001, 2001)), 0.0005, 1.0005, 2.5e-7, -0.0, 1e12 + 0.3, 1e300, NAN, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 6):
        assert df.where(~rounded(F.col("v"), digits).eqNullSafe(F.round("v", digits))).count() == 0


def held(df, radius_km, match=False):
    """Pairs (station, neighbour, distance) of rows of `scattered`, from all pairs."""
    rows = df.collect()
    rad = lambda k: np.radians([r[k] for r in rows])
    la, lo = rad("lat"), rad("lon")
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1) * 6371
    for i, a in enumerate(rows):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        for j in np.flatnonzero(d <= radius_km):
            b = rows[j]
            if a["slice_id"] == b["slice_id"] and (match or (a["lat"], a["lon"]) != (b["lat"], b["lon"])):
                yield a, b, float(d[j])


def without_joined_pairs(df):
    """Where pairs are not rows, no join makes them: what joins there are is with the list of cells."""
    return "ShuffledHashJoin" not in plan(df) and "SortMergeJoin" not in plan(df) and "MapInArrow" in plan(df)


def test_counts_without_rows_of_pairs(spark):
    from kestrelqc.operators.neighbours import counted

    df = scattered(spark)
    for match in (False, True):
        for mode, radius in (("squared_km", 25.0), ("km", 5.0), ("m", 5000.0)):
            out = counted(df, radius, match, mode, dense=7)
            assert without_joined_pairs(out)
            got = {(r["slice_id"], r["station_idx"]): r["n"] for r in out.collect()}
            assert got == Counter((a["slice_id"], a["station_idx"]) for a, _, _ in held(df, 5.0, match)), (match, mode)
    odd = odd_stations(spark)
    key = lambda d: Counter(map(tuple, d.collect()))
    assert key(counted(odd, 1e6)) == key(neighbours(odd, 1e6).groupBy("slice_id", "station_idx").agg(F.count("*").alias("n")))
    assert counted(odd.limit(0), 1e6).count() == 0


def test_nearest_without_rows_of_pairs(spark):
    from kestrelqc.operators.neighbours import nearest_neighbours

    df = scattered(spark, 250)
    for most, digits, dense in ((1, 3, 9), (5, 3, 20_000), (5, 0, 9), (5, None, 9), (400, 3, 20_000)):
        found = nearest_neighbours(df, 64.0, most, digits, dense=dense)
        assert without_joined_pairs(found)
        got = Counter((r["slice_id"], r["station_idx"], r["neighbour_idx"], r["rank"]) for r in found.collect())
        assert got == Counter((r["slice_id"], r["station_idx"], r["neighbour_idx"], r["rank"]) for r in nearest(neighbours(df, 64.0), most, digits).collect())


def test_what_is_gathered_does_not_go_through_the_driver(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = scattered(spark)
        found = gather(df.select("slice_id", "station_idx", F.col("station_idx").alias("neighbour_idx")), df, ["value"])
        assert "Broadcast" not in plan(found) and found.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_flagged_neighbours_are_not_sought(spark):
    from kestrelqc.operators.neighbours import unflagged_neighbours

    key = lambda d: Counter(map(tuple, d.collect()))
    for df in (scattered(spark), odd_stations(spark)):
        given = df.select("slice_id", "station_idx", F.when(F.col("station_idx") % 3 == 2, "Fail").otherwise("Pass").alias("flag"))
        found = unflagged_neighbours(df, given, 100.0)
        assert plan(found).count("SortMergeJoin LeftSemi") + plan(found).count("SortMergeJoin [") == 1
        assert key(found) == key(unflagged(neighbours(df, 100.0), given))


def test_pairs_carry_the_height_of_the_station(spark):
    from kestrelqc.operators.buddy import adjusted

    df = scattered(spark)
    own = adjusted(neighbours(df, 100.0, carry=("value", "elev"), own=("elev",)), df, 200.0, -0.0065)
    joined = adjusted(neighbours(df, 100.0, carry=("value", "elev")), df, 200.0, -0.0065)
    assert plan(joined).count("Join") > plan(own).count("Join") == plan(neighbours(df, 100.0)).count("Join")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert own.columns == joined.columns and key(own) == key(joined)


def test_moments_without_rows_of_pairs(spark):
    from kestrelqc.operators.buddy import adjusted, mean_and_variance, moments, sums_about

    df = scattered(spark).unionByName(spark.createDataFrame([(0, 900, 60.0, 10.0, None, 1.0), (0, 901, 60.0, 10.01, NAN, 1.0), (1, 902, 60.0, 10.02, 5.0, None), (None, 903, 60.0, 10.02, 5.0, 1.0)], SCHEMA))
    mean, variance = mean_and_variance()
    for diff in (200.0, -1.0):
        out = sums_about(df, df, 64.0, diff, -0.0065, dense=9)
        assert without_joined_pairs(out)
        got = {(r[0], r[1]): r[2:] for r in out.select("slice_id", "station_idx", "n", mean, variance).collect()}
        expect = {(r[0], r[1]): r[2:] for r in moments(adjusted(neighbours(df, 64.0, carry=("value", "elev")), df, diff, -0.0065)).collect() if r["n"]}
        assert got.keys() == expect.keys() and all(np.allclose(got[k], expect[k], atol=1e-9) for k in got)


def test_buddy_check_keeps_no_pairs(spark, monkeypatch):
    from kestrelqc.operators import buddy as module

    kept, write = [], module.settled
    monkeypatch.setattr(module, "settled", lambda df, since, name: kept.append((name, write(df, since, name))) or kept[-1][1])
    df = scattered(spark, 240, 31).where("slice_id = 0")
    rows = [tuple(r) for r in df.select("slice_id", "station_idx", "lat", "lon", "elev", "value").orderBy("station_idx").collect()]
    got = flags(buddy_check(df.orderBy(F.desc("station_idx")), 400.0, 4, 1.5, 200.0, -0.0065, 0.01, 4))
    assert got == sequential(rows, 20.0, 4, 1.5, 200.0, -0.0065, 0.01, 4) and "Fail" in got
    assert len(kept) > 2 and {n for n, _ in kept} == {"state"} and kept[-1][1].count() == len(rows)
