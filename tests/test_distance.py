import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hinterland.functions import great_circle
from hinterland.operators.distance import nearest_join, popdist_weighted_mean
from hinterland.operators.regions import neighbour_set, points_in_polygons, segments

R = 6378137.0


def haversine(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    h = np.sin((lat2 - lat1) / 2) ** 2
    h = h + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(h))


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"unitid": range(30), "year": np.arange(30) % 2,
                      "lon": rng.uniform(-120, -75, 30), "lat": rng.uniform(25, 49, 30)})
    y = pd.DataFrame({"year": np.arange(200) % 2, "lon": rng.uniform(-120, -75, 200),
                      "lat": rng.uniform(25, 49, 200), "pop": rng.integers(1, 500, 200),
                      "m": rng.uniform(1, 11, 200)})
    y.loc[0, ["lon", "lat"]] = x.loc[0, ["lon", "lat"]].values  # zero distance
    y.loc[5:9, "lon"], y.loc[5:9, "lat"] = y.loc[4, "lon"], y.loc[4, "lat"]  # one location
    return x, y


def brute(x, y, decay, by_year):
    out = {}
    for _, a in x.iterrows():
        z = y[(y.year == a.year)] if by_year else y
        z = z[z.m.notna()]
        d = np.maximum(haversine(a.lon, a.lat, z.lon, z.lat), 1.0)
        w = z["pop"] * d**-decay
        out[int(a.unitid)] = float((w * z.m).sum() / w.sum())
    return out


@pytest.mark.parametrize("by", [(), ("year",)])
@pytest.mark.parametrize("decay", [2.0, 1.0, 0.0])
def test_weighted_mean_equals_brute_force(spark, world, by, decay):
    x, y = world
    y = y.copy()
    y.loc[11, "m"] = np.nan
    ys = spark.createDataFrame(y).withColumn("m", F.nanvl("m", F.lit(None)))
    got = popdist_weighted_mean(
        spark.createDataFrame(x), ys, ["m"], "unitid", by=by, decay=decay,
        x_block=7, y_block=40, prefix="w_",
    ).collect()
    want = brute(x, y, decay, bool(by))
    assert len(got) == len(want)
    for r in got:
        assert r["w_m"] == pytest.approx(want[r["unitid"]], rel=1e-9)


def test_weighted_mean_properties(spark, world):
    x, y = (spark.createDataFrame(d) for d in world)
    equal = popdist_weighted_mean(x, y.withColumn("m", F.lit(4.5)), ["m"], "unitid").collect()
    assert all(r["pdw2_m"] == pytest.approx(4.5) for r in equal)
    one = {r["unitid"]: r["pdw2_m"] for r in popdist_weighted_mean(x, y, ["m"], "unitid").collect()}
    scaled = y.withColumn("pop", F.col("pop") * 1000)
    for r in popdist_weighted_mean(x, scaled, ["m"], "unitid").collect():
        assert r["pdw2_m"] == pytest.approx(one[r["unitid"]])


def test_all_null_measure_is_null(spark, world):
    x, y = (spark.createDataFrame(d) for d in world)
    y = y.withColumn("m", F.lit(None).cast("double"))
    assert all(r["pdw2_m"] is None for r in
               popdist_weighted_mean(x, y, ["m"], "unitid").collect())


@pytest.mark.parametrize("by", [(), ("year",)])
def test_rows_that_meet_no_area_stay_with_null_measures(spark, by):
    x = spark.createDataFrame(
        [(1, 0, -90.0, 40.0), (2, 0, None, 40.0), (3, 0, -90.0, None), (4, 7, -90.0, 40.0),
         (5, None, -90.0, 40.0)], "unitid long, year int, lon double, lat double")
    y = spark.createDataFrame(
        [(0, -91.0, 41.0, 10, 3.0), (None, -91.0, 41.0, 10, 3.0)],
        "year int, lon double, lat double, pop int, m double")
    got = {r.unitid: r.pdw2_m for r in
           popdist_weighted_mean(x, y, ["m"], "unitid", by=by).collect()}
    met = pytest.approx(3.0)
    assert got == {1: met, 2: None, 3: None, 4: None if by else met, 5: None if by else met}
    none = popdist_weighted_mean(x, y.limit(0), ["m"], "unitid", by=by).collect()
    assert len(none) == 5 and all(r.pdw2_m is None for r in none)


def test_no_pairs_and_no_cross_join_in_plan(spark, world):
    x, y = (spark.createDataFrame(d) for d in world)
    plan = popdist_weighted_mean(x, y, ["m"], "unitid", by=["year"])
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("cell", [2, 64])
def test_nearest_equals_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    n = 150
    starts = pd.DataFrame({"sid": range(n), "g": np.where(np.arange(n) < 100, "a", "b"),
                           "lon": rng.uniform(-179, 179, n), "lat": rng.uniform(-80, 80, n)})
    ends = pd.DataFrame({"eid": range(90), "g": np.where(np.arange(90) < 85, "a", "b"),
                         "lon": np.r_[rng.uniform(-179, 179, 40), rng.normal(10, 0.01, 50)],
                         "lat": np.r_[rng.uniform(-80, 80, 40), rng.normal(50, 0.01, 50)]})
    ends.loc[1, ["lon", "lat"]] = ends.loc[0, ["lon", "lat"]].values  # a tie
    starts.loc[len(starts)] = [n, "empty", 0.0, 0.0]
    got = nearest_join(
        spark.createDataFrame(starts), spark.createDataFrame(ends), "sid", "eid", ["g"], cell=cell
    ).collect()
    assert len(got) == n
    for r in got:
        s = starts.loc[r["sid"]]
        e = ends[ends.g == s.g]
        d = haversine(s.lon, s.lat, e.lon.to_numpy(), e.lat.to_numpy())
        assert r["meters"] == pytest.approx(d.min(), rel=1e-9)
        assert r["eid"] == e.eid.to_numpy()[d.argmin()]


def test_great_circle_quarter(spark):
    row = spark.range(1).select(great_circle(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))
                                .alias("d")).first()
    assert row["d"] == pytest.approx(R * math.pi / 2)


def test_polygons_with_hole_edge_and_outside(spark):
    ring = [("p", 1, 1, 0, 0), ("p", 1, 2, 10, 0), ("p", 1, 3, 10, 10), ("p", 1, 4, 0, 10),
            ("p", 2, 1, 4, 4), ("p", 2, 2, 6, 4), ("p", 2, 3, 6, 6), ("p", 2, 4, 4, 6),
            ("q", 3, 1, 10, 0), ("q", 3, 2, 20, 0), ("q", 3, 3, 15, 8)]
    polygons = spark.createDataFrame(
        [(p, g, o, float(a), float(b)) for p, g, o, a, b in ring],
        "polyname string, group int, order int, long double, lat double")
    points = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 10.0, 5.0), (5, 15.0, 2.0),
         (6, -1.0, 5.0), (7, 9.999, 9.0), (8, None, 1.0)], "id int, lon double, lat double")
    names = spark.createDataFrame([("p", "00001"), ("q", "00002")], "polyname string, fips string")
    for most in (2, 4, 50):
        got = {r["id"]: r["fips"] for r in
               points_in_polygons(points, polygons, names=names, most_edges=most).collect()}
        assert got == {1: "00001", 2: None, 3: "00001", 4: None, 5: "00002", 6: None,
                       7: "00001", 8: None}


def test_overlapping_polygons_keep_one_row(spark):
    square = [(n, 1, o, x, y) for n in ("b", "a") for o, (x, y) in
              enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    polygons = spark.createDataFrame(
        square, "polyname string, group int, order int, long double, lat double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "id int, lon double, lat double")
    got = points_in_polygons(points, polygons, point_key=["id"]).collect()
    assert {r["id"]: r["polyname"] for r in got} == {1: "a", 2: None}


def test_neighbours_and_segments(spark):
    adj = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "orgfips int, adjfips int")
    assert {r["adjfips"] for r in neighbour_set(adj, 1).collect()} == {1, 2, 3}
    centres = spark.createDataFrame([(2, 5.0, 6.0), (3, 7.0, 8.0)], "id int, lon double, lat double")
    origin = spark.createDataFrame([(0.5, 0.6)], "lon double, lat double")
    rows = segments(origin, centres).collect()
    assert all((r["x"], r["y"]) == (0.5, 0.6) for r in rows) and len(rows) == 2
