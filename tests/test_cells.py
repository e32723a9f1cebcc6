"""Cells cut by rank: bounded at any density, exact walks, and no step keyed by the group alone."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hinterland.operators.cells import cells, kd_code, nearest_points
from hinterland.operators.distance import nearest_join


def frame(spark, seed, n, hot, name):
    """Points of which most lie in group a, half of those within a few metres of each other."""
    rng = np.random.default_rng(seed)
    lon, lat = rng.uniform(-179, 179, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    dense = rng.random(n) < hot
    lon[dense], lat[dense] = 10 + rng.normal(0, 1e-5, dense.sum()), 50 + rng.normal(0, 1e-5, dense.sum())
    return pd.DataFrame({name: np.arange(n), "g": np.where(rng.random(n) < 0.8, "a", "b"), "lon": lon, "lat": lat})


def nearest(starts, ends):
    out = {}
    for g in "ab":
        s, e = starts[starts.g == g], ends[ends.g == g].sort_values("eid")
        a, b = np.radians(s[["lon", "lat"]].to_numpy()), np.radians(e[["lon", "lat"]].to_numpy())
        h = (np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1])
             * np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2)
        d = 2 * 6378137.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))
        for k, i in enumerate(s.sid):
            out[int(i)] = (d[k].min(), e.eid.to_numpy()[d[k] <= d[k].min() * (1 + 1e-9) + 1e-9])
    return out


@pytest.mark.parametrize(("n", "m", "cell"), [(700, 900, 16), (40, 3000, 8), (900, 1, 256)])
def test_walk_finds_the_nearest_in_a_dense_hot_group(spark, n, m, cell):
    starts, ends = frame(spark, 1, n, 0.5, "sid"), frame(spark, 2, m, 0.5, "eid")
    got = nearest_join(spark.createDataFrame(starts), spark.createDataFrame(ends), "sid", "eid", ["g"], cell=cell)
    want = nearest(starts[starts.g.isin(ends.g)], ends)
    rows = {r.sid: (r.meters, r.eid) for r in got.collect()}
    assert rows.keys() == want.keys()
    for i, (d, who) in want.items():
        # Between neighbours of centimetres the formula itself is good to about a tenth of a micrometre.
        assert rows[i][0] == pytest.approx(d, rel=1e-9, abs=1e-6) and rows[i][1] in who


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=25),
       st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=25))
def test_ties_go_to_the_smallest_id(spark, a, b):
    """On a coarse grid ties and equal places abound."""
    starts = spark.createDataFrame([(i, 1, x * 20.0, y * 20.0) for i, (x, y) in enumerate(a)],
                                   "sid long, g int, lon double, lat double")
    ends = spark.createDataFrame([(i, 1, x * 20.0, y * 20.0) for i, (x, y) in enumerate(b)],
                                 "eid long, g int, lon double, lat double")
    got = {r.sid: (r.eid, r.meters) for r in nearest_join(starts, ends, "sid", "eid", ["g"], cell=3).collect()}
    from hinterland.functions.geo import great_circle
    pairs = starts.join(ends.withColumnsRenamed({"lon": "lon2", "lat": "lat2"}), "g").select(
        "sid", F.struct(great_circle("lon", "lat", "lon2", "lat2").alias("m"), "eid").alias("best"))
    want = {r.sid: (r.best.eid, r.best.m) for r in pairs.groupBy("sid").agg(F.min("best").alias("best")).collect()}
    assert got == want


def test_cells_are_bounded_and_tile_the_points(spark):
    points = spark.createDataFrame(frame(spark, 3, 2000, 0.9, "id"))
    found = cells(points, ["g"], ["id"], "lon", "lat", 50)
    rows = found.leaves.select("g", "cell", F.size("points").alias("n"), "points.id").collect()
    assert max(r.n for r in rows) <= 50 and len(rows) <= 2000 / 50 + 2
    assert sorted(i for r in rows for i in r.id) == list(range(2000))
    assert found.level(found.top).count() == 2
    same = points.withColumns({"lon": F.lit(1.0), "lat": F.lit(2.0)})
    assert max(r.n for r in cells(same, ["g"], ["id"], "lon", "lat", 50).leaves.select(
        F.size("points").alias("n")).collect()) <= 50


def test_code_keeps_the_halves_of_space_apart(spark):
    row = spark.sql("SELECT 0.9D AS p, -0.9D AS m").select(
        kd_code([F.col("p")] * 3).alias("high"), kd_code([F.col("m")] * 3).alias("low"),
        kd_code([F.col("m"), F.col("m"), F.col("p")]).alias("z")).first()
    assert row.low < row.z < row.high and row.z >> 59 == 1


def test_rows_without_place_or_group(spark):
    schema = "id long, g string, lon double, lat double"
    rows = [(1, "a", 0.0, 0.0), (2, None, 0.0, 0.0), (3, "a", None, 0.0), (4, "a", float("nan"), 0.0), (5, "c", 0.0, 0.0)]
    ends = spark.createDataFrame([(9, "a", 1.0, 0.0), (8, None, 0.0, 0.0), (7, "a", float("nan"), 0.0)], schema)
    starts = spark.createDataFrame(rows, schema)
    got = nearest_join(starts, ends.withColumnRenamed("id", "eid"), "id", "eid", ["g"]).collect()
    assert [(r.id, r.eid) for r in got] == [(1, 9)]
    assert nearest_join(starts, ends.limit(0).withColumnRenamed("id", "eid"), "id", "eid", ["g"]).count() == 0


def test_nothing_is_keyed_by_the_group_alone(spark):
    starts = spark.createDataFrame(frame(spark, 1, 700, 0.5, "sid"))
    ends = spark.createDataFrame(frame(spark, 2, 900, 0.5, "eid"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = nearest_join(starts, ends, "sid", "eid", ["g"], cell=16)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"hashpartitioning\(((?:[^()]|\([^()]*\))*)\)", plan)
    assert len(keys) > 8
    for k in keys:
        assert len([c for c in k.split(", ") if "#" in c]) >= 2, k
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_starts_are_shuffled_once_and_never_lie_beside_ends(spark):
    starts, ends = (spark.createDataFrame(frame(spark, i, 300, 0.5, name)) for i, name in ((1, "sid"), (2, "eid")))
    plan = nearest_join(starts, ends, "sid", "eid", ["g"], cell=16)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow [" not in plan
    # One repartition of the starts, one of the cells of ends near them.
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_a_start_gives_one_row_from_all_cells_it_meets(spark):
    starts, ends = frame(spark, 1, 300, 0.0, "_start"), frame(spark, 2, 900, 0.0, "_end")
    both = [spark.createDataFrame(d).withColumnsRenamed({"lon": f"_{c}lon", "lat": f"_{c}lat"})
            for d, c in ((starts, "s"), (ends, "e"))]
    cols = [["_start", "_slon", "_slat"], ["_end", "_elon", "_elat"]]
    dealt = [cells(d, ["g"], c, c[1], c[2], 16) for d, c in zip(both, cols)]
    rows = nearest_points(*dealt, *[[d.schema[c] for c in names] for d, names in zip(both, cols)])
    assert rows.count() == 300
