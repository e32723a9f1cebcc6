"""Polygons in a quadtree: the even-odd test of all edges, from the edges of one cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinterland.operators.quadtree import EDGES, build_tree
from hinterland.operators.regions import points_in_polygons, polygon_edges

VERTICES = "polyname string, group int, order int, long double, lat double"
POINTS = "id long, lon double, lat double"


def ring(name, group, xy):
    return [(name, group, o, float(x), float(y)) for o, (x, y) in enumerate(xy)]


def even_odd(vertices, points):
    """Names by point, by the horizontal ray test over all edges."""
    rings = {}
    for name, group, _, x, y in sorted(vertices, key=lambda v: (v[0], v[1], v[2])):
        rings.setdefault((name, group), []).append((x, y))
    px, py = points[:, 0], points[:, 1]
    inside = {}
    for (name, _), xy in rings.items():
        odd = inside.setdefault(name, np.zeros(len(points), bool))
        for (x1, y1), (x2, y2) in zip(xy, xy[1:] + xy[:1]):
            if y1 != y2:
                at = x1 + (py - y1) / (y2 - y1) * (x2 - x1)
                odd ^= ((y1 <= py) != (y2 <= py)) & (px < at)
    return {i: sorted(n for n, odd in inside.items() if odd[i]) for i in range(len(points))}


def found(spark, vertices, points, **options):
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], POINTS)
    got = {i: [] for i in range(len(points))}
    for r in points_in_polygons(rows, spark.createDataFrame(vertices, VERTICES), **options).collect():
        if r.polyname is not None:
            got[r.id].append(r.polyname)
    return {i: sorted(n) for i, n in got.items()}


@pytest.mark.parametrize(("seed", "most"), [(0, 4), (1, 12), (2, 32)])
def test_grid_of_corners_and_borders(spark, seed, most):
    """Whole coordinates, so that vertices, borders of cells and points coincide as often as can be."""
    rng = np.random.default_rng(seed)
    vertices = []
    for k in range(12):
        xy = rng.integers(-8, 9, (int(rng.integers(3, 9)), 2))
        vertices += ring(f"p{k}", 1, xy)
        if k % 3 == 0:
            vertices += ring(f"p{k}", 2, rng.integers(-8, 9, (4, 2)))
    grid = np.array([(x / 2, y / 2) for x in range(-20, 21) for y in range(-20, 21)])
    assert found(spark, vertices, grid, most_edges=most) == even_odd(vertices, grid)


def star(n, around=(5.5, 7.25), radius=30.0):
    """A closed line of n edges that swings in and out."""
    t = np.arange(n) * (2 * math.pi / n)
    r = radius * (0.7 + 0.3 * np.sin(37 * t))
    return np.column_stack([around[0] + r * np.cos(t), around[1] + r * np.sin(t)])


def test_a_polygon_of_100000_edges_and_points_in_one_degree(spark):
    n = 100_000
    xy = star(n)
    inner = star(500, radius=0.3)
    vertices = ring("big", 1, xy) + ring("big", 2, inner[::-1]) + ring("far", 1, star(40, (80.0, 0.0), 3.0))
    rng = np.random.default_rng(3)
    # Within one degree around a place on the outline, and some by its very vertices.
    near = xy[1234] + rng.uniform(-0.5, 0.5, (1500, 2))
    points = np.vstack([near, xy[:200] + 1e-9, [(5.5, 7.25), (6.5, 7.25), (80.0, 0.0), (-70.0, 0.0)]])
    frame = spark.createDataFrame(vertices, VERTICES)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], POINTS)
    got = {r.id: r.polyname for r in points_in_polygons(rows, frame).collect()}
    want = even_odd(vertices, points)
    assert {i: [v] if v else [] for i, v in got.items()} == want
    assert {0, 1} <= {len(v) for v in want.values()} and want[len(points) - 4] == []
    tree = build_tree(polygon_edges(frame, "polyname"), "polyname")
    largest = max(
        t.select(F.aggregate("inside", F.lit(0), lambda a, p: a + F.size(p["edges"])).alias("n")).agg(F.max("n")).first()[0] or 0
        for _, t in tree.levels)
    assert largest <= EDGES
    kinds = [t.where("NOT split").select(F.explode("inside").alias("p")).select(
        (F.size("p.edges") == 0).alias("whole")).groupBy("whole").count().collect() for _, t in tree.levels]
    # Most of the inside is covered by cells that test nothing.
    assert sum(r["count"] for k in kinds for r in k if r.whole) > 0


def test_points_are_kept_whatever_they_are(spark):
    square = spark.createDataFrame(ring("s", 1, [(0, 0), (2, 0), (2, 2), (0, 2)]), VERTICES)
    points = spark.createDataFrame(
        [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1e300, -1e300),
         (5, float("inf"), 0.0), (6, 5.0, 1.0)], POINTS)
    names = spark.createDataFrame([("s", 7, "x")], "polyname string, code int, lon2 string")
    got = sorted((r.id, r.polyname, r.code) for r in points_in_polygons(points, square, names=names).collect())
    assert got == [(1, "s", 7), (1, "s", 7)] + [(k, None, None) for k in (2, 3, 4, 5, 6)]
    none = points_in_polygons(points, square.limit(0), names=names)
    assert none.columns == ["id", "lon", "lat", "polyname", "code", "lon2"] and none.where("polyname IS NULL").count() == 7
    assert points_in_polygons(points.limit(0), square).count() == 0


def test_a_hot_place_is_no_hot_key(spark):
    """Points outside all polygons have keys of their own, spread out."""
    square = spark.createDataFrame(ring("s", 1, [(0, 0), (2, 0), (2, 2), (0, 2)]), VERTICES)
    points = spark.range(1000).select("id", (F.col("id") + 10.0).alias("lon"), F.lit(50.0).alias("lat"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = points_in_polygons(points, square)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.where("polyname IS NULL").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(_qkey" in plan and "NestedLoop" not in plan
