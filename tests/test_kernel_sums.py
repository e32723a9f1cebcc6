"""Grids of far cells give the sums of their points, and what a task reads does not follow all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hinterland.operators import kernel_sums as ks
from hinterland.operators.distance import arc_terms, popdist_weighted_mean


def unit(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def weights(x, y, decay):
    chord = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    return np.maximum(2 * 6378137.0 * np.arcsin(np.minimum(chord / 2, 1)), 1.0) ** -decay


@pytest.mark.parametrize("size", [1e-3, 0.5, 12.0])
@pytest.mark.parametrize("decay", [1.0, 2.0, 3.5])
def test_grid_charges_stand_for_the_points_of_a_far_cell(size, decay):
    rng = np.random.default_rng(4)
    y = unit(rng.uniform(10, 10 + size, 900), rng.uniform(50, 50 + size, 900))
    charge = rng.uniform(-1, 3, (900, 2))
    grid = ks.on_grid(np.hstack([y, charge]))
    radius = np.sqrt((((y.max(axis=0) - y.min(axis=0)) / 2) ** 2).sum())
    x = unit(rng.uniform(-180, 180, 4000), np.degrees(np.arcsin(rng.uniform(-1, 1, 4000))))
    x = np.vstack([x, unit(10 + size * rng.uniform(-6, 7, 4000), 50 + size * rng.uniform(-6, 7, 4000))])
    gap = [np.sqrt((np.maximum(np.maximum(s * y.min(axis=0) - x, x - s * y.max(axis=0)) if s > 0 else
                               np.maximum(-y.max(axis=0) - x, x + y.min(axis=0)), 0) ** 2).sum(axis=1)) for s in (1, -1)]
    x = x[(gap[0] >= ks.SEPARATION * radius) & (gap[1] >= ks.SEPARATION * radius)]
    assert len(x) > 1000
    near = weights(x, y, decay)
    error = np.abs(weights(x, grid[:, :3], decay) @ grid[:, 3:] - near @ charge) / (near @ np.abs(charge))
    assert error.max() < 1e-10


@pytest.mark.parametrize(("decay", "most"), [(2.0, 65_536), (1.0, 300)])
def test_sums_through_cells_equal_all_pairs(spark, monkeypatch, decay, most):
    """Half of the areas lie in one town; ``most`` also cuts the trees into several tiers."""
    monkeypatch.setattr(ks, "TREE_POINTS", most)
    rng = np.random.default_rng(9)
    n, m = 500, 6000
    town = rng.random(m) < 0.5
    y = pd.DataFrame({"g": rng.integers(0, 2, m), "lon": np.where(town, -90 + rng.normal(0, 1e-3, m), rng.uniform(-180, 180, m)),
                      "lat": np.where(town, 40 + rng.normal(0, 1e-3, m), rng.uniform(-89, 89, m)),
                      "pop": rng.integers(1, 500, m), "m": rng.normal(0, 5, m)})
    x = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 2, n), "lon": rng.uniform(-180, 180, n), "lat": rng.uniform(-89, 89, n)})
    x.loc[:99, "lon"], x.loc[:99, "lat"] = -90 + rng.normal(0, 1e-3, 100), 40 + rng.normal(0, 1e-3, 100)
    got = {r.id: r.w_m for r in popdist_weighted_mean(
        spark.createDataFrame(x), spark.createDataFrame(y), ["m"], "id", by=["g"], decay=decay, prefix="w_",
        x_block=20, y_block=30).collect()}
    assert len(got) == n
    for g in (0, 1):
        a, b = x[x.g == g], y[y.g == g]
        w = weights(unit(a.lon, a.lat), unit(b.lon, b.lat), decay) * b["pop"].to_numpy()
        want = (w @ b.m.to_numpy()) / w.sum(axis=1)
        spread = (w @ np.abs(b.m.to_numpy())) / w.sum(axis=1)
        assert max(abs(got[i] - v) / s for i, v, s in zip(a.id, want, spread)) < 1e-9


def test_a_block_meets_fewer_points_than_there_are(spark, monkeypatch):
    met = []
    rng = np.random.default_rng(2)
    y = spark.createDataFrame(pd.DataFrame({"lon": rng.uniform(-120, -75, 20000), "lat": rng.uniform(25, 49, 20000), "pop": 1, "m": 1.0}))
    x = spark.createDataFrame([(1, -100.0, 40.0), (2, -100.1, 40.0)], "id int, lon double, lat double")
    kept = ks.stored
    monkeypatch.setattr(ks, "stored", lambda df: met.append(kept(df)) or met[-1])
    assert popdist_weighted_mean(x, y, ["m"], "id", y_block=32).count() == 2
    uses = met[-1].where(F.col("stub").isNull()).count()
    # All points would be 20000 / 32 cells; the tree gives a few a level.
    assert 0 < uses < 400


def test_the_squared_arc_is_a_short_series():
    chord = np.array([0.0, 1e-14, 1e-6, 0.01, 0.3, 0.9])
    for most, longest in ((1e-14, 2), (0.01, 7), (0.3, 14), (0.9, 20)):
        terms = arc_terms(most)
        assert terms is None or len(terms) <= longest
        q = chord[chord <= most]
        if terms is not None:
            got = sum(c * q ** (n + 1) for n, c in enumerate(terms))
            assert got == pytest.approx((2 * np.arcsin(np.sqrt(q) / 2)) ** 2, rel=1e-14, abs=1e-40)
    assert arc_terms(0.3) and arc_terms(4.0) is None


@pytest.mark.parametrize("decay", [1.0, 2.0, 3.5])
def test_weights_hold_at_all_distances(spark, decay):
    """Places at the floor, near ones by the series, and the other end of the globe."""
    lon = [0.0, 1e-6, 1e-3, 0.5, 20.0, 90.0, 179.0, -179.9]
    y = pd.DataFrame({"lon": lon, "lat": [0.0] * len(lon), "pop": 1, "m": np.arange(8.0) ** 2})
    got = popdist_weighted_mean(spark.createDataFrame([(1, 2e-6, 0.0)], "id int, lon double, lat double"),
                                spark.createDataFrame(y), ["m"], "id", decay=decay, prefix="w_").first().w_m
    w = weights(unit(np.array([2e-6]), np.array([0.0])), unit(y.lon.to_numpy(), y.lat.to_numpy()), decay)[0]
    assert got == pytest.approx(w @ y.m / w.sum(), rel=1e-9)


def test_a_block_meets_few_points_with_the_usual_sizes(spark, monkeypatch):
    met = []
    rng = np.random.default_rng(2)
    y = spark.createDataFrame(pd.DataFrame({"lon": rng.uniform(-120, -75, 40000), "lat": rng.uniform(25, 49, 40000), "pop": 1, "m": 1.0}))
    x = spark.createDataFrame([(1, -100.0, 40.0), (2, -100.1, 40.0)], "id int, lon double, lat double")
    kept = ks.stored
    monkeypatch.setattr(ks, "stored", lambda df: met.append(kept(df)) or met[-1])
    assert popdist_weighted_mean(x, y, ["m"], "id").count() == 2
    _, tree, hits = met
    points = hits.join(tree, ["root", "node"]).agg(F.sum(F.size("data")) / 5).first()[0]
    # 36,144 when cells of up to 1,024 areas were met one by one.
    assert 0 < points < 30000
