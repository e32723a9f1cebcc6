"""Second and third levels: regions eliminated like groups, sigma with a posterior of its own,
and passes that do not grow with the number of fits."""

import numpy as np
import pandas as pd
import pytest

from hinterland.operators import beta_models
from hinterland.operators.beta_models import fit_beta_batch, fit_varying_beta, fit_varying_beta_batch, outside_interval
from hinterland.operators.normal_models import fit_varying_normal, group_level


def normal_world(seed, groups, regions, rows):
    rng = np.random.default_rng(seed)
    region = np.r_[np.arange(regions), rng.integers(0, regions, groups - regions)]
    u, z = 2.0 * rng.normal(size=regions), rng.normal(size=groups)
    a = 0.5 * z + u[region] + 0.6 * rng.normal(size=groups)
    g = np.r_[np.arange(groups), rng.integers(0, groups, rows - groups)]
    x = rng.normal(size=(rows, 2)) + np.array([3.0, -1.0])
    y = a[g] + x @ [0.3, -0.7] + 0.8 * rng.normal(size=rows)
    return g, x, y, z, region, u


def normal_frames(spark, world):
    g, x, y, z, region, _ = world
    design = spark.createDataFrame(pd.DataFrame({"g": g, "y": y, "x": x.tolist()}), "g long, y double, x array<double>")
    table = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(z)), "z": z, "region": region}))
    return design, group_level(table, "g", ["z"], "region")


def dense_posterior(world):
    """Means and deviations of (slopes, second-level slope, region effects, log sigma, log ratio)
    over a grid of both variances, with all effects of the levels above the group written out."""
    g, x, y, z, region, u = world
    J, R, n = len(z), len(u), len(y)
    xc = x - x.mean(axis=0)
    w = np.column_stack([z - z.mean(), np.eye(R)[region]])
    full = np.column_stack([xc, w[g]])
    count = np.bincount(g, minlength=J)
    sums = np.column_stack([np.bincount(g, c, minlength=J) for c in full.T])
    ysum = np.bincount(g, y, minlength=J)
    a0, b0, q0 = full.T @ full, full.T @ y, y @ y
    prior = np.diag([0.0] * 3 + [1 / 25] * R)
    logs, means, covs, places = [], [], [], []
    for lr in np.linspace(np.log(0.02), np.log(8), 45):
        rho = np.exp(lr)
        h = rho / (1 + count * rho)
        a, b, q = a0 - (sums * h[:, None]).T @ sums, b0 - sums.T @ (h * ysum), q0 - (h * ysum) @ ysum
        for ls in np.linspace(np.log(0.8) - 5 / np.sqrt(2 * n), np.log(0.8) + 5 / np.sqrt(2 * n), 41):
            s2 = np.exp(2 * ls)
            p = a / s2 + prior
            mu = np.linalg.solve(p, b / s2)
            logs.append(-n * ls - 0.5 * np.log1p(count * rho).sum() - 0.5 * (q / s2 - mu @ (b / s2))
                        - 0.5 * np.linalg.slogdet(p)[1] + 2 * ls + 0.5 * lr)
            means.append(mu)
            covs.append(np.diag(np.linalg.inv(p)))
            places.append((ls, lr))
    wt = np.exp(np.array(logs) - max(logs))
    wt /= wt.sum()
    means, places = np.array(means), np.array(places)
    mean = wt @ means
    return mean, np.sqrt(wt @ (np.array(covs) + (means - mean) ** 2)), wt @ places


def test_nested_elimination_equals_the_dense_posterior(spark):
    world = normal_world(1, 60, 9, 1500)
    design, second = normal_frames(spark, world)
    fit = fit_varying_normal(design, ["a", "b"], "g", second, draws=2000, chains=2)
    mean, sd, places = dense_posterior(world)
    got = np.r_[fit.mean["beta"], fit.mean["gamma"],
                [r.a for r in fit.region_means.orderBy("region_index").collect()]]
    assert np.abs(got - mean).max() < 0.01 * sd.min()
    rows = fit.draws.collect()
    drawn = np.array([[*r.beta, *r.gamma, *r.a_region] for r in rows])
    assert drawn.shape == (4000, 12)
    assert np.abs(drawn.mean(axis=0) - mean).max() < 4 * sd.max() / np.sqrt(4000)
    assert drawn.std(axis=0) == pytest.approx(sd, rel=0.08)
    ls = np.log([r.sigma for r in rows])
    lr = 2 * np.log([r.sigma_a / r.sigma for r in rows])
    assert ls.mean() == pytest.approx(places[0], abs=0.003) and lr.mean() == pytest.approx(places[1], abs=0.05)


def rows_to_driver(monkeypatch, run):
    held = []

    from pyspark.sql.classic.dataframe import DataFrame as Classic
    monkeypatch.setattr(Classic, "collect", lambda self, old=Classic.collect: _kept(held, old(self)))
    out = run()
    monkeypatch.undo()
    return out, sum(held)


def _kept(held, rows):
    held.append(sum(len(r) for r in rows))
    return rows


def test_ten_thousand_regions_leave_the_driver_alone(spark, monkeypatch):
    small, large = normal_world(2, 90, 30, 2000), normal_world(3, 20_000, 10_000, 60_000)
    counts = []
    for world in (small, large):
        design, second = normal_frames(spark, world)
        fit, held = rows_to_driver(monkeypatch, lambda: fit_varying_normal(
            design, ["a", "b"], "g", second, draws=20, chains=1))
        counts.append(held)
    # Few nodes of sigma more or less, but nothing for each of the regions.
    assert counts[1] < 2 * counts[0]
    assert second.n_regions == 10_000
    assert fit.mean["beta"] == pytest.approx([0.3, -0.7], abs=0.02)
    assert fit.mean["gamma"] == pytest.approx([0.5], abs=0.05)
    u = np.array([r.a for r in fit.region_means.orderBy("region_index").collect()])
    assert len(u) == 10_000 and np.corrcoef(u, large[5])[0, 1] > 0.95
    assert len(fit.draws.first().a_region) == 10_000


def beta_world(seed, groups, each, sigma, phi=30.0):
    rng = np.random.default_rng(seed)
    region, z = rng.integers(0, 2, groups), rng.normal(size=groups)
    region[:2] = 0, 1
    a = 0.4 * z + np.array([-0.3, 0.5])[region] + sigma * rng.normal(size=groups)
    g = np.repeat(np.arange(groups), each)
    x = rng.normal(size=(len(g), 3))
    mu = 1 / (1 + np.exp(-(a[g] + x @ [0.4, -0.2, 0.0])))
    return g, x, rng.beta(phi * mu, phi * (1 - mu)), z, region, a


def beta_frames(spark, world):
    g, x, y, z, region, _ = world
    design = spark.createDataFrame(pd.DataFrame({"g": g, "y": y, "x": x.tolist()}), "g long, y double, x array<double>")
    table = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(z)), "z": z, "region": region}))
    return design, group_level(table, "g", ["z"], "region")


def test_sigma_of_a_varying_beta_fit_has_its_posterior(spark):
    """With many rows a group the intercepts are all but known, and then sigma^2 is inverse gamma."""
    world = beta_world(4, 24, 400, 0.5)
    design, second = beta_frames(spark, world)
    fit = fit_varying_beta(design, ["a", "b", "c"], "g", second, draws=3000, chains=1)
    w = np.column_stack([world[3], np.eye(2)[world[4]]])
    rest = np.linalg.lstsq(w, world[5])[1][0]
    sigma = np.sqrt(rest / 2 / np.random.default_rng(0).gamma((24 - 3 - 1) / 2, size=200_000))
    drawn = np.array([r.sigma_a for r in fit.draws.collect()])
    assert drawn.std() > 0.02
    for q in (0.025, 0.25, 0.5, 0.75, 0.975):
        assert np.quantile(drawn, q) == pytest.approx(np.quantile(sigma, q), rel=0.06)
    assert fit.sigma == pytest.approx(fit.sigmas[fit.weights.argmax()]) and fit.groups == 24
    assert fit.beta == pytest.approx([0.4, -0.2, 0.0], abs=0.02) and fit.phi == pytest.approx(30, rel=0.05)


@pytest.mark.parametrize("seed", range(3))
def test_sigma_interval_covers_the_truth_with_few_rows_a_group(spark, seed):
    design, second = beta_frames(spark, beta_world(10 + seed, 40, 15, 0.4, 8.0))
    fit = fit_varying_beta(design, ["a", "b", "c"], "g", second, draws=800, chains=1)
    drawn = np.array([r.sigma_a for r in fit.draws.collect()])
    lo, hi = np.quantile(drawn, [0.005, 0.995])
    assert lo < 0.4 < hi and hi / lo > 1.3


def test_a_batch_gives_each_fit_its_own_and_no_more_passes(spark, monkeypatch):
    design, second = beta_frames(spark, beta_world(5, 20, 40, 0.4))
    names = ["a", "b", "c"]
    passes = []
    real = beta_models._VaryingBatch.sums
    monkeypatch.setattr(beta_models._VaryingBatch, "sums", lambda *a: passes.append(1) or real(*a))
    alone = fit_varying_beta(design, names, "g", second, "one", draws=50, chains=1)
    single = len(passes)
    some = {"one": [0, 1, 2], "two": [0], "three": [2, 0]}
    found = fit_varying_beta_batch(design, names, some, "g", second, draws=50, chains=1)
    assert len(passes) - single <= single + 3
    assert found["one"].beta == pytest.approx(alone.beta, abs=1e-4)
    assert found["one"].sigma == pytest.approx(alone.sigma, rel=0.02)
    assert [len(f.beta) for f in found.values()] == [3, 1, 2] and found["three"].names == ["c", "a"]

    calls = []
    real_sums = beta_models.score_sums
    monkeypatch.setattr(beta_models, "score_sums", lambda *a: calls.append(1) or real_sums(*a))
    one = fit_beta_batch(design, names, {"one": [0, 1, 2]}, draws=10)["one"]
    alone_calls = len(calls)
    many = fit_beta_batch(design, names, {**some, **{f"m{i}": [0, 1] for i in range(9)}}, draws=10)
    assert len(calls) - alone_calls <= alone_calls + 3
    assert many["one"].beta == pytest.approx(one.beta, abs=1e-8) and len(many) == 12


def test_outcomes_outside_the_interval_are_counted(spark):
    rows = spark.createDataFrame([(v, [1.0]) for v in (0.0, 0.5, 1.0, 1.0, -2.0, None)], "y double, x array<double>")
    assert tuple(outside_interval(rows).first()) == (2, 2)
