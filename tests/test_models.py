import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hinterland.functions.special import digamma, lgamma, trigamma
from hinterland.operators.beta_models import fit_beta, fit_varying_beta
from hinterland.operators.design import (
    cholesky_r, design_matrix, gram, moments, sizes, square_terms,
)
from hinterland.operators.normal_models import (
    fit_normal, fit_varying_normal, group_level, group_stats,
)
from hinterland.plans.models import FitSpec, fit_grid

J, R, N = 30, 3, 1500


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    region, z = rng.integers(0, R, J), rng.normal(size=J)
    region[:R] = range(R)
    a = 1.0 + 0.5 * z + 0.4 * region + 0.6 * rng.normal(size=J)
    st = rng.integers(0, J, N)
    st[: N // 3] = 0  # one group holds over a third of the rows
    x1, x2 = rng.uniform(2, 9, N), rng.normal(size=N)
    y = a[st] + 0.3 * x1 - 0.02 * x1**2 + 0.7 * x2 + 0.8 * rng.normal(size=N)
    mu = 1 / (1 + np.exp(-(0.5 * a[st] - 1 + 0.1 * x1 - 0.3 * x2)))
    share = rng.beta(12 * mu, 12 * (1 - mu))
    rows = pd.DataFrame({"st": st, "pdw2_download": x1, "x2": x2, "y": y, "share": share})
    return rows, pd.DataFrame({"st": range(J), "z": z, "region": region})


@pytest.fixture(scope="module")
def frames(spark, data):
    return spark.createDataFrame(data[0]), spark.createDataFrame(data[1])


def columns(rows):
    x = np.column_stack([rows.pdw2_download, rows.pdw2_download**2, rows.x2])
    return x, x - x.mean(axis=0)


def stack(draws, name):
    return np.array([r[name] for r in draws.select(name).collect()])


def test_gamma_family():
    import math

    x = np.array([0.05, 0.5, 1.0, 2.5, 40.0])
    assert lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-12)
    h = 1e-5
    assert digamma(x) == pytest.approx((lgamma(x + h) - lgamma(x - h)) / (2 * h), rel=1e-6)
    assert trigamma(x) == pytest.approx((digamma(x + h) - digamma(x - h)) / (2 * h), rel=1e-5)
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)


def test_design_and_moments(frames, data):
    rows, names = design_matrix(frames[0], "y", ["pdw2_download"], ["x2"], "st")
    assert names == ["pdw2_download", "pdw2_download_sq", "x2"]
    assert square_terms(["a", "b"]) == ["a", "a_sq", "b", "b_sq"]
    size = sizes(rows, "st").first()
    assert (size["N"], size["K"], size["J"]) == (N, 3, J)
    m = moments(rows, 3)
    x, xc = columns(data[0])
    raw = m.cross * np.outer(m.scale, m.scale)
    assert raw[:3, :3] == pytest.approx(xc.T @ xc, rel=1e-9)
    r = cholesky_r(m)
    assert r.T @ r * (N - 1) == pytest.approx(xc.T @ xc, rel=1e-8)
    assert np.abs(r) == pytest.approx(
        np.abs(np.linalg.qr(xc)[1]) / np.sqrt(N - 1), rel=1e-6, abs=1e-9)
    small = m.subset([0, 2])
    assert small.k == 2 and small.mean == pytest.approx([x[:, 0].mean(), x[:, 2].mean(),
                                                         data[0].y.mean()])


def test_incomplete_rows_are_dropped_and_constants_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None), (2.0, 2.0)],
                               "y double, m double")
    rows, names = design_matrix(df, "y", ["m"], [])
    assert rows.count() == 2
    with pytest.raises(ValueError):
        moments(rows, len(names))


def test_gram_both_ways(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 14))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(14)]))
    for k in (3, 14):
        names = [f"c{i}" for i in range(k)]
        got = {(r["i"], r["j"]): r["value"] for r in gram(df, names).collect()}
        assert len(got) == k * (k + 1) // 2
        for (i, j), v in got.items():
            assert v == pytest.approx(x[:, int(i[1:])] @ x[:, int(j[1:])])


def test_single_level_normal(frames, data):
    rows, names = design_matrix(frames[0], "y", ["pdw2_download"], ["x2"])
    fit = fit_normal(rows, names, draws=1000, chains=4)
    _, xc = columns(data[0])
    full = np.column_stack([np.ones(N), xc])
    ols, rss = np.linalg.lstsq(full, data[0].y.to_numpy(), rcond=None)[:2]
    assert fit.beta == pytest.approx(ols[1:], rel=1e-7) and fit.alpha == pytest.approx(ols[0])
    assert fit.sse == pytest.approx(rss[0])
    beta = stack(fit.draws, "beta")
    sd = np.sqrt(np.diag(np.linalg.inv(xc.T @ xc)) * rss[0] / (N - 5))
    assert beta.shape == (4000, 3)
    assert beta.mean(axis=0) == pytest.approx(ols[1:], abs=4 * sd.max() / 60)
    assert beta.std(axis=0) == pytest.approx(sd, rel=0.06)
    sigma2 = stack(fit.draws, "sigma") ** 2
    assert sigma2.mean() == pytest.approx(rss[0] / 2 / ((N - 5) / 2 - 1), rel=0.01)
    again = stack(fit_normal(rows, names).draws.orderBy("chain", "draw"), "beta")
    assert again == pytest.approx(stack(fit.draws.orderBy("chain", "draw"), "beta"))


def gibbs(rows, groups, steps=3000, seed=0):
    """Plain sampler of the same posterior, to compare with."""
    rng = np.random.default_rng(seed)
    _, xc = columns(rows)
    st, y = rows.st.to_numpy(), rows.y.to_numpy()
    w = np.column_stack([groups.z - groups.z.mean(), np.eye(R)[groups.region]])
    n = np.bincount(st, minlength=J)
    xx = xc.T @ xc
    half = np.linalg.cholesky(np.linalg.inv(xx))
    prior = np.diag([0.0] + [1 / 25] * R)
    b, d, s2, t2, out = np.zeros(3), np.zeros(1 + R), 1.0, 1.0, []
    for step in range(steps):
        prec = n / s2 + 1 / t2
        r = y - xc @ b
        a = (np.bincount(st, r, minlength=J) / s2 + w @ d / t2) / prec
        a = a + rng.normal(size=J) / np.sqrt(prec)
        b = np.linalg.solve(xx, xc.T @ (y - a[st])) + np.sqrt(s2) * half @ rng.normal(size=3)
        e = y - a[st] - xc @ b
        s2 = e @ e / 2 / rng.gamma((N - 1) / 2)
        c = np.linalg.inv(w.T @ w / t2 + prior)
        d = c @ (w.T @ a / t2) + np.linalg.cholesky(c) @ rng.normal(size=1 + R)
        u = a - w @ d
        t2 = u @ u / 2 / rng.gamma((J - 1) / 2)
        if step >= 300:
            out.append(np.r_[b, d, np.sqrt(s2), np.sqrt(t2), a])
    return np.array(out)


def test_varying_intercept_normal_equals_sampler(frames, data):
    rows, names = design_matrix(frames[0], "y", ["pdw2_download"], ["x2"], "st")
    second = group_level(frames[1], "st", ["z"], "region")
    fit = fit_varying_normal(rows, names, "st", second)
    assert (fit.n, fit.groups) == (N, J)
    assert sorted(map(tuple, fit.regions.collect())) == [(0, 0), (1, 1), (2, 2)]
    got = np.column_stack([
        stack(fit.draws.orderBy("chain", "draw"), c)
        for c in ("beta", "gamma", "a_region", "sigma", "sigma_a")
    ])
    want = gibbs(*data)
    spread = want[:, :9].std(axis=0)
    assert got.mean(axis=0) == pytest.approx(want[:, :9].mean(axis=0), abs=0.15 * spread.max())
    assert np.abs(got.mean(axis=0) - want[:, :9].mean(axis=0)).max() < 0.2 * spread.max()
    assert got.std(axis=0) == pytest.approx(spread, rel=0.15)
    u = {r["region"]: r["a"] for r in fit.region_means.collect()}
    assert [u[r] for r in range(R)] == pytest.approx(got[:, 4:7].mean(axis=0), abs=0.06)
    means = {r["st"]: np.mean(r["a"]) for r in fit.intercepts(300).collect()}
    assert [means[j] for j in range(J)] == pytest.approx(want[:, 9:].mean(axis=0), abs=0.1)


def test_known_moments_give_the_same_submodel(frames):
    rows, names = design_matrix(frames[0], "y", ["pdw2_download"], ["x2"], "st")
    second = group_level(frames[1], "st", ["z"], "region")
    narrow, short = design_matrix(frames[0], "y", ["pdw2_download"], [], "st")
    alone = fit_varying_normal(narrow, short, "st", second)
    shared = fit_varying_normal(
        rows, short, "st", second, known=moments(rows, 3).subset([0, 1]),
        stats=group_stats(rows, "st", 3), columns=[0, 1],
    )
    assert shared.mean["beta"] == pytest.approx(alone.mean["beta"], rel=1e-6)


def beta_loglik(theta, x, y):
    mu, phi = 1 / (1 + np.exp(-x @ theta[:-1])), np.exp(theta[-1])
    ll = (lgamma(np.full(len(y), phi)) - lgamma(mu * phi) - lgamma((1 - mu) * phi)
          + (mu * phi - 1) * np.log(y) + ((1 - mu) * phi - 1) * np.log1p(-y))
    return ll.sum() + theta[-1]


def test_single_level_beta_is_a_mode(frames, data):
    rows, names = design_matrix(frames[0], "share", ["pdw2_download"], ["x2"])
    fit = fit_beta(rows, names)
    _, xc = columns(data[0])
    x, y = np.column_stack([np.ones(N), xc]), data[0].share.to_numpy()
    theta = np.r_[fit.alpha, fit.beta, np.log(fit.phi)]
    best = beta_loglik(theta, x, y)
    for i in range(len(theta)):
        for sign in (-1, 1):
            moved = theta.copy()
            moved[i] += sign * 1e-3 * max(1e-2, abs(theta[i]))
            assert beta_loglik(moved, x, y) < best
    draws = stack(fit.draws, "beta")
    assert draws.mean(axis=0) == pytest.approx(fit.beta, abs=draws.std(axis=0).max() / 10)


def test_varying_intercept_beta_finds_the_effects(frames):
    rows, names = design_matrix(frames[0], "share", ["pdw2_download"], ["x2"], "st")
    second = group_level(frames[1], "st", ["z"], "region")
    fit = fit_varying_beta(rows, names, "st", second)
    sd = stack(fit.draws, "beta").std(axis=0)
    assert fit.beta[2] == pytest.approx(-0.3, abs=4 * sd[2])
    assert fit.beta[0] == pytest.approx(0.1, abs=4 * sd[0])
    assert fit.phi == pytest.approx(12, rel=0.15)
    assert fit.gamma[0] == pytest.approx(0.25, abs=0.25)
    assert 0.1 < fit.sigma < 0.6 and fit.groups == J
    assert fit.intercepts.count() == J


def test_grid_names_and_shapes(frames):
    wide = frames[0].withColumns({
        "pdw2_upload": F.col("pdw2_download") * 0.4 + F.rand(1),
        "pdw2_pcount": F.rand(2) * 5,
    })
    second = group_level(frames[1], "st", ["z"], "region")
    specs = [FitSpec("sl", "normal", "full", "all"), FitSpec("sl", "normal", "full", "upload"),
             FitSpec("vi", "normal", "full", "download"), FitSpec("sl", "beta", "full", "pcount")]
    out = fit_grid({"full": wide}, specs, {"normal": "y", "beta": "share"}, {"full": ["x2"]},
                   group="st", second={"full": second}, draws=50, chains=2)
    got = {r["fit"]: (r["n"], r["k"]) for r in out.groupBy("fit").agg(
        F.count("*").alias("n"), F.max(F.size("beta")).alias("k")).collect()}
    assert got == {"sl_normal_full_all": (100, 7), "sl_normal_full_upload": (100, 3),
                   "vi_normal_full_download": (100, 3), "sl_beta_full_pcount": (100, 3)}


def test_grid_query_has_all_fits_with_their_other_terms(spark, tables):
    from hinterland.catalogue import QUERIES
    from hinterland.plans.models import ALL_FITS

    terms = {}
    for r in QUERIES["fit_grid"](spark, tables).collect():
        assert r.lo <= r.estimate <= r.hi
        terms.setdefault(r.fit, []).append(r.term)
    assert set(terms) == {f.name for f in ALL_FITS}
    for f in ALL_FITS:
        slopes = (6 if f.measure == "all" else 2) + (5 if f.sample == "sens" else 3)
        own = terms[f.name]
        assert sum(t.startswith("beta[") for t in own) == slopes
        assert ("alpha" in own) == (f.model == "sl") and ("gamma[1]" in own) == (f.model == "vi")
        assert ("phi" in own) == (f.family == "beta") and ("a_region[1]" in own) == (f.model == "vi")
