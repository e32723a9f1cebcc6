import numpy as np
import pytest

from hinterland.operators.aggregates import ratio_range
from hinterland.operators.posterior import (
    Margin, fit_labels, margin_mult, margin_quad, margin_tables, posterior_terms,
    regression_table,
)


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(4).normal([0.5, -0.03, 0.2, 0.01], 0.2, (400, 4))


@pytest.fixture(scope="module")
def draws(spark, matrix):
    rows = [(f, i, [float(v) * s for v in b]) for f, s in (("one", 1.0), ("two", -1.0))
            for i, b in enumerate(matrix)]
    return spark.createDataFrame(rows, "fit string, draw int, beta array<double>")


def test_terms(draws, matrix):
    got = {(r["fit"], r["term"]): r for r in posterior_terms(
        draws, ["dl", "dl_sq", "ul"], drop="_sq$", digits=None).collect()}
    assert {t for _, t in got} == {"dl", "ul", "beta[4]"}
    row = got["one", "ul"]
    assert row["estimate"] == pytest.approx(matrix[:, 2].mean())
    assert [row["lo"], row["hi"]] == pytest.approx(list(np.quantile(matrix[:, 2], [0.025, 0.975])))


@pytest.mark.parametrize("ci", [95, 80])
def test_margin(draws, matrix, ci):
    tail = (1 - ci / 100) / 2
    rows = margin_quad(draws, 0, 1, [0.0, 2.5, 10.0], ci).where("fit = 'one'").collect()
    assert sorted(r["x"] for r in rows) == [1.0, 3.5, 11.0]
    for r in rows:
        e = matrix[:, 0] + 2 * matrix[:, 1] * (r["x"] - 1)
        assert [r["lo_ci"], r["med"], r["hi_ci"]] == pytest.approx(
            list(np.quantile(e, [tail, 0.5, 1 - tail])))
        assert (r["mean"], r["gt0"]) == pytest.approx((e.mean(), (e > 0).mean()))


def test_paired_margin(spark, draws, matrix):
    speeds = spark.createDataFrame([(2.0, 1.0), (8.0, 2.0)], "d double, u double")
    pairs = ratio_range(speeds, "u", "d", [0.0, 5.0, 10.0])
    y = {r["x"]: r["y"] for r in pairs.collect()}
    assert y == pytest.approx({0.0: 0.0, 5.0: 1.875, 10.0: 2.5})
    for r in margin_mult(draws, (0, 1), (2, 3), pairs).where("fit = 'one'").collect():
        x = r["x"] - 1
        e = matrix @ np.array([1, 2 * x, 1, 2 * y[x]])
        assert r["med"] == pytest.approx(np.median(e))


def test_many_margins_equal_single_ones(draws):
    grid = [0.0, 1.0]
    many = margin_tables(draws, [Margin("one", "dl", 0, 1), Margin("two", "ul", 2, 3)], grid)
    got = {(r["fit"], r["type"], r["x"]): r["med"] for r in many.collect()}
    one = {r["x"]: r["med"] for r in margin_quad(draws, 0, 1, grid).where("fit='one'").collect()}
    two = {r["x"]: r["med"] for r in margin_quad(draws, 2, 3, grid).where("fit='two'").collect()}
    assert got == pytest.approx({**{("one", "dl", x): v for x, v in one.items()},
                                 **{("two", "ul", x): v for x, v in two.items()}})


def test_table_order_and_counts(spark, draws):
    named = fit_labels(draws, {"one": "normal", "two": "beta"})
    summary = posterior_terms(named, ["alpha", "dl", "dl_sq", "ul"], digits=None)
    counts = spark.createDataFrame([(12, 36)], "unique long, N long")
    rows = regression_table(summary, ["normal", "beta"], ["dl", "dl_sq", "alpha"], counts)
    rows = rows.orderBy("ord", "stat").collect()
    assert [r["term"] for r in rows] == ["dl"] * 2 + ["dl_sq"] * 2 + ["alpha"] * 2 + ["unique", "N"]
    assert rows[1]["normal"].startswith("[") and rows[-1]["beta"] == "36"


def test_other_columns_follow_the_slopes_and_the_intercept_comes_last(spark):
    draws = spark.createDataFrame(
        [("sl", [1.0, 2.0], None, 0.5, 3.0), ("sl", [3.0, 4.0], None, 1.5, 5.0),
         ("vi", [1.0], [7.0, 8.0], 0.5, None)],
        "fit string, beta array<double>, gamma array<double>, sigma double, alpha double")
    got = posterior_terms(draws, ["dl"], also=["gamma", "sigma", "alpha"]).orderBy("fit", "pos").collect()
    assert [(r.fit, r.pos, r.term, r.estimate) for r in got] == [
        ("sl", 0, "dl", 2.0), ("sl", 1, "beta[2]", 3.0), ("sl", 2, "sigma", 1.0), ("sl", 3, "alpha", 4.0),
        ("vi", 0, "dl", 1.0), ("vi", 1, "gamma[1]", 7.0), ("vi", 2, "gamma[2]", 8.0), ("vi", 3, "sigma", 0.5)]
