"""Tall-skinny QR against exact arithmetic, where cross-products lose their digits."""

from decimal import Decimal, getcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinterland.operators import design
from hinterland.operators.design import cholesky_r, moments, thin_qr
from hinterland.operators.normal_models import fit_normal


def frame(spark, x, y, parts):
    rows = [(float(b), [float(v) for v in a]) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "y double, x array<double>").repartition(parts)


def exact_r(x):
    """R of the centred columns over sqrt(N-1), from rational cross-products."""
    getcontext().prec = 80
    n, cols = len(x), [[Fraction(float(v)) for v in c] for c in x.T]
    cols = [[v - sum(c) / n for v in c] for c in cols]
    k = len(cols)

    def decimal(f):
        return Decimal(f.numerator) / Decimal(f.denominator)

    g = [[decimal(sum(a * b for a, b in zip(cols[i], cols[j])) / (n - 1)) for j in range(k)] for i in range(k)]
    r = [[Decimal(0)] * k for _ in range(k)]
    for i in range(k):
        r[i][i] = (g[i][i] - sum(r[m][i] ** 2 for m in range(i))).sqrt()
        for j in range(i + 1, k):
            r[i][j] = (g[i][j] - sum(r[m][i] * r[m][j] for m in range(i))) / r[i][i]
    return np.array([[float(v) for v in row] for row in r])


@pytest.mark.parametrize("parts", [1, 7, 20])
def test_factor_equals_exact_arithmetic(spark, monkeypatch, parts):
    monkeypatch.setattr(design, "TREE_FAN", 3)
    monkeypatch.setattr(design, "TREE_ROWS", 32)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4)) * [1, 1e5, 1e-4, 3] + [0, 1e6, 5, 0]
    got = thin_qr(frame(spark, x, rng.standard_normal(300), parts), 4)
    np.testing.assert_allclose(got.factor(), exact_r(x), rtol=1e-9, atol=1e-14)
    np.testing.assert_allclose(got.subset([2, 0]).factor(), exact_r(x[:, [2, 0]]), rtol=1e-9, atol=1e-14)
    m = moments(frame(spark, x, rng.standard_normal(300), parts), 4)
    np.testing.assert_allclose(got.factor(), cholesky_r(m), rtol=1e-6, atol=1e-9)


def test_nearly_collinear_columns_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    t = np.linspace(0, 1, 1200)
    x = np.column_stack([t, t + 1e-6 * t * t])
    y = 3 * x[:, 0] + 0.25 * rng.standard_normal(1200)
    rows = frame(spark, x, y, 5)
    want = exact_r(x)
    got, old = thin_qr(rows, 2).factor(), cholesky_r(moments(rows, 2))
    assert got[0, 0] == pytest.approx(want[0, 0], rel=1e-12) and abs(got[1, 1] / want[1, 1] - 1) < 1e-8
    assert abs(old[1, 1] / want[1, 1] - 1) > 1e-5

    # Ten thousand times closer the cross-products are singular, the triangle isn't.
    near = np.column_stack([t, t + 1e-10 * t * t])
    close = frame(spark, near, y, 5)
    with pytest.raises((ValueError, np.linalg.LinAlgError)):
        m = moments(close, 2)
        m.require_full_rank()
        m.triangle().require_full_rank()
        assert abs(cholesky_r(m)[1, 1] / exact_r(near)[1, 1] - 1) < 1e-2, "wrong in silence"
        raise AssertionError("cross-products should be singular")
    assert abs(thin_qr(close, 2).factor()[1, 1] / exact_r(near)[1, 1] - 1) < 1e-4


def test_fit_of_x_and_its_square_far_from_zero(spark):
    """x around 5,000 next to x**2: slopes against least squares in exact arithmetic."""
    rng = np.random.default_rng(3)
    u = rng.random(500)
    x = np.column_stack([5000 + u, (5000 + u) ** 2])
    y = 2.0 * x[:, 0] - 1e-4 * x[:, 1] + rng.standard_normal(500)
    got = fit_normal(frame(spark, x, y, 4), ["a", "b"], draws=10, chains=1)
    full = np.column_stack([x, y])
    r = exact_r(full)
    want = np.linalg.solve(r[:2, :2], r[:2, 2])
    np.testing.assert_allclose(got.beta, want, rtol=1e-5)
    assert got.sse == pytest.approx(r[2, 2] ** 2 * 499, rel=1e-9)
    assert got.alpha == pytest.approx(y.mean())


def test_few_rows_constant_and_collinear_columns(spark):
    two = frame(spark, np.array([[1.0, 2.0], [3.0, 5.0]]), [1.0, 2.0], 2)
    assert not thin_qr(two, 2).condition < 1e13
    with pytest.raises(ValueError, match="constant"):
        thin_qr(frame(spark, np.array([[1.0], [1.0]]), [1.0, 2.0], 1), 1)
    with pytest.raises(ValueError, match="no complete"):
        thin_qr(two.where(F.lit(False)), 2)
    rng = np.random.default_rng(4)
    a = rng.standard_normal(50)
    with pytest.raises(ValueError, match="collinear"):
        thin_qr(frame(spark, np.column_stack([a, 2 * a]), a, 3), 2).require_full_rank()
