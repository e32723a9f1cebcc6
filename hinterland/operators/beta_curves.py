"""Beta likelihoods of many rows, through polynomials of the linear predictor.

At a given phi all that a row's likelihood, score and expected information need are a few functions of
its linear predictor, next to its outcome's logit. They are analytic within pi of the real line,
so that on an interval a Chebyshev polynomial of low degree has them to about 1e-13. Its basis is
made once for a row and serves all of these functions.
"""

from __future__ import annotations

import numpy as np

from hinterland.functions.special import digamma, lgamma, trigamma

HALVES = (0.25, 0.5, 1.0, 2.0, 4.0)  # half widths of the intervals
WIDEST = 20.0  # linear predictors beyond it are met one by one
FEWEST = 48  # rows worth a polynomial
_MU, _SLOPE, _PART, _SCORE, _PHI, _ETA, _MIX, _PHI2 = range(8)


def _functions(eta: np.ndarray, phi: float) -> np.ndarray:
    """The functions of the linear predictor, one row each."""
    mu = np.clip(1.0 / (1.0 + np.exp(-eta)), 1e-12, 1 - 1e-12)
    slope = mu * (1.0 - mu)
    a, b = mu * phi, (1.0 - mu) * phi
    da, db, ta, tb = digamma(a), digamma(b), trigamma(a), trigamma(b)
    one = np.full(1, phi)
    return np.stack([
        mu, phi * slope, lgamma(one) - lgamma(a) - lgamma(b), -phi * slope * (da - db),
        phi * (digamma(one) - mu * da - (1 - mu) * db), (phi * slope) ** 2 * (ta + tb),
        phi * phi * slope * (mu * ta - (1 - mu) * tb),
        phi**2 * (mu**2 * ta + (1 - mu) ** 2 * tb - trigamma(one))])


def _likelihood(eta: np.ndarray, phi: float) -> np.ndarray:
    """Of these functions the mean and the part of the log likelihood without the outcome."""
    mu = np.clip(1.0 / (1.0 + np.exp(-eta)), 1e-12, 1 - 1e-12)
    return np.stack([mu, lgamma(np.full(1, phi)) - lgamma(mu * phi) - lgamma((1.0 - mu) * phi)])


class Interval:
    """Chebyshev polynomials on ``[mid - half, mid + half]``."""

    def __init__(self, mid: float, half: float) -> None:
        self.mid, self.half = mid, half
        reach = np.pi / half
        self.size = n = int(np.ceil(30.0 / np.log(reach + np.hypot(reach, 1.0)))) + 3
        angles = (np.arange(n) + 0.5) * np.pi / n
        self.nodes = mid + half * np.cos(angles)
        #: Values at the nodes times this are coefficients.
        self.fit = 2.0 / n * np.cos(np.outer(angles, np.arange(n)))
        self.fit[:, 0] /= 2.0

    def basis(self, eta: np.ndarray) -> np.ndarray:
        """The polynomials at ``eta``, one row each."""
        out = np.empty((self.size, len(eta)))
        out[0] = 1.0
        np.multiply(eta - self.mid, 1.0 / self.half, out=out[1])
        twice = 2.0 * out[1]
        for m in range(2, self.size):
            np.multiply(twice, out[m - 1], out=out[m])
            np.subtract(out[m], out[m - 2], out=out[m])
        return out


class Outcomes:
    """Logits and logs of a run of outcomes, and their sums over runs that start at ``starts``."""

    def __init__(self, y: np.ndarray, starts: np.ndarray | None = None) -> None:
        low, self.high = np.log(y), np.log1p(-y)
        self.logit, self.logs = low - self.high, low + self.high
        self.starts = np.zeros(1, np.int64) if starts is None else starts

    def fixed(self, phi: float) -> np.ndarray:
        """What the log likelihood has beside its functions of the linear predictor, a row."""
        return phi * self.high - self.logs


class BetaCurves:
    """Rows of a beta regression at one phi. Polynomials are made as intervals come up."""

    def __init__(self, phi: float) -> None:
        self.phi = phi
        self._known: dict[tuple[float, float], tuple[Interval, np.ndarray]] = {}

    def _interval(self, mid: float, half: float) -> tuple[Interval, np.ndarray]:
        if (mid, half) not in self._known:
            on = Interval(mid, half)
            self._known[mid, half] = on, _functions(on.nodes, self.phi) @ on.fit
        return self._known[mid, half]

    def _pieces(self, eta: np.ndarray):
        """Rows by interval: ``(rows, interval, coefficients)``, the last two None for those met
        one by one. All rows are one piece if an interval holds them."""
        if not len(eta):
            return []
        lo, hi = float(eta.min()), float(eta.max())
        if len(eta) >= FEWEST and -WIDEST < lo and hi < WIDEST:
            for half in HALVES:
                mid = round((lo + hi) / half) * half / 2.0
                if max(mid - lo, hi - mid) <= half:
                    return [(slice(None), *self._interval(mid, half))]
        wide = HALVES[-1]
        place = np.where(np.abs(eta) < WIDEST, np.floor(eta / (2 * wide)), np.nan)
        out, alone = [], ~np.isfinite(place)
        for k in np.unique(place[~alone]):
            rows = place == k
            if rows.sum() >= FEWEST:
                out.append((np.flatnonzero(rows), *self._interval((2 * k + 1) * wide, wide)))
            else:
                alone |= rows
        return [*out, (np.flatnonzero(alone), None, None)] if alone.any() else out

    def scores(self, eta: np.ndarray, y: Outcomes):
        """Sum of log likelihoods, scores and expected information in (eta, log phi): sums of what
        is only wanted as a sum, arrays of the rest, ``(loglik, g_eta, g_phi, h_eta, h_mix, h_phi)``."""
        g_eta, h_eta, h_mix = np.empty((3, len(eta)))
        loglik, g_phi, h_phi = y.fixed(self.phi).sum(), self.phi * y.high.sum(), 0.0
        for rows, on, coefs in self._pieces(eta):
            logit = y.logit[rows]
            if on is None:
                f = _functions(eta[rows], self.phi)
                both = self.phi * (f[_MU] @ logit)
                overall = f.sum(axis=1)
                slope, score, one, mix = f[[_SLOPE, _SCORE, _ETA, _MIX]]
            else:
                basis = on.basis(eta[rows])
                both = self.phi * (coefs[_MU] @ (basis @ logit))
                overall = coefs @ basis.sum(axis=1)
                slope, score, one, mix = coefs[[_SLOPE, _SCORE, _ETA, _MIX]] @ basis
            loglik += overall[_PART] + both
            g_phi += overall[_PHI] + both
            h_phi += overall[_PHI2]
            g_eta[rows] = slope * logit + score
            h_eta[rows], h_mix[rows] = one, mix
        return loglik, g_eta, g_phi, h_eta, h_mix, h_phi

    def logliks(self, eta: np.ndarray, y: Outcomes) -> np.ndarray:
        """Log likelihood of each row."""
        out = y.fixed(self.phi)
        for rows, on, coefs in self._pieces(eta):
            mu, part = (_likelihood(eta[rows], self.phi) if on is None
                        else coefs[[_MU, _PART]] @ on.basis(eta[rows]))
            out[rows] += self.phi * mu * y.logit[rows] + part
        return out

    def shifted(self, eta: np.ndarray, y: Outcomes, shifts: np.ndarray) -> np.ndarray:
        """Log likelihoods summed over each run, with its linear predictors moved by each of its
        ``shifts`` (runs x places).

        Long runs are summed once as polynomials, of which the moved functions take new
        coefficients; short ones are met once for every place.
        """
        pieces = self._pieces(eta)
        lengths = np.diff(np.r_[y.starts, len(eta)])
        if len(pieces) == 1 and pieces[0][1] is not None and np.abs(shifts).max() < 4.0 and (
                len(eta) > 2 * len(shifts) * pieces[0][1].size):
            on = pieces[0][1]
            basis = on.basis(eta)
            alone = np.add.reduceat(basis, y.starts, axis=1)
            basis *= y.logit
            along = np.add.reduceat(basis, y.starts, axis=1)
            mu, part = _likelihood(on.nodes + shifts[:, :, None], self.phi) @ on.fit
            fixed = np.add.reduceat(y.fixed(self.phi), y.starts)
            return np.einsum("rpm,mr->rp", part, alone) + self.phi * np.einsum("rpm,mr->rp", mu, along) + fixed[:, None]
        return np.column_stack([
            np.add.reduceat(self.logliks(eta + np.repeat(s, lengths), y), y.starts) for s in shifts.T])
