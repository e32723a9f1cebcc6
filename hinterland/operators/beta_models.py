"""Beta regressions by distributed Fisher scoring, many fits at once.

``y ~ beta(mu*phi, (1-mu)*phi)`` with a logit link. The rows are packed once into blocks, and each
step is one pass over the blocks that adds up scores and expected information of all fits of a
batch; the driver solves systems whose size depends on the number of columns only. Draws come
from normal approximations at the mode, with phi on the log scale; the standard deviation of
varying intercepts is drawn from its marginal posterior on a grid. They approximate the posterior
and are not Markov chain samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.operators.beta_curves import BetaCurves, Outcomes
from hinterland.operators.design import Moments, block_sums, matrix, moments, small_vector, vector
from hinterland.operators.normal_models import REGION_PRIOR_SD, GroupLevel, Weights, make_draws
from hinterland.sources.checkpoint import discard, stored

BLOCK_ROWS = 2048  # rows of a block at most
PASS_ROWS = 8192  # rows that a pass works on at once, at least, so that temporaries stay in cache


def open_interval(design: DataFrame) -> DataFrame:
    """Rows whose outcome lies strictly between 0 and 1, as the beta density needs."""
    return design.where((F.col("y") > 0) & (F.col("y") < 1))


def outside_interval(design: DataFrame) -> DataFrame:
    """``(low, high)``: how many outcomes a beta fit leaves out, at most 0 and at least 1."""
    return design.agg(
        F.count_if(F.col("y") <= 0).alias("low"), F.count_if(F.col("y") >= 1).alias("high"))


def packed_rows(design: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Rows ``(group, y, x)`` as stored blocks ``(group, n, y array, x array)`` of at most
    ``BLOCK_ROWS`` rows of one group, near each other by group. A group with most of the rows is
    many blocks in many files."""
    spread = F.xxhash64("y", "x")
    by = [group] if group else []
    rows = design.select(*by, F.col("y").cast("double").alias("y"), "x")
    rows = rows.repartitionByRange(*by, spread).sortWithinPartitions(*by) if group else rows
    key = f"`{group}` {rows.schema[group].dataType.simpleString()}, " if group else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = [0]
            if group:
                codes = batch.column(group).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                starts += (np.flatnonzero(np.diff(codes)) + 1).tolist()
            ends = [*starts[1:], batch.num_rows]
            cuts = [(i, min(i + BLOCK_ROWS, b)) for a, b in zip(starts, ends) for i in range(a, b, BLOCK_ROWS)]
            x, y = matrix(batch, "x", k), vector(batch, "y")
            arrays = [
                pa.array([b - a for a, b in cuts], pa.int32()),
                pa.array([y[a:b] for a, b in cuts], pa.list_(pa.float64())),
                pa.array([x[a:b].ravel() for a, b in cuts], pa.list_(pa.float64()))]
            if group:
                arrays.insert(0, batch.column(group).take(pa.array([a for a, _ in cuts])))
            yield pa.RecordBatch.from_arrays(arrays, [*by, "n", "y", "x"])

    return stored(rows.mapInArrow(run, f"{key}n int, y array<double>, x array<double>"))


def _block_arrays(batch: pa.RecordBatch, k: int, mean: np.ndarray, scale: np.ndarray):
    """Rows of each block, outcomes, and the centred and scaled columns of a batch of blocks, each
    column as a row below one of ones."""
    n = batch.column("n").to_numpy()
    y = batch.column("y").flatten().to_numpy(zero_copy_only=False)
    x = np.ones((k + 1, len(y)))
    np.subtract(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).T, mean[:, None], out=x[1:])
    x[1:] /= scale[:, None]
    return n, y, x


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few blocks at a time, so that temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(batch.column("n").to_numpy())
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PASS_ROWS)) + 1
            yield batch.slice(a, b - a)
            a = b


def _wide(jobs: Sequence[tuple[Sequence[int], np.ndarray]], k: int) -> np.ndarray:
    """Coefficients ``(intercept, columns)`` of each fit on all columns, one row each."""
    out = np.zeros((len(jobs), k + 1))
    for i, (at, theta) in enumerate(jobs):
        out[i, [0, *[c + 1 for c in at]]] = theta
    return out


def _chosen(x: np.ndarray, members: Sequence[Sequence[int]]) -> dict[tuple[int, ...], np.ndarray]:
    """Ones and the columns of each distinct choice."""
    return {at: x[[0, *[c + 1 for c in at]]] for at in dict.fromkeys(map(tuple, members))}


@dataclass(frozen=True)
class BetaFit:
    fit: str
    names: list[str]
    n: int
    alpha: float
    beta: np.ndarray
    phi: float
    loglik: float
    steps: int
    draws: DataFrame = field(repr=False)


def _start_phi(mean: float, sd: float) -> float:
    return max(mean * (1 - mean) / max(sd**2, 1e-12) - 1.0, 0.5)


def score_sums(blocks: DataFrame, m: Moments, thetas: Mapping[str, tuple[Sequence[int], np.ndarray]]) -> dict[str, np.ndarray]:
    """``[log likelihood, score, information]`` of each fit, in one pass for all of them.

    ``thetas`` gives a fit's columns and its (intercept, slopes of centred and scaled columns,
    log phi).
    """
    k, mean, scale = m.k, m.mean[:-1], m.scale[:-1]
    widths = {f: 1 + len(t) + len(t) ** 2 for f, (_, t) in thetas.items()}
    total = sum(widths.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total)
        curves = [BetaCurves(float(np.exp(theta[-1]))) for _, theta in thetas.values()]
        choices = [tuple(at) for at, _ in thetas.values()]
        wide = _wide([(at, theta[:-1]) for at, theta in thetas.values()], k)
        for batch in _slices(batches):
            _, y, x = _block_arrays(batch, k, mean, scale)
            etas, seen, columns = wide @ x, Outcomes(y), _chosen(x, choices)
            parts = []
            for at, eta, curve in zip(choices, etas, curves):
                own = columns[at]
                ll, ge, gp, he, hm, hp = curve.scores(eta, seen)
                h = np.zeros((len(own) + 1, len(own) + 1))
                h[:-1, :-1] = (own * he) @ own.T
                h[:-1, -1] = h[-1, :-1] = own @ hm
                h[-1, -1] = hp
                parts += [[ll], own @ ge, [gp], h.ravel()]
            out += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total, dtype=np.int32)), pa.array(out)], ["pos", "value"])

    sums = blocks.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    got = np.split(small_vector(sums, total), np.cumsum(list(widths.values()))[:-1])
    return dict(zip(widths, got))


def fit_beta_batch(
    design: DataFrame,
    names: Sequence[str],
    members: Mapping[str, Sequence[int]],
    draws: int = 1000,
    chains: int = 4,
    seed: int = 100605,
    known: Moments | None = None,
    max_steps: int = 60,
    tolerance: float = 1e-7,
) -> dict[str, BetaFit]:
    """Single-level beta regressions on some of the columns each, flat priors on intercept,
    slopes and phi. ``members`` names the fits and their positions in ``names``; all of them take
    their steps in the same passes, so the number of passes is that of the slowest fit."""
    blocks = packed_rows(open_interval(design), len(names))
    m = known or moments(open_interval(design), len(names))
    own = {f: m.subset(at) for f, at in members.items()}
    theta, move, value, info = {}, {}, {}, {}
    for f, o in own.items():
        o.require_full_rank()
        theta[f] = np.zeros(o.k + 2)
        theta[f][0] = np.log(o.mean[-1] / (1 - o.mean[-1]))
        theta[f][-1] = np.log(_start_phi(o.mean[-1], o.scale[-1]))
        move[f], value[f] = np.zeros(o.k + 2), -np.inf
    steps, done = dict.fromkeys(members, 0), {}
    halved = dict.fromkeys(members, 0)
    for _ in range(max_steps):
        open_ = [f for f in members if f not in done]
        if not open_:
            break
        got = score_sums(blocks, m, {f: (members[f], theta[f] + move[f]) for f in open_})
        for f in open_:
            p = len(theta[f])
            tried = got[f][0] + theta[f][-1] + move[f][-1]
            if not (np.isfinite(tried) and tried >= value[f] - 1e-9 * abs(value[f])) and halved[f] < 12:
                move[f], halved[f] = move[f] / 2.0, halved[f] + 1
                continue
            theta[f], value[f], halved[f] = theta[f] + move[f], tried, 0
            info[f] = got[f][1 + p:].reshape(p, p)
            score = got[f][1:1 + p].copy()
            score[-1] += 1.0  # a flat phi is exp(log phi) on the log scale
            if steps[f] and np.abs(move[f]).max() < tolerance:
                done[f] = True
            move[f] = np.linalg.solve(info[f], score)
            steps[f] += 1
    discard(blocks)
    if late := [f for f in members if f not in done]:
        raise RuntimeError(f"beta regressions did not converge: {late}")

    out = {}
    for f, at in members.items():
        t, low, scale = theta[f], np.linalg.cholesky(info[f]), own[f].scale[:-1]

        def one(rng: np.random.Generator, t=t, low=low, scale=scale) -> dict[str, object]:
            v = t + np.linalg.solve(low.T, rng.standard_normal(len(t)))
            return {"alpha": v[0], "beta": v[1:-1] / scale, "phi": float(np.exp(v[-1]))}

        out[f] = BetaFit(
            f, [names[i] for i in at], m.n, float(t[0]), t[1:-1] / scale, float(np.exp(t[-1])),
            value[f] - t[-1], steps[f], make_draws(design.sparkSession, f, one, draws, chains, seed))
    return out


def fit_beta(
    design: DataFrame, names: Sequence[str], fit: str = "sl_beta", draws: int = 1000, chains: int = 4,
    seed: int = 100605, known: Moments | None = None, max_steps: int = 60, tolerance: float = 1e-7,
) -> BetaFit:
    """Single-level beta regression, flat priors on intercept, slopes and phi."""
    return fit_beta_batch(
        design, names, {fit: range(len(names))}, draws, chains, seed, known, max_steps, tolerance)[fit]


@dataclass(frozen=True)
class VaryingBetaFit:
    """``weights`` are the shares of the posterior at the places ``sigmas``; ``sigma`` is the place of
    the largest, and the other estimates are the mode there."""

    fit: str
    names: list[str]
    n: int
    groups: int
    regions: DataFrame = field(repr=False)
    beta: np.ndarray
    gamma: np.ndarray
    a_region: np.ndarray
    phi: float
    sigma: float
    sigmas: np.ndarray
    weights: np.ndarray
    steps: int
    intercepts: DataFrame = field(repr=False)
    draws: DataFrame = field(repr=False)


#: Chebyshev places of log sigma, and how far they reach, in standard deviations to both sides.
SIGMAS, BELOW, ABOVE = 11, 4.5, 6.0
#: Steps with sigma held at each place, from the mode found with sigma free.
HELD_STEPS = 3
#: Places of log sigma that a free step looks at, besides its own neighbourhood.
JUMPS = np.linspace(-9.0, 3.0, 25)
#: Gauss-Hermite points for the integral over a group's intercept.
QUADRATURE = 9


@dataclass
class _Member:
    """One fit of a batch, or one place of sigma of a fit."""

    at: list[int]
    psi: np.ndarray  # slopes of centred and scaled columns, log phi
    delta: np.ndarray  # second-level slopes, region effects
    log_sigma: float
    schur: np.ndarray | None = None
    move: np.ndarray | None = None
    sigma_info: float = 1.0

    @property
    def sigma2(self) -> float:
        return float(np.exp(2.0 * self.log_sigma))


@dataclass(frozen=True)
class _GroupRows:
    """What tasks need to know about groups."""

    group: str
    weights: Weights
    n_regions: int

    def second_columns(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([self.weights(batch), np.eye(self.n_regions)[vector(batch, "region_index")]])

    def runs(self, batch: pa.RecordBatch, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Distinct neighbouring groups of a batch of blocks, and the first row of each."""
        codes = batch.column(self.group).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
        return batch.column(self.group).take(pa.array(first)), np.r_[0, np.cumsum(n)][first]

    def pieces(self, batch: pa.RecordBatch, o: _Member):
        w = self.second_columns(batch)
        a, k = vector(batch, "a"), len(o.at)
        own = np.column_stack([vector(batch, f"v{i}") for i in (0, 1, *range(3, 3 + k), 2)])
        gap = a - w @ o.delta
        kappa = own[:, 1] + 1.0 / o.sigma2
        v = np.column_stack([own[:, 2:], -w / o.sigma2])
        ga = own[:, 0] - gap / o.sigma2
        # Working intercept, what the group's own rows ask for, and its spread around w'delta.
        return w, a, gap, kappa, v, ga, gap + own[:, 0] / own[:, 1], o.sigma2 + 1.0 / own[:, 1]


class _VaryingBatch:
    """Scoring steps of several fits over one set of blocks.

    ``state(group, v, z, region_index, a)`` holds the intercept of each group in each member. Slopes,
    second-level effects, phi and all intercepts move together; the intercepts drop out of the
    joint system by a Schur complement that Spark sums over groups.
    """

    def __init__(self, blocks: DataFrame, m: Moments, group: str, second: GroupLevel) -> None:
        self.blocks, self.m, self.group, self.second = blocks, m, group, second
        self.prior = np.r_[np.zeros(second.n_z), np.full(second.n_regions, REGION_PRIOR_SD**-2)]
        self.rows = _GroupRows(group, second.weights, second.n_regions)
        self.key_type = blocks.schema[group].dataType.simpleString()

    def _by_group(self, state: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Blocks next to their group's values in all members, arrays in the order of ``v``."""
        arrays = state.groupBy(self.group).agg(*[
            F.transform(F.array_sort(F.collect_list(F.struct("v", F.col(c).alias("c")))), lambda e: e["c"]).alias(f"{c}_of")
            for c in columns])
        return self.blocks.join(arrays, self.group)

    def sums(self, state: DataFrame, members: list[_Member]) -> DataFrame:
        """One pass over the rows: ``(group, v, ...)`` sums by group, stored next to the group's
        state, and the sums over all rows of a member, which have a ``pos`` and no group."""
        k, mean, scale, group = self.m.k, self.m.mean[:-1], self.m.scale[:-1], self.group
        held = self.rows
        wide = max(len(o.at) for o in members) + 3  # score, information, cross terms with slopes and log phi
        columns = [f"v{i}" for i in range(wide)]
        jobs = [(tuple(o.at), float(np.exp(o.psi[-1]))) for o in members]
        slopes = _wide([(o.at, np.r_[0.0, o.psi[:-1]]) for o in members], k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(1 + (len(at) + 1) * (len(at) + 2)) for at, _ in jobs]
            curves = [BetaCurves(phi) for _, phi in jobs]
            kind = None
            for batch in _slices(batches):
                n, y, x = _block_arrays(batch, k, mean, scale)
                a = matrix(batch, "a_of", len(jobs))
                groups, starts = held.runs(batch, n)
                kind = groups.type
                fixed, seen, choices = slopes @ x, Outcomes(y), _chosen(x, [at for at, _ in jobs])
                values = np.zeros((len(jobs), len(starts), wide))
                for v, ((at, _), curve) in enumerate(zip(jobs, curves)):
                    own, p = choices[at], len(at) + 1
                    ll, ge, gp, he, hm, hp = curve.scores(fixed[v] + np.repeat(a[:, v], n), seen)
                    weighed = own * he
                    h = np.empty((p, p))
                    h[:-1, :-1] = weighed[1:] @ own[1:].T
                    h[:-1, -1] = h[-1, :-1] = own[1:] @ hm
                    h[-1, -1] = hp
                    totals[v] += np.concatenate([[ll], own[1:] @ ge, [gp], h.ravel()])
                    rows = values[v]
                    rows[:, 0], rows[:, 2] = np.add.reduceat(ge, starts), np.add.reduceat(hm, starts)
                    by_run = np.add.reduceat(weighed, starts, axis=1)
                    rows[:, 1], rows[:, 3:3 + len(at)] = by_run[0], by_run[1:].T
                count = len(jobs) * len(starts)
                yield pa.RecordBatch.from_arrays(
                    [groups.take(pa.array(np.tile(np.arange(len(starts)), len(jobs)))),
                     pa.array(np.repeat(np.arange(len(jobs), dtype=np.int32), len(starts))),
                     pa.array(np.full(count, -1, np.int32)),
                     *[pa.array(np.ascontiguousarray(c)) for c in values.reshape(count, wide).T]],
                    [group, "v", "pos", *columns])
            if kind is None:
                return
            for v, total in enumerate(totals):
                size = len(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(size, kind), pa.array(np.full(size, v, np.int32)),
                     pa.array(np.arange(size, dtype=np.int32)), pa.array(total),
                     *[pa.nulls(size, pa.float64())] * (wide - 1)], [group, "v", "pos", *columns])

        schema = f"`{group}` {self.key_type}, v int, pos int, " + ", ".join(f"{c} double" for c in columns)
        found = self._by_group(state, ["a"]).mapInArrow(run, schema).groupBy(group, "v", "pos").agg(
            *[F.sum(c).alias(c) for c in columns])
        return stored(found.join(state, [group, "v"], "left"))

    def step(self, state: DataFrame, members: list[_Member], free_sigma: bool) -> tuple[DataFrame, DataFrame, list[float]]:
        """Move all members once: the sums, the new state (lazy, over the sums), and the size of
        each member's step. Two jobs, whatever the number of members."""
        sums, held, group = self.sums(state, members), self.rows, self.group
        d = len(self.prior)
        sizes = [(len(o.at) + 1, len(o.at) + 1 + d) for o in members]
        hyper = [1 + p * (p + 1) for p, _ in sizes]
        widths = [h + q * q + q + d * d + d + 2 + len(JUMPS) + 1 for h, (_, q) in zip(hyper, sizes)]
        offsets = np.r_[0, np.cumsum(widths)]
        before = [_Member(o.at, o.psi.copy(), o.delta.copy(), o.log_sigma) for o in members]

        def kernel(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(offsets[-1])
            pos, member = vector(batch, "pos"), vector(batch, "v")
            whole = np.flatnonzero(pos >= 0)
            np.add.at(out, offsets[member[whole]] + pos[whole], vector(batch, "v0")[whole])
            for i in np.unique(member[pos < 0]):
                part = batch.filter(pa.array((member == i) & (pos < 0)))
                w, _, gap, kappa, v, ga, away, spread = held.pieces(part, before[i])
                vk = v / kappa[:, None]
                # How likely the working intercepts are at each place of sigma, the present one last.
                other = np.exp(2.0 * np.r_[JUMPS, before[i].log_sigma])[:, None] + (spread - before[i].sigma2)
                chance = -0.5 * (np.log(other) + away**2 / other).sum(axis=1)
                out[offsets[i] + hyper[i]:offsets[i + 1]] += np.concatenate([
                    (vk.T @ v).ravel(), vk.T @ ga, (w.T @ w).ravel(), w.T @ gap,
                    [((away / spread) ** 2 - 1.0 / spread).sum(), (2.0 * away**2 / spread**3 - spread**-2).sum()],
                    chance])
            return out

        got = small_vector(block_sums(sums, kernel, int(offsets[-1])), int(offsets[-1]))
        lengths = []
        for i, (o, (p, q)) in enumerate(zip(members, sizes)):
            mine = got[offsets[i]:offsets[i + 1]]
            overall = mine[:hyper[i]]
            vv, vg, ww, wg, var, chance = np.split(mine[hyper[i]:], np.cumsum([q * q, q, d * d, d, 2]))
            info = np.zeros((q, q))
            info[:p, :p] = overall[1 + p:].reshape(p, p)
            info[p:, p:] = ww.reshape(d, d) / o.sigma2 + np.diag(self.prior)
            score = np.concatenate([overall[1:1 + p], wg / o.sigma2 - self.prior * o.delta])
            score[p - 1] += 1.0  # a flat phi on the log scale
            o.schur = info - vv.reshape(q, q)
            # Second-level columns may be collinear in few groups; the tiny ridge only steadies.
            o.schur[np.diag_indices(q)] *= 1.0 + 1e-10
            move = np.linalg.solve(o.schur, score - vg)
            limit = np.abs(move).max()
            o.move = move * min(1.0, 2.0 / limit) if limit > 0 else move
            before[i].move = o.move
            o.psi, o.delta = o.psi + o.move[:p], o.delta + o.move[p:]
            size = float(np.abs(o.move).max())
            if free_sigma:
                size = max(size, self._move_sigma(o, var, chance))
            lengths.append(size)

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                member = vector(batch, "v")
                for i in np.unique(member):
                    part = batch.filter(pa.array(member == i))
                    _, a, _, kappa, v, ga, _, _ = held.pieces(part, before[i])
                    new = a + np.clip((ga - v @ before[i].move) / kappa, -3.0, 3.0)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in (group, "v", "z", "region_index")), pa.array(new),
                         pa.array(kappa)], [group, "v", "z", "region_index", "a", "kappa"])

        schema = f"`{self.group}` {self.key_type}, v int, z array<double>, region_index int, a double, kappa double"
        return sums, sums.where("pos < 0").mapInArrow(moved, schema), lengths

    def _move_sigma(self, o: _Member, var: np.ndarray, chance: np.ndarray) -> float:
        """Newton's step of log sigma where the working intercepts are likely, a jump to the
        likeliest place where they aren't. A flat sigma adds 1 to the score on the log scale."""
        s2 = o.sigma2
        score = s2 * var[0] + 1.0
        curve = s2**2 * var[1] * 2.0 - 2.0 * s2 * var[0]
        chance = chance + np.r_[JUMPS, o.log_sigma]
        best = int(np.argmax(chance))
        o.sigma_info = max(curve, 0.5)
        if chance[best] > chance[-1] + 0.1 and abs(JUMPS[best] - o.log_sigma) > 0.3:
            change = JUMPS[best] - o.log_sigma
        else:
            change = float(np.clip(score / o.sigma_info, -0.5, 0.5))
        o.log_sigma += change
        # The place is only where the grid is centred.
        return abs(change) / 50

    def marginals(self, state: DataFrame, members: list[_Member]) -> np.ndarray:
        """Log likelihood of each member with every group's intercept integrated out, by adaptive
        quadrature around its mode: likelihoods at all points are summed by group in one pass."""
        points, weights = np.polynomial.hermite.hermgauss(QUADRATURE)
        k, mean, scale, group = self.m.k, self.m.mean[:-1], self.m.scale[:-1], self.group
        held = self.rows
        columns = [f"q{i}" for i in range(QUADRATURE)]
        phis = [float(np.exp(o.psi[-1])) for o in members]
        slopes = _wide([(o.at, np.r_[0.0, o.psi[:-1]]) for o in members], k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            curves = [BetaCurves(phi) for phi in phis]
            for batch in _slices(batches):
                n, y, x = _block_arrays(batch, k, mean, scale)
                a, kappa = matrix(batch, "a_of", len(phis)), matrix(batch, "kappa_of", len(phis))
                groups, starts = held.runs(batch, n)
                fixed, seen = slopes @ x, Outcomes(y, starts)
                first = np.searchsorted(np.cumsum(n), starts, side="right")  # a run's first block
                values = np.empty((len(phis), len(starts), QUADRATURE))
                for v, curve in enumerate(curves):
                    shifts = points * np.sqrt(2.0 / kappa[first, v, None])
                    values[v] = curve.shifted(fixed[v] + np.repeat(a[:, v], n), seen, shifts)
                count = len(phis) * len(starts)
                yield pa.RecordBatch.from_arrays(
                    [groups.take(pa.array(np.tile(np.arange(len(starts)), len(phis)))),
                     pa.array(np.repeat(np.arange(len(phis), dtype=np.int32), len(starts))),
                     *[pa.array(np.ascontiguousarray(c)) for c in values.reshape(count, QUADRATURE).T]],
                    [group, "v", *columns])

        schema = f"`{group}` {self.key_type}, v int, " + ", ".join(f"{c} double" for c in columns)
        found = self._by_group(state, ["a", "kappa"]).mapInArrow(run, schema).groupBy(group, "v").agg(
            *[F.sum(c).alias(c) for c in columns]).join(state, [group, "v"])

        def integral(batch: pa.RecordBatch) -> np.ndarray:
            out, member = np.zeros(len(members)), vector(batch, "v")
            for i in np.unique(member):
                part, o = batch.filter(pa.array(member == i)), members[i]
                spread = np.sqrt(2.0 / vector(part, "kappa"))[:, None]
                gap = vector(part, "a")[:, None] + points * spread - (held.second_columns(part) @ o.delta)[:, None]
                logs = np.column_stack([vector(part, c) for c in columns])
                logs = logs - 0.5 * gap**2 / o.sigma2 - 0.5 * np.log(2 * np.pi * o.sigma2) + points**2 + np.log(weights * spread)
                top = logs.max(axis=1, keepdims=True)
                out[i] += (top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))).sum()
            return out

        return small_vector(block_sums(found, integral, len(members)), len(members))


def _chebyshev(lo: float, hi: float, count: int) -> np.ndarray:
    return (lo + hi) / 2 - (hi - lo) / 2 * np.cos((np.arange(count) + 0.5) * np.pi / count)


def _lagrange(places: np.ndarray, at: float) -> np.ndarray:
    """Weights of the values at Chebyshev places in the polynomial through them."""
    gap = at - places
    if (near := np.abs(gap) < 1e-14).any():
        return near.astype(float)
    n = len(places)
    w = (-1.0) ** np.arange(n) * np.sin((np.arange(n) + 0.5) * np.pi / n) / gap
    return w / w.sum()


def fit_varying_beta_batch(
    design: DataFrame,
    names: Sequence[str],
    members: Mapping[str, Sequence[int]],
    group: str,
    second: GroupLevel,
    draws: int = 1000,
    chains: int = 4,
    seed: int = 100605,
    known: Moments | None = None,
    max_steps: int = 60,
    tolerance: float = 2e-3,
) -> dict[str, VaryingBetaFit]:
    """Beta regressions with an intercept for each group,
    ``a_group ~ N(z'gamma + a_region, sigma)`` and ``a_region ~ N(0, 5)``, flat elsewhere.

    ``members`` names the fits and their positions in ``names``; all take their scoring steps in
    the same passes. sigma takes a step of its own each time, in which the intercept a group's
    rows ask for is normal around ``w'delta`` with variance ``sigma^2`` plus its sampling variance.
    That only has to find the neighbourhood.

    Then sigma is held at places around that estimate, again for all fits at once: the other
    effects move to their mode there, and the likelihood with all intercepts integrated out by
    adaptive Gauss-Hermite quadrature, times the volume around the mode, gives the place its share
    of the posterior. A draw takes sigma from that, and the other effects from the normal
    approximation at its sigma.
    """
    usable = open_interval(second.restrict(design, group)).select(group, "y", "x")
    blocks = packed_rows(usable, len(names), group)
    m = known or moments(usable, len(names))
    batch = _VaryingBatch(blocks, m, group, second)
    start = float(np.log(m.mean[-1] / (1 - m.mean[-1])))
    L, R = second.n_z, second.n_regions

    fits, own = [], {f: m.subset(at) for f, at in members.items()}
    for f, at in members.items():
        own[f].require_full_rank()
        psi = np.zeros(len(at) + 1)
        psi[-1] = np.log(_start_phi(m.mean[-1], m.scale[-1]))
        fits.append(_Member(list(at), psi, np.r_[np.zeros(L), np.full(R, start)], np.log(0.5)))

    present = second.table.join(blocks.select(group).distinct(), group, "left_semi")
    state = present.crossJoin(F.broadcast(design.sparkSession.range(len(fits)).select(
        F.col("id").cast("int").alias("v")))).withColumn("a", F.lit(start))
    previous = None
    for steps in range(1, max_steps + 1):
        sums, state, lengths = batch.step(state, fits, free_sigma=True)
        if previous is not None:
            discard(previous)
        previous = sums
        if max(lengths) < tolerance:
            break
    else:
        raise RuntimeError("varying-intercept beta regressions did not converge")
    mode = stored(state)
    discard(previous)

    held, places = [], []
    for o in fits:
        sd = 1.0 / np.sqrt(o.sigma_info)
        line = _chebyshev(o.log_sigma - BELOW * sd, o.log_sigma + ABOVE * sd, SIGMAS)
        places.append(line)
        held += [_Member(o.at, o.psi.copy(), o.delta.copy(), float(v)) for v in line]
    every = F.explode(F.sequence(F.lit(0), F.lit(SIGMAS - 1)))
    state = mode.withColumn("s", every).withColumn("v", (F.col("v") * SIGMAS + F.col("s")).cast("int")).drop("s", "kappa")
    previous = None
    for _ in range(HELD_STEPS):
        sums, state, _ = batch.step(state, held, free_sigma=False)
        if previous is not None:
            discard(previous)
        previous = sums
    logs = batch.marginals(state, held)
    discard(previous)
    j = mode.where("v = 0").count()
    intercepts = mode.select(group, "v", "a")

    out = {}
    for i, (f, at) in enumerate(members.items()):
        some, line = held[i * SIGMAS:(i + 1) * SIGMAS], places[i]
        post = np.array([
            logs[i * SIGMAS + n] - 0.5 * (batch.prior * o.delta**2).sum() + o.psi[-1] + o.log_sigma
            - 0.5 * np.linalg.slogdet(o.schur)[1] for n, o in enumerate(some)])
        modes = np.array([np.r_[o.psi, o.delta] for o in some])
        lows = [np.linalg.cholesky(o.schur) for o in some]
        fine = np.linspace(line[0], line[-1], 401)
        density = np.exp(np.array([_lagrange(line, v) @ post for v in fine]) - post.max())
        upto = np.cumsum(density)
        scale, k = own[f].scale[:-1], len(at)

        def one(rng: np.random.Generator, line=line, modes=modes, lows=lows, fine=fine, upto=upto, scale=scale,
                k=k, z_scale=second.z_scale) -> dict[str, object]:
            cell = min(int(np.searchsorted(upto, rng.random() * upto[-1])), len(fine) - 1)
            log_sigma = fine[cell] + (rng.random() - 0.5) * (fine[1] - fine[0])
            low = lows[int(np.abs(line - log_sigma).argmin())]
            inside = float(np.clip(log_sigma, line[0], line[-1]))
            t = _lagrange(line, inside) @ modes + np.linalg.solve(low.T, rng.standard_normal(len(low)))
            return {"beta": t[:k] / scale, "phi": float(np.exp(t[k])), "gamma": t[k + 1:k + 1 + L] / z_scale,
                    "a_region": t[k + 1 + L:], "sigma_a": float(np.exp(log_sigma))}

        peak = float(fine[int(density.argmax())])
        best = _lagrange(line, float(np.clip(peak, line[0], line[-1]))) @ modes
        out[f] = VaryingBetaFit(
            f, [names[c] for c in at], m.n, j, second.regions, best[:k] / scale, best[k + 1:k + 1 + L] / second.z_scale,
            best[k + 1 + L:], float(np.exp(best[k])), float(np.exp(peak)), np.exp(fine), density / density.sum(),
            steps, intercepts.where(F.col("v") == i).select(group, "a"),
            make_draws(design.sparkSession, f, one, draws, chains, seed))
    discard(blocks)
    return out


def fit_varying_beta(
    design: DataFrame, names: Sequence[str], group: str, second: GroupLevel, fit: str = "vi_beta",
    draws: int = 1000, chains: int = 4, seed: int = 100605, known: Moments | None = None,
    max_steps: int = 60, tolerance: float = 2e-3,
) -> VaryingBetaFit:
    """Beta regression with an intercept for each group: a batch of one."""
    return fit_varying_beta_batch(
        design, names, {fit: range(len(names))}, group, second, draws, chains, seed, known, max_steps, tolerance)[fit]
