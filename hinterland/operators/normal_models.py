"""Normal regressions whose posterior follows from sufficient statistics.

The data are read by Spark aggregations; what is left is a few small matrices, from which
draws are made independently of each other in tasks. Draws are exact (single level) or
exact up to the grid of two variance parameters (varying intercept); no Markov chain is
involved, so a ``chain`` is only a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.operators.design import (
    Moments, ThinQR, block_sums, matrix, moments, small_vector, thin_qr, vector,
)
from hinterland.operators.joins import lookup
from hinterland.operators.windows import dense_index
from hinterland.sources.checkpoint import materialise

DRAW_SCHEMA = (
    "fit string, chain int, draw int, alpha double, beta array<double>, gamma array<double>, "
    "a_region array<double>, sigma double, sigma_a double, phi double"
)
REGION_PRIOR_SD = 5.0  # fixed value: a_region ~ normal(0, 5)


def make_draws(
    spark: SparkSession,
    fit: str,
    one: Callable[[np.random.Generator], dict[str, object]] | None,
    draws: int,
    chains: int,
    seed: int,
    known: Callable[[int], dict[str, object]] | None = None,
) -> DataFrame:
    """``chains * draws`` independent draws, made in tasks. Each draw seeds its own
    generator, so a re-run task repeats its values however rows are partitioned. ``known`` gives
    draws by their number instead."""
    number, array = pa.float64(), pa.list_(pa.float64())
    schema = pa.schema([
        ("fit", pa.string()), ("chain", pa.int32()), ("draw", pa.int32()), ("alpha", number),
        ("beta", array), ("gamma", array), ("a_region", array),
        ("sigma", number), ("sigma_a", number), ("phi", number),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in batches:
            rows = []
            for i in ids.column("id").to_pylist():
                chain, draw = divmod(i, draws)
                value = known(i) if known else one(np.random.default_rng([seed, chain, draw]))
                rows.append({"fit": fit, "chain": chain + 1, "draw": draw + 1, **value})
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = max(1, min(chains * draws // 2000, spark.sparkContext.defaultParallelism))
    return spark.range(0, chains * draws, 1, parts).mapInArrow(run, DRAW_SCHEMA)


@dataclass(frozen=True)
class NormalFit:
    fit: str
    names: list[str]
    n: int
    alpha: float
    beta: np.ndarray
    sse: float
    cov_unscaled: np.ndarray  # (Xc'Xc)^-1
    draws: DataFrame = field(repr=False)


def fit_normal(
    design: DataFrame,
    names: Sequence[str],
    fit: str = "sl_normal",
    draws: int = 1000,
    chains: int = 4,
    seed: int = 100605,
    known: ThinQR | Moments | None = None,
) -> NormalFit:
    """Single-level normal regression with flat priors on intercept, slopes and sigma.

    sigma^2 is inverse gamma with shape (N-K-2)/2 and scale SSE/2; given sigma^2 the slopes
    are normal around least squares and the intercept, for centred x, around mean(y). Least
    squares come from the thin QR, or from cross-products where ``known`` holds those.
    """
    f = known or thin_qr(design, len(names))
    f = f.triangle() if isinstance(f, Moments) else f
    k, n = f.k, f.n
    if n - k - 2 <= 0:
        raise ValueError("more rows than columns + 2 are needed")
    f.require_full_rank()
    sx, sy = f.scale[:-1], f.scale[-1]
    inverse = np.linalg.solve(f.r[:-1, :-1], np.eye(k))
    theta = inverse @ f.r[:-1, -1]
    sse = float((f.r[-1, -1] * sy) ** 2)
    beta, ybar = theta * sy / sx, float(f.mean[-1])
    cov = (inverse @ inverse.T) / np.outer(sx, sx)

    def one(rng: np.random.Generator) -> dict[str, object]:
        sigma = np.sqrt(sse / 2.0 / rng.gamma((n - k - 2) / 2.0))
        noise = (inverse @ rng.standard_normal(k)) / sx
        return {
            "alpha": ybar + sigma * rng.standard_normal() / np.sqrt(n),
            "beta": beta + sigma * noise,
            "sigma": sigma,
        }

    table = make_draws(design.sparkSession, fit, one, draws, chains, seed)
    return NormalFit(fit, list(names), n, ybar, beta, sse, cov, table)


def group_stats(design: DataFrame, group: str, k: int) -> DataFrame:
    """``(group, n, sy, syy, sx array)`` in one aggregation. Sums are combined before the
    shuffle, so a large group costs no more than a small one."""
    return design.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(k)]).alias("sx"),
    )


@dataclass(frozen=True)
class Weights:
    """Centres and scales z of group rows; small enough to travel with a task."""

    z_mean: np.ndarray
    z_scale: np.ndarray

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        return (matrix(batch, "z", len(self.z_mean)) - self.z_mean) / self.z_scale


@dataclass(frozen=True)
class GroupLevel:
    """Second-level table ``(group, z array, region_index)`` with z centred over groups, and
    ``regions(region, region_index)``, numbered from 0 in their order."""

    table: DataFrame = field(repr=False)
    weights: Weights
    regions: DataFrame = field(repr=False)
    n_regions: int = 0

    @property
    def z_scale(self) -> np.ndarray:
        return self.weights.z_scale

    @property
    def n_z(self) -> int:
        return len(self.weights.z_mean)

    def restrict(self, design: DataFrame, group: str) -> DataFrame:
        """Rows of groups that have a second level; sums over others must not enter a fit."""
        return design.join(self.table.select(group), group, "left_semi")


def group_level(groups: DataFrame, group: str, z: Sequence[str], region: str) -> GroupLevel:
    """Prepare one row per group for the second level. Groups are indexed after all
    filters, so no group is empty. Groups without a region or with a NULL in ``z`` are left
    out, and with them their rows: ``restrict``."""
    for c in (*z, region):
        groups = groups.where(F.col(c).isNotNull())
    summary = groups.agg(
        F.array(*[F.avg(c) for c in z]).alias("m"),
        F.array(*[F.stddev_pop(c) for c in z]).alias("s"),
    ).first()
    regions = materialise(
        dense_index(groups, region, "_place").select(
            F.col(region).alias("region"), (F.col("_place") - 1).alias("region_index")))
    table = groups.select(
        group, F.array(*[F.col(c).cast("double") for c in z]).alias("z"), F.col(region).alias("region"),
    ).join(regions, "region").select(group, "z", "region_index")
    scale = np.array(summary["s"], float)
    scale[~(scale > 0)] = 1.0
    return GroupLevel(table, Weights(np.array(summary["m"], float), scale), regions, regions.count())


@dataclass(frozen=True)
class VaryingNormalFit:
    """``mean`` holds slopes and second-level slopes, ``region_means`` a row for each region."""

    fit: str
    names: list[str]
    n: int
    groups: int
    regions: DataFrame = field(repr=False)
    mean: dict[str, np.ndarray]
    region_means: DataFrame = field(repr=False)
    draws: DataFrame = field(repr=False)
    intercepts: Callable[[int], DataFrame] = field(repr=False)


#: Ratios of the two variances that are looked at: over all orders of magnitude first, then where
#: the posterior lies; and places of sigma for each.
COARSE = 10.0 ** np.linspace(-7, 4, 23)
FINE, SIGMAS, SPREAD = 61, 33, 6.0
#: Relative error of what the eliminated regions add, as a function of sigma.
INTERPOLATION = 1e-9


@dataclass(frozen=True)
class _Nodes:
    """Chebyshev nodes in the log of kappa, the prior precision of a region times sigma^2."""

    lo: float
    hi: float
    count: int

    @classmethod
    def over(cls, lo: float, hi: float) -> _Nodes:
        lo, hi = np.log(lo), np.log(hi)
        # The sums have poles at log W + i pi, and converge like powers of this.
        half = max((hi - lo) / 2, 1e-12)
        ratio = np.pi / half + np.sqrt(1 + (np.pi / half) ** 2)
        return cls(lo, hi, int(np.clip(np.ceil(-np.log(INTERPOLATION) / np.log(ratio)), 3, 32)))

    @property
    def angles(self) -> np.ndarray:
        return (np.arange(self.count) + 0.5) * np.pi / self.count

    @property
    def values(self) -> np.ndarray:
        return np.exp((self.lo + self.hi) / 2 + (self.hi - self.lo) / 2 * np.cos(self.angles))

    def weights(self, kappa: np.ndarray) -> np.ndarray:
        """Weights of the nodes in the polynomial's values, a row for each of ``kappa``."""
        x = np.clip((np.log(kappa) - (self.lo + self.hi) / 2) / max((self.hi - self.lo) / 2, 1e-12), -1, 1)
        gap = x[:, None] - np.cos(self.angles)
        at_node = np.abs(gap) < 1e-14
        w = (-1.0) ** np.arange(self.count) * np.sin(self.angles) / np.where(at_node, 1.0, gap)
        w = np.where(at_node.any(axis=1, keepdims=True), at_node, w)
        return w / w.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class _Marginal:
    """Posterior for one ratio of the variances, with group and region effects integrated out.

    ``cross`` at each node is the cross-product of (slopes, second-level slopes, y) after the
    elimination, ``dets`` the log determinant of the regions' part; ``groups`` that of the groups'.
    """

    rho: float
    nodes: _Nodes
    cross: np.ndarray
    dets: np.ndarray
    groups: float
    n: int
    regions: int

    def at(self, log_sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log posterior in (log rho, log sigma), Cholesky factor and mean of the slopes, for each
        of some places of sigma."""
        s2 = np.exp(2.0 * log_sigma)
        w = self.nodes.weights(s2 * REGION_PRIOR_SD**-2)
        m = np.tensordot(w, self.cross, 1)
        q = m.shape[-1] - 1
        low = np.linalg.cholesky(m[:, :q, :q])
        half = np.linalg.solve(low, m[:, :q, q:])
        log = (
            -self.n * log_sigma - 0.5 * self.groups - 0.5 * (m[:, q, q] - (half[:, :, 0] ** 2).sum(axis=1)) / s2
            - 0.5 * (w @ self.dets - 2.0 * self.regions * log_sigma)
            - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1) + q * log_sigma
            + 2.0 * log_sigma + 0.5 * np.log(self.rho)  # flat on (sigma, sigma_a)
        )
        mean = np.linalg.solve(np.swapaxes(low, 1, 2), half)[:, :, 0]
        return log, low / np.exp(log_sigma)[:, None, None], mean

    def peak(self) -> tuple[float, float, float]:
        """Place and width of the peak along log sigma, and its height."""
        lo, hi = self.nodes.lo / 2 + np.log(REGION_PRIOR_SD), self.nodes.hi / 2 + np.log(REGION_PRIOR_SD)
        while True:
            grid = np.linspace(lo, hi, 25)
            logs = self.at(grid)[0]
            best = int(np.argmax(logs))
            if hi - lo < 0.05 / np.sqrt(2.0 * self.n):
                break
            lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 24)]
        centre, step = grid[best], 0.05 / np.sqrt(2.0 * self.n)
        around = self.at(centre + step * np.array([-1.0, 0.0, 1.0]))[0]
        curve = (2 * around[1] - around[0] - around[2]) / step**2
        return centre, 1.0 / np.sqrt(max(curve, 1.0)), logs[best]


def fit_varying_normal(
    design: DataFrame,
    names: Sequence[str],
    group: str,
    second: GroupLevel,
    fit: str = "vi_normal",
    draws: int = 1000,
    chains: int = 4,
    seed: int = 100605,
    known: Moments | None = None,
    stats: DataFrame | None = None,
    columns: Sequence[int] | None = None,
) -> VaryingNormalFit:
    """Normal regression with an intercept for each group:
    ``a_group ~ N(z'gamma + a_region, sigma_a)``, ``a_region ~ N(0, 5)``, flat elsewhere.

    The effects are integrated out one level after the other. For a given ratio rho =
    sigma_a^2/sigma^2 a group leaves its sums with the weight 1/(1 + n rho). Spark adds them up
    by region, and a region, which has one effect, leaves the product of its sums divided by
    their weight plus 25^-1 sigma^2; as sigma is not known yet, at a few Chebyshev nodes of it. The
    driver sees the cross-products of slopes and second-level slopes only, whose size depends
    neither on the groups nor on the regions. Both variances live on a grid.

    Data rows are read once, group rows twice. ``columns`` picks x columns when ``stats`` was made
    for a wider design. Rows of groups without a second level take no part; ``known`` and
    ``stats`` have to be of the rest.
    """
    k = len(names)
    design = second.restrict(design, group)
    m = known or moments(design, k)
    m.require_full_rank()
    at = list(range(k)) if columns is None else list(columns)
    stats = group_stats(design, group, k) if stats is None else stats
    table = lookup(stats, second.table, group)
    sx, xm, ym = m.scale[:-1], m.mean[:-1], m.mean[-1]
    L, weigh, z_scale = second.n_z, second.weights, second.z_scale
    q = k + L
    width = (q + 1) ** 2
    wide = max(at) + 1 if columns is None else None
    prior = REGION_PRIOR_SD**-2

    def group_arrays(batch: pa.RecordBatch):
        n = vector(batch, "n").astype(float)
        full = matrix(batch, "sx", wide or len(batch.column("sx")[0]))
        s = (full[:, at] - n[:, None] * xm) / sx
        return n, s, vector(batch, "sy").astype(float), weigh(batch)

    base = np.zeros((q + 1, q + 1))
    base[:k, :k] = m.cross[:-1, :-1]
    base[:k, q] = base[q, :k] = m.cross[:-1, -1] * m.scale[-1]
    base[q, q] = m.cross[-1, -1] * m.scale[-1] ** 2 + m.n * ym**2
    own = [*range(k), q]
    sums = [f"b{i}" for i in range(q + 2)]  # of a region: its slopes' cross terms and its weight

    def by_region(rhos: np.ndarray) -> DataFrame:
        """``(region_index, g, sums)`` of each region and ratio; rows without a region hold the
        groups' part of the cross-products of the slopes, a row each, as (g, position, value)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(rhos), width + 2))
            within = np.zeros(width)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n, s, t, z = group_arrays(batch)
                region = vector(batch, "region_index")
                order = np.argsort(region, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(region[order]) > 0])
                xy = np.column_stack([s, t])
                mine = np.zeros((q + 1, q + 1))
                mine[np.ix_(own, own)] = (xy / n[:, None]).T @ xy
                within += mine.ravel()
                for g, rho in enumerate(rhos):
                    f = 1.0 / (1.0 + n * rho)
                    a = np.zeros((q + 1, q + 1))
                    a[np.ix_(own, own)] = -(xy * (rho * f)[:, None]).T @ xy
                    a[k:q, k:q] = (z * (n * f)[:, None]).T @ z
                    cross = (z * f[:, None]).T @ xy
                    a[np.ix_(range(k, q), own)] = cross
                    a[np.ix_(own, range(k, q))] = cross.T
                    total[g, :width] += a.ravel()
                    total[g, width:] += np.log1p(n * rho).sum(), len(n)
                    rows = np.column_stack([s * f[:, None], z * (n * f)[:, None], t * f, n * f])
                    rows = np.add.reduceat(rows[order], starts, axis=0)
                    yield rows_of(region[order][starts], np.full(len(starts), g), rows)
            for g in range(len(rhos)):
                yield totals_of(g, total[g])
            yield totals_of(len(rhos), within)

        def rows_of(region, g, rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(region, pa.int32()), pa.array(g, pa.int32()), pa.nulls(len(g), pa.int32()),
                 *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], ["region_index", "g", "pos", *sums])

        def totals_of(g, values) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(np.ascontiguousarray(values)), *[pa.nulls(n, pa.float64())] * (q + 1)],
                ["region_index", "g", "pos", *sums])

        schema = "region_index int, g int, pos int, " + ", ".join(f"{c} double" for c in sums)
        return materialise(table.mapInArrow(run, schema).groupBy("region_index", "g", "pos").agg(
            *[F.sum(c).alias(c) for c in sums]))

    def eliminated(rhos: np.ndarray) -> tuple[DataFrame, list[_Marginal], int]:
        state = by_region(rhos)
        core = np.zeros((len(rhos) + 1, width + 2))
        for r in state.where("pos IS NOT NULL").select("g", "pos", "b0").collect():
            core[r["g"], r["pos"]] = r["b0"]
        whole = base + core[:-1, :width].reshape(-1, q + 1, q + 1)
        # sigma lies between what free group intercepts leave and what none leave.
        inner = base - core[-1, :width].reshape(q + 1, q + 1)

        def left(c: np.ndarray, some: int) -> float:
            return max(c[q, q] - c[:some, q] @ np.linalg.lstsq(c[:some, :some], c[:some, q])[0], 1e-300)

        floor = left(inner, k) / (m.n + 2)
        margin = np.exp(4 * SPREAD / np.sqrt(2.0 * max(m.n - q, 4)))
        nodes = []
        for c in whole:
            top = max(left(c, q) / max(m.n - q - 2, 1), floor * 1.000001) * margin
            nodes.append(_Nodes.over(prior * max(floor / margin, top * 1e-12), prior * top))
        sizes = np.array([v.count for v in nodes])
        offsets = np.r_[0, np.cumsum(sizes * (width + 1))]

        def kernel(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(offsets[-1])
            g = vector(batch, "g")
            rows = np.column_stack([vector(batch, c) for c in sums])
            for i in np.unique(g):
                b, weight = rows[g == i, :-1], rows[g == i, -1]
                for j, kappa in enumerate(nodes[i].values):
                    a = offsets[i] + j * (width + 1)
                    out[a:a + width] = ((b / (weight + kappa)[:, None]).T @ b).ravel()
                    out[a + width] = np.log(weight + kappa).sum()
            return out

        regions = state.where("pos IS NULL").drop("pos")
        got = small_vector(block_sums(regions, kernel, int(offsets[-1])), int(offsets[-1]))
        found = []
        for i, rho in enumerate(rhos):
            part = got[offsets[i]:offsets[i + 1]].reshape(sizes[i], width + 1)
            cross = whole[i] - part[:, :width].reshape(-1, q + 1, q + 1)
            found.append(_Marginal(rho, nodes[i], cross, part[:, width], core[i, width], m.n, second_regions))
        return regions, found, int(round(core[0, width + 1]))

    second_regions = second.n_regions
    try:
        _, rough, _ = eliminated(COARSE)
        top = np.array([p.peak()[2] for p in rough])
        live = np.flatnonzero(top > top.max() - 18.0)
        lo, hi = max(live[0] - 1, 0), min(live[-1] + 1, len(COARSE) - 1)
        regions, fine, j = eliminated(np.exp(np.linspace(np.log(COARSE[lo]), np.log(COARSE[hi]), FINE)))
        peaks = [p.peak() for p in fine]
        steps = np.linspace(-SPREAD, SPREAD, SIGMAS)
        places = np.array([centre + steps * sd for centre, sd, _ in peaks])
        cells = [p.at(line) for p, line in zip(fine, places)]
        logs = np.array([c[0] for c in cells])
    except np.linalg.LinAlgError as error:
        raise ValueError("design or second-level columns are constant or collinear") from error

    # Cells are as wide in log sigma as their own peak.
    weights = np.exp(logs - logs.max()) * np.array([sd for _, sd, _ in peaks])[:, None]
    weights /= weights.sum()
    flat = weights.ravel().cumsum()

    def shown(theta: np.ndarray) -> dict[str, np.ndarray]:
        return {"beta": theta[:k] / sx, "gamma": theta[k:q] / z_scale}

    # Bounded by the number of draws and slopes; tasks need the draws next to every region.
    random = [np.random.default_rng([seed, chain, d]) for chain in range(chains) for d in range(draws)]
    cell = np.searchsorted(flat, np.array([r.random() for r in random]) * flat[-1])
    at_rho, at_sigma = np.divmod(np.minimum(cell, len(flat) - 1), SIGMAS)
    step = (steps[1] - steps[0]) * np.array([sd for _, sd, _ in peaks])
    log_sigma = places[at_rho, at_sigma] + step[at_rho] * (np.array([r.random() for r in random]) - 0.5)
    wider = np.exp(log_sigma - places[at_rho, at_sigma])
    theta = np.zeros((len(random), q))
    for g in np.unique(at_rho):
        some = np.flatnonzero(at_rho == g)
        noise = np.array([random[i].standard_normal(q) for i in some])
        upper = np.swapaxes(cells[g][1][at_sigma[some]], 1, 2)
        theta[some] = cells[g][2][at_sigma[some]] + wider[some, None] * np.linalg.solve(upper, noise[:, :, None])[:, :, 0]
    s2 = np.exp(2.0 * log_sigma)
    rho_of = np.array([p.rho for p in fine])

    def region_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, region = vector(batch, "g"), vector(batch, "region_index")
            rows = np.column_stack([vector(batch, c) for c in sums])
            for i in range(batch.num_rows):
                mine = np.flatnonzero(at_rho == g[i])
                b, weight = rows[i, :-1], rows[i, -1] + prior * s2[mine]
                mean = (b[q] - theta[mine] @ b[:q]) / weight
                noise = np.random.default_rng([seed, 1, int(region[i]), int(g[i])]).standard_normal(len(mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine.astype(np.int32)), pa.array(np.full(len(mine), region[i], np.int32)),
                     pa.array(mean + noise * np.sqrt(s2[mine] / weight))], ["d", "region_index", "a"])

    def region_mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = vector(batch, "g")
            rows = np.column_stack([vector(batch, c) for c in sums])
            mean = np.zeros(len(g))
            for i, (point, weight, mu, variance) in enumerate(grid):
                some = g == point
                mean[some] += weight * (rows[some, q] - rows[some, :q] @ mu) / (rows[some, -1] + prior * variance)
            yield pa.RecordBatch.from_arrays(
                [batch.column("region_index"), pa.array(mean)], ["region_index", "a"])

    grid = [(g, weights[g, i], cells[g][2][i], np.exp(2 * places[g, i]))
            for g, i in zip(*np.nonzero(weights > 1e-10))]
    mean = sum(w * mu for _, w, mu, _ in grid)

    spark = design.sparkSession
    by_draw = regions.mapInArrow(region_draws, "d int, region_index int, a double").groupBy("d").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("region_index", "a"))), lambda v: v["a"]).alias("a_region"))

    def one(i: int) -> dict[str, object]:
        sigma = float(np.sqrt(s2[i]))
        return {**shown(theta[i]), "sigma": sigma, "sigma_a": sigma * float(np.sqrt(rho_of[at_rho[i]]))}

    core_table = make_draws(spark, fit, None, draws, chains, seed, known=one)
    number = (F.col("chain") - 1) * draws + F.col("draw") - 1
    draw_table = core_table.drop("a_region").withColumn("d", number.cast("int")).join(
        by_draw, "d").select([c.split()[0] for c in DRAW_SCHEMA.split(", ")])
    region_means = regions.mapInArrow(region_mean, "region_index int, a double").groupBy(
        "region_index").agg(F.sum("a").alias("a")).join(second.regions, "region_index")

    def intercepts(count: int = 200) -> DataFrame:
        """``(group, a array)``: draws of each group's intercept, one row a group, that go with
        the first draws of the fit."""
        count_ = min(count, len(theta))
        b, d = theta[:count_, :k], theta[:count_, k:]
        v2 = s2[:count_]
        t2 = v2 * rho_of[at_rho[:count_]]
        of_region = (
            regions.mapInArrow(region_draws, "d int, region_index int, a double").where(F.col("d") < count_)
            .groupBy("region_index").agg(F.transform(
                F.array_sort(F.collect_list(F.struct("d", "a"))), lambda v: v["a"]).alias("u")))

        def run(batches):
            for batch in batches:
                n, s, t, z = group_arrays(batch)
                u = matrix(batch, "u", count_)
                prec = n[:, None] / v2 + 1.0 / t2
                mu = ((t[:, None] - s @ b.T) / v2 + (z @ d.T + u) / t2) / prec
                keys = [crc32(str(g).encode()) for g in batch.column(group).to_pylist()]
                noise = [np.random.default_rng([seed, 2, c]).standard_normal(count_) for c in keys]
                a = mu + np.array(noise) / np.sqrt(prec)
                yield pa.RecordBatch.from_pydict(
                    {group: batch.column(group), "a": pa.array(list(a))}
                )

        key = table.schema[group].dataType.simpleString()
        return table.join(of_region, "region_index").mapInArrow(run, f"`{group}` {key}, a array<double>")

    return VaryingNormalFit(
        fit, list(names), m.n, j, second.regions, shown(mean), region_means, draw_table, intercepts
    )
