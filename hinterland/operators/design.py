"""Design matrices and their cross-products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.sources.checkpoint import materialise

JVM_COLUMNS = 12  # wider cross-products would outgrow one generated method


def square_terms(measures: Sequence[str]) -> list[str]:
    """Each measure followed by its square."""
    return [t for m in measures for t in (m, f"{m}_sq")]


def design_matrix(
    df: DataFrame,
    y: str,
    measures: Sequence[str],
    covariates: Sequence[str],
    group: str | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """``(keep, group, y, x array)`` of the complete rows, and the names of x: each
    measure and its square, then the covariates."""
    names = [*square_terms(measures), *covariates]
    values = [v for m in measures for v in (F.col(m), F.col(m) * F.col(m))]
    values += [F.col(c) for c in covariates]
    ids = [*keep, *([group] if group else [])]
    used = list(dict.fromkeys([y, *measures, *covariates, *([group] if group else [])]))
    out = df.dropna(subset=used).select(
        *ids, F.col(y).cast("double").alias("y"),
        F.array(*[v.cast("double") for v in values]).alias("x"),
    )
    return out, names


def sizes(design: DataFrame, group: str | None = None, region: str | None = None) -> DataFrame:
    """Row, column and group counts in one pass."""
    aggs = [F.count("*").alias("N"), F.max(F.size("x")).alias("K")]
    if group:
        aggs.append(F.count_distinct(group).alias("J"))
    if region:
        aggs.append(F.count_distinct(region).alias("R"))
    return design.agg(*aggs)


def centre_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Subtract column means: one aggregation pass, no square matrices."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m"))
    shifted = df.withColumn("_m", means.scalar())
    return shifted.withColumns({c: F.col(c) - F.col("_m").getField(c) for c in cols}).drop("_m")


def gram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle of the cross-product matrix: ``(i, j, value)`` by column name.

    Narrow matrices are sums of products in generated code. Wide ones are multiplied a
    batch at a time; each task sends one row per entry either way.
    """
    cols = list(cols)
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    if len(cols) <= JVM_COLUMNS:
        sums = df.agg(*[F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"s{k}")
                        for k, (a, b) in enumerate(pairs)])
        entries = F.explode(F.array(*[
            F.struct(F.lit(cols[a]).alias("i"), F.lit(cols[b]).alias("j"),
                     F.col(f"s{k}").cast("double").alias("value"))
            for k, (a, b) in enumerate(pairs)
        ]))
        return sums.select(entries.alias("e")).select("e.*")

    width = len(cols)
    rows = df.dropna(subset=cols).select(
        F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    )

    def product(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch, "x", width)
        return (x.T @ x).ravel()

    names = F.array(*[F.lit(c) for c in cols])
    r, c = F.floor(F.col("pos") / width).cast("int"), (F.col("pos") % width).cast("int")
    return (
        block_sums(rows, product, width * width)
        .where(r <= c)
        .select(names[r].alias("i"), names[c].alias("j"), "value")
    )


def matrix(batch: pa.RecordBatch, col: str, width: int) -> np.ndarray:
    """Array column of a batch as a matrix, without a copy per row."""
    flat = batch.column(col).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(batch.num_rows, width)


def vector(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).to_numpy(zero_copy_only=False)


def block_sums(
    df: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], width: int
) -> DataFrame:
    """Sum of ``kernel(batch)`` over all batches as ``(pos, value)``. A task adds up its own
    batches and sends ``width`` rows; Spark adds up the tasks."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        yield pa.RecordBatch.from_pydict(
            {"pos": pa.array(np.arange(width), pa.int32()), "value": pa.array(total)}
        )

    return df.mapInArrow(run, "pos int, value double").groupBy("pos").agg(
        F.sum("value").alias("value")
    )


def small_vector(sums: DataFrame, width: int) -> np.ndarray:
    """Bring a fixed-width vector of sums to the driver."""
    out = np.zeros(width)
    for row in sums.collect():
        out[row["pos"]] = row["value"]
    return out


@dataclass(frozen=True)
class Moments:
    """Means, scales and centred cross-products of (x, y); its size depends on the number
    of columns only. ``cross`` is of the centred and scaled columns."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    cross: np.ndarray

    @property
    def k(self) -> int:
        return len(self.mean) - 1

    @property
    def condition(self) -> float:
        """Condition number of the centred, scaled x'x."""
        return float(np.linalg.cond(self.cross[:-1, :-1]))

    def require_full_rank(self, limit: float = 1e13) -> None:
        if not self.condition < limit:
            raise ValueError(f"design columns are collinear (condition {self.condition:.1e})")

    def triangle(self) -> ThinQR:
        """R by Cholesky of the cross-products."""
        low = np.linalg.cholesky(self.cross[:-1, :-1])
        half = np.linalg.solve(low, self.cross[:-1, -1])
        r = np.zeros_like(self.cross)
        r[:-1, :-1], r[:-1, -1] = low.T, half
        r[-1, -1] = np.sqrt(max(self.cross[-1, -1] - half @ half, 0.0))
        return ThinQR(self.n, self.mean, self.scale, r)

    def subset(self, positions: Sequence[int]) -> Moments:
        """Moments of fewer x columns: one wide pass serves every smaller model."""
        keep = [*positions, self.k]
        return Moments(self.n, self.mean[keep], self.scale[keep], self.cross[np.ix_(keep, keep)])


def moments(design: DataFrame, k: int) -> Moments:
    """Two passes over a ``(y, x)`` table. The first finds means and spreads; the second
    multiplies centred, scaled columns, so that x and x**2 stay distinguishable and large
    means cost no digits."""
    cols = [F.col("x")[i] for i in range(k)] + [F.col("y")]
    first = design.agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("sd"),
    ).first()
    if not first["n"]:
        raise ValueError("no complete rows")
    mean = np.array(first["mean"], float)
    scale = np.array(first["sd"], float)
    if (flat := np.flatnonzero(scale[:-1] == 0)).size:
        raise ValueError(f"constant design columns at positions {flat.tolist()}")
    scale[scale == 0] = 1.0

    def product(batch: pa.RecordBatch) -> np.ndarray:
        xy = np.column_stack([matrix(batch, "x", k), vector(batch, "y")])
        xy = (xy - mean) / scale
        return (xy.T @ xy).ravel()

    width = (k + 1) ** 2
    cross = small_vector(block_sums(design.select("y", "x"), product, width), width)
    return Moments(int(first["n"]), mean, scale, cross.reshape(k + 1, k + 1))


def cholesky_r(m: Moments) -> np.ndarray:
    """Upper triangular R of the thin QR of the centred x, scaled by ``1/sqrt(N-1)``. It squares
    the condition of x; ``thin_qr`` doesn't."""
    s = np.linalg.cholesky(m.cross[:-1, :-1]).T * m.scale[:-1]
    return s / np.sqrt(m.n - 1)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR with no negative diagonal entry, square even for few rows."""
    r = np.zeros((rows.shape[1], rows.shape[1]))
    got = np.linalg.qr(rows, mode="r")
    r[:len(got)] = got
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


@dataclass(frozen=True)
class ThinQR:
    """R of the centred and scaled columns (x, y), found without cross-products."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    r: np.ndarray

    @property
    def k(self) -> int:
        return len(self.mean) - 1

    @property
    def condition(self) -> float:
        """Condition number of the centred, scaled x."""
        return float(np.linalg.cond(self.r[:-1, :-1]))

    def require_full_rank(self, limit: float = 1e13) -> None:
        if not self.condition < limit:
            raise ValueError(f"design columns are collinear (condition {self.condition:.1e})")

    def subset(self, positions: Sequence[int]) -> ThinQR:
        """R of fewer x columns, from the wide R alone."""
        keep = [*positions, self.k]
        return ThinQR(self.n, self.mean[keep], self.scale[keep], _triangle(self.r[:, keep]))

    def factor(self) -> np.ndarray:
        """R of the thin QR of the centred x in its own units, scaled by ``1/sqrt(N-1)``."""
        return self.r[:-1, :-1] * self.scale[:-1] / np.sqrt(self.n - 1)


#: Triangles that one task stacks into one, and rows that are added to a triangle at once.
TREE_FAN, TREE_ROWS = 64, 4096


def thin_qr(design: DataFrame, k: int) -> ThinQR:
    """Tall-skinny QR of a ``(y, x)`` table: each task keeps the R of the rows it has met, and the
    triangles of the tasks are stacked and reduced in a tree.

    A first pass finds means and spreads. They only bring the columns to one size: a column of
    ones goes first and takes up what rounding leaves of the means, so nearly collinear columns
    such as x and x**2 keep all their digits. Two passes over the rows; a triangle has a row for
    each column, so tasks and driver hold a few small matrices.
    """
    cols = [F.col("x")[i] for i in range(k)] + [F.col("y")]
    first = design.agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("sd")).first()
    if not first["n"]:
        raise ValueError("no complete rows")
    mean, scale = np.array(first["mean"], float), np.array(first["sd"], float)
    if (flat := np.flatnonzero(scale[:-1] == 0)).size:
        raise ValueError(f"constant design columns at positions {flat.tolist()}")
    scale[scale == 0] = 1.0
    width = k + 2
    schema = "part long, r array<double>"

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            xy = np.column_stack([matrix(batch, "x", k), vector(batch, "y")])
            rows = np.column_stack([np.ones(len(xy)), (xy - mean) / scale])
            for a in range(0, len(rows), TREE_ROWS):
                r = _triangle(np.vstack([r, rows[a:a + TREE_ROWS]]))
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    def stack(table: pa.Table) -> pa.Table:
        # In the order of the parts, so that a repeated task gives the same digits.
        rows = table.sort_by("part").column("r").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "part": pa.array([min(table.column("part").to_pylist()) // TREE_FAN], pa.int64()),
            "r": pa.array([_triangle(rows.reshape(-1, width)).ravel()], pa.list_(pa.float64()))})

    parts = materialise(design.select("y", "x").mapInArrow(reduce_rows, schema))
    left = parts.agg(F.max("part")).first()[0] + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("part") / TREE_FAN)).applyInArrow(stack, schema)
        left = -(-left // TREE_FAN)
    r = np.array(parts.first()["r"], float).reshape(width, width)
    return ThinQR(int(first["n"]), mean, scale, r[1:, 1:])


def triangle_entries(spark: SparkSession, r: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Upper triangle of a small matrix as ``(i, j, value)`` by column name."""
    return spark.createDataFrame(
        [(names[i], names[j], float(r[i, j])) for i in range(len(r)) for j in range(i, len(r))],
        "i string, j string, value double")
