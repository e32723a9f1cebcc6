"""Distance-weighted means and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.functions.geo import EARTH_RADIUS_M, great_circle, unit_vector
from hinterland.operators.cells import POINTS, cells, nearest_points
from hinterland.operators.kernel_sums import kernel_sums


def popdist_weighted_mean(
    x: DataFrame,
    y: DataFrame,
    measures: Sequence[str],
    x_id: str,
    by: Sequence[str] = (),
    decay: float = 2.0,
    min_dist: float = 1.0,
    pop: str = "pop",
    lon: str = "lon",
    lat: str = "lat",
    prefix: str | None = None,
    x_block: int = 1024,
    y_block: int = 256,
    partitions: int | None = None,
) -> DataFrame:
    """Population and inverse-distance weighted mean of every measure around each point.

    For each row of ``x``: ``sum(m * pop * d**-decay) / sum(pop * d**-decay)`` over all
    rows of ``y`` in the same ``by`` group, where NULL measures drop out of both sums. Rows of
    ``x`` without coordinates, or whose group (a NULL one too) has no ``y``, get NULL measures.
    ``x_id`` must be unique within ``by``.

    y is first summed to one row a location. ``x`` is cut into blocks of at most ``x_block``
    places, and a task adds up what one block sees: areas near it one by one, those farther away
    through charges on the grids of their cells (``kernel_sums``), for all measures at once. Cells
    of at most ``y_block`` areas are met one by one at any distance, so small tables are added up
    pair by pair. The work grows with x times the logarithm of y, in any ``by`` group.
    """
    spark = x.sparkSession
    by, measures = list(by), list(measures)
    prefix = f"pdw{decay:g}_" if prefix is None else prefix
    sums = [f"num_{i}" for i in range(len(measures))] + [f"den_{i}" for i in range(len(measures))]

    xs = x.select(*by, x_id, lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    ys = y.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(pop).isNotNull())

    located = ys.groupBy(*by, lon, lat).agg(
        *[F.sum(F.col(pop) * F.col(m)).alias(f"num_{i}") for i, m in enumerate(measures)],
        *[
            F.sum(F.when(F.col(m).isNotNull(), F.col(pop))).alias(f"den_{i}")
            for i, m in enumerate(measures)
        ],
    )

    n = partitions or max(spark.sparkContext.defaultParallelism, _shuffle_partitions(spark))
    power = float(decay)

    def weight(chord: np.ndarray, out: np.ndarray, most: float) -> np.ndarray:
        # From squared chord to squared metres along the sphere, then to weights, in place.
        terms = arc_terms(most)
        if terms is None:
            np.sqrt(chord, out=out)
            np.arcsin(np.minimum(np.multiply(out, 0.5, out=out), 1.0, out=out), out=out)
            np.multiply(np.multiply(out, out, out=out), (2.0 * EARTH_RADIUS_M) ** 2, out=out)
        else:
            out[...] = terms[-1] * EARTH_RADIUS_M**2
            for c in terms[-2::-1]:
                np.add(np.multiply(out, chord, out=out), c * EARTH_RADIUS_M**2, out=out)
            np.multiply(out, chord, out=out)
        np.maximum(out, min_dist**2, out=out)
        if power == 2.0:
            return np.divide(1.0, out, out=out)
        if power == 1.0:
            return np.divide(1.0, np.sqrt(out, out=out), out=out)
        return np.power(out, -power / 2, out=out)

    partial = kernel_sums(
        cells(xs, by, [x_id], lon, lat, x_block).leaves, _with_vector(located, [*by, *sums], lon, lat),
        by, sums, x.schema[x_id], weight, min_dist, y_block, n)
    # Rows of x that meet no y are in no block; a row of NULL sums each leaves the others as they are.
    every = x.select(*by, x_id, *[F.lit(None).cast("double").alias(s) for s in sums])
    return (
        partial.unionByName(every).groupBy(*by, x_id)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by, x_id,
            *[
                F.try_divide(F.col(f"num_{i}"), F.nullif(F.col(f"den_{i}"), F.lit(0.0)))
                .alias(f"{prefix}{m}")
                for i, m in enumerate(measures)
            ],
        )
    )


#: The squared arc is the sum of these times powers of the squared chord, from the first on.
_ARC = [2.0 / (n * n * comb(2 * n, n)) for n in range(1, 40)]


def arc_terms(most: float) -> list[float] | None:
    """As many terms of the squared arc as squared chords up to ``most`` need for all digits; None
    where these would take longer than an arcsine."""
    for n in range(1, 17):
        if _ARC[n] * most**n < 1e-16:
            return _ARC[:n]
    return None


def _shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _with_vector(df: DataFrame, keep: Sequence[str], lon: str, lat: str) -> DataFrame:
    ux, uy, uz = unit_vector(lon, lat)
    return df.select(*keep, ux.alias("_ux"), uy.alias("_uy"), uz.alias("_uz"))


def nearest_join(
    starts: DataFrame,
    ends: DataFrame,
    start_id: str,
    end_id: str,
    by: Sequence[str],
    lon: str = "lon",
    lat: str = "lat",
    cell: int = POINTS,
) -> DataFrame:
    """Nearest end for each start within the same ``by`` group.

    Returns ``(*by, start_id, end_id, meters)``; ties go to the smallest ``end_id`` and
    starts whose group has no end give no row. Rows without coordinates take no part.

    Ends are reduced to distinct locations. Starts and ends are dealt into cells of at most
    ``cell`` points of one group, cut by rank, so that a dense place or a group with most rows is
    many cells. Pairs of cells are pruned from the top of both trees by exact bounds; the arrays
    of the pairs left are compared in tasks, so no start meets its whole group and nothing is
    keyed by the group alone.
    """
    if not by:
        raise ValueError("nearest_join needs at least one grouping column")
    by = list(by)
    located = (F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    places = (
        ends.where(located)
        .groupBy(*by, F.col(lon).alias("_elon"), F.col(lat).alias("_elat"))
        .agg(F.min(end_id).alias("_end"))
    )
    seekers = starts.where(located).select(
        *by, F.col(start_id).alias("_start"), F.col(lon).alias("_slon"), F.col(lat).alias("_slat"))
    start_cols, end_cols = ["_start", "_slon", "_slat"], ["_end", "_elon", "_elat"]
    pairs = nearest_points(
        cells(seekers, by, start_cols, "_slon", "_slat", cell),
        cells(places, by, end_cols, "_elon", "_elat", cell),
        [seekers.schema[c] for c in start_cols], [places.schema[c] for c in end_cols])
    best = F.min(F.struct(
        great_circle("_slon", "_slat", "_elon", "_elat").alias("meters"), "_end")).alias("best")
    return pairs.groupBy(*by, F.col("_start").alias(start_id)).agg(best).select(
        *by, start_id, F.col("best._end").alias(end_id), "best.meters")
