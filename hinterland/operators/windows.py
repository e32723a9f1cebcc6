"""Indexes, group means and first rows, written so that no group has to fit in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinterland.operators.joins import keyed_join, lookup
from hinterland.sources.checkpoint import materialise


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: Column,
    name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cumulative sum of ``weight`` in ``order`` within ``by``, without a window over the
    whole group.

    Rows are range-partitioned by (by, order), so a large group covers many partitions.
    Each partition sums its own rows; the totals of the partitions before it, one small
    row for each (by, partition), are added afterwards. The partition number is written
    to the checkpoint folder first, so it cannot change when a task is re-run.
    """
    by, order = list(by), list(order)
    slices = materialise(
        df.withColumn("_w", weight)
        .repartitionByRange(*by, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        slices.groupBy(*by, "_slice").agg(F.sum("_w").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    return (
        keyed_join(
            slices.withColumn("_own", F.sum("_w").over(within)),
            before, [*by, "_slice"], "inner", null_safe=True,
        )
        .withColumn(name, F.col("_own") + F.col("_before"))
        .drop("_w", "_own", "_before", "_slice")
    )


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per distinct non-NULL key with its position (from 1) in sorted order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = running_total(keys, [key], F.lit(1), name)
    return ranked.withColumn(name, F.col(name).cast("int"))


def with_dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    return lookup(df, dense_index(df, key, name), key)


def group_mean(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], digits: int | None = None,
    suffix: str = "_p", rounding=F.bround,
) -> DataFrame:
    """One row per group with the mean of each column, ready for a join back. A window
    would sort every group in one task; this sums before it shuffles."""
    def mean(c: str) -> Column:
        m = F.avg(c)
        return (m if digits is None else rounding(m, digits)).alias(f"{c}{suffix}")

    return df.groupBy(*by).agg(*[mean(c) for c in cols])


def with_group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str], **kw) -> DataFrame:
    return lookup(df, group_mean(df, by, cols, **kw), list(by))


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls: str = "first"
) -> DataFrame:
    """First row of each key in ascending ``order``, all columns kept.

    ``min`` over a struct replaces ``row_number``: each task reduces a key to one row
    before the shuffle, so a key that holds a third of the table is no bottleneck. The
    remaining columns follow ``order`` in the struct and settle ties.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = [F.col(c).isNull() for c in order] if nulls == "last" else []
    ranked = []
    for i, c in enumerate(order):
        if first:
            ranked.append(first[i].alias(f"_null_{i}"))
        ranked.append(F.col(c).alias(f"_order_{i}"))
    packed = F.struct(*ranked, *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    picked = {c: F.col(f"_first._order_{i}") for i, c in enumerate(order)}
    picked.update({c: F.col("_first").getField(c) for c in rest})
    return out.select(*[F.col(c) if c in keys else picked[c].alias(c) for c in df.columns])
