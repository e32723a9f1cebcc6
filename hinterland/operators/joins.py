"""Joins with explicit NULL and column rules.

No side is broadcast by hint. Spark compares the measured size of a side with
``spark.sql.autoBroadcastJoinThreshold`` (at planning time from file statistics, at run
time from shuffle sizes) and falls back to a shuffle join, whose hot keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on shared names; with ``null_safe`` a NULL key matches a NULL key.
    Columns of the left side keep their order and come first."""
    on = list(on)
    semi = how in ("left_semi", "left_anti")
    added = [] if semi else [c for c in right.columns if c not in on]
    if not null_safe:
        return left.join(right, on, how).select(*left.columns, *added)
    l, r = left.alias("_l"), right.alias("_r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in on]
    )
    joined = l.join(r, same, how)
    if semi:
        return joined

    def key(k: str) -> Column:
        a, b = F.col(f"_l.`{k}`"), F.col(f"_r.`{k}`")
        # Where only one side has the row, its key is the key.
        return {"left": a, "inner": a, "right": b}.get(how, F.coalesce(a, b)).alias(k)

    return joined.select(
        *[key(c) if c in on else F.col(f"_l.`{c}`") for c in left.columns],
        *[F.col(f"_r.`{c}`") for c in added],
    )


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    key: str | Sequence[str],
    columns: Sequence[str] | None = None,
    null_safe: bool = False,
    check: bool = False,
) -> DataFrame:
    """Left join to a table with one row per key. ``check`` first counts the keys and
    refuses a table that would multiply rows."""
    on = [key] if isinstance(key, str) else list(key)
    dim = dimension if columns is None else dimension.select(*on, *columns)
    if check and not dim.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError(f"more than one row for a key in {on}")
    return keyed_join(df, dim, on, "left", null_safe)


def left_chain(
    spine: DataFrame, parts: Iterable[DataFrame], on: str | Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Left join any number of keyed tables onto a spine. All joins share one key, so
    the spine is shuffled at most once."""
    on = [on] if isinstance(on, str) else list(on)
    return reduce(lambda a, b: keyed_join(a, b, on, "left", null_safe), parts, spine)


def natural_left_join(x: DataFrame, *ys: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on all shared column names, folded from left to right."""
    out = x
    for y in ys:
        common = [c for c in out.columns if c in y.columns]
        if not common:
            raise ValueError("no common columns to join on")
        out = keyed_join(out, y, common, "left", null_safe)
    return out


def join_renamed(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Join ``left.k == right.v`` for each pair; the left name survives."""
    renamed = right.withColumnsRenamed({v: k for k, v in keys.items()})
    return keyed_join(left, renamed, list(keys), how)


def members(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in another table, each kept once."""
    pool = other.select(F.col(other_key or key).alias(key))
    return keyed_join(df, pool, [key], "left_semi")


def attach_row(df: DataFrame, row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Put the values of a one-row table on every row, by scalar subquery: Spark runs it
    once and fails if it gives more than one row."""
    return df.withColumns({c: row.select(c).scalar() for c in columns})
