"""Named queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder; ``t.orders`` reads lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        # Reached once a table: the result then shadows this lookup.
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its oracle."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


# Stand-in coordinates and population of a key, in Spark and in SQL.

def lon(key: str) -> Column:
    return F.lit(-120) + ((F.col(key) * 7919) % 46500) / 1000.0


def lat(key: str) -> Column:
    return F.lit(25) + ((F.col(key) * 104729) % 25000) / 1000.0


def with_point(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lon": lon(key), "lat": lat(key), "pop": 1 + F.col(key) % 1000})


def sql_point(key: str) -> str:
    return (
        f"-120 + (({key} * 7919) % 46500) / 1000.0 AS lon, "
        f"25 + (({key} * 104729) % 25000) / 1000.0 AS lat, 1 + {key} % 1000 AS pop"
    )


def sql_metres(a: str, b: str) -> str:
    return (
        f"2 * 6378137.0 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) "
        f"+ cos(radians({a}.lat)) * cos(radians({b}.lat)) "
        f"* power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round result columns half away from zero, as the oracle's ``round`` does."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def sql_half_up(value: str, digits: int) -> str:
    """Half-up rounding of a double as it prints, which is what Spark's ``round`` does;
    DuckDB's own ``round`` of a double decides ties on the binary value."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"
