"""Choosing and naming source files, on a DataFrame of file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.functions.scalar import month_number
from hinterland.operators.windows import first_per_key


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, name, length)`` of the files under a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"
    )


def release_stem(name: Column | str) -> Column:
    """File name without revision mark and extension, lower-cased."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(c), r"(_rv)?\.[a-z0-9]+$", "")


def is_revision(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(c).rlike(r"_rv\.csv$")


def prefer_revision(
    files: DataFrame, name: str = "name", group: Sequence[str] = (), stem: Column | None = None
) -> DataFrame:
    """The revised file of each release where there is one, else the original."""
    ranked = files.withColumns({
        "stem": release_stem(name) if stem is None else stem,
        "_original": F.when(is_revision(name), F.lit(0)).otherwise(F.lit(1)),
    })
    return first_per_key(ranked, [*group, "stem"], ["_original", name]).drop("_original")


def route_sources(files: DataFrame, name: str = "name") -> DataFrame:
    """Sort delivered files into the two area kinds and name their tables.

    Keeps ``.txt`` and ``.csv`` files whose name mentions an address or census-block
    list; adds ``kind`` and ``table`` (the name with ``-`` replaced and no extension).
    """
    n = F.col(name)
    return (
        files.where(n.rlike(r"(?i)\.(txt|csv)$"))
        .withColumn("kind", F.when(n.rlike("(?i)address"), F.lit("address"))
                    .when(n.rlike("(?i)cblock"), F.lit("block")))
        .where(F.col("kind").isNotNull())
        .withColumn("table", F.regexp_replace(
            F.regexp_replace(n, r"\.[^.]*$", ""), "-", "_"))
    )


def period_table(release: Column | str) -> Column:
    """``All-NBM-CSV-June-2012`` style release name to ``June_2012``."""
    c = F.col(release) if isinstance(release, str) else release
    parts = F.split(F.translate(c, "-", "_"), "_")
    return F.concat_ws("_", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))


def with_period(df: DataFrame, table: str) -> DataFrame:
    """Month number and year from a ``Month_Year`` table name."""
    parts = F.split(F.col(table), "_")
    return df.withColumns({
        "mon": month_number(F.get(parts, F.lit(0))),
        "year": F.get(parts, F.lit(1)).try_cast("int"),
    })


def read_periods(
    spark: SparkSession, base: str, tables: Sequence[str]
) -> DataFrame:
    """Union of period tables stored as ``base/<Month_Year>``, with ``mon`` and ``year``."""
    out = None
    for t in tables:
        part = with_period(spark.read.parquet(f"{base}/{t}").withColumn("_t", F.lit(t)), "_t")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.drop("_t")


def store_period(df: DataFrame, base: str, by: Sequence[str] = ("year", "mon")) -> None:
    """Write rows into a table partitioned by period. Partitions that occur in ``df`` are replaced,
    all others stay, so loading a month again gives the same table."""
    (df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(base))
