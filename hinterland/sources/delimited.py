"""Delimited text in and out, with declared schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinterland.operators.frame import lower_names


def text_schema(*names: str) -> T.StructType:
    """All-string schema: area codes keep their leading zeros."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    sep: str = ",",
    names: Sequence[str] | None = None,
    lower: bool = True,
    header: bool = True,
) -> DataFrame:
    """Headed text to a typed table. Nothing is inferred, so the file is read once.
    ``names`` replaces the header's names, by position; otherwise they are lower-cased, and a
    header whose names or order differ from the schema's fails the read."""
    df = spark.read.csv(
        list(path) if not isinstance(path, str) else path,
        schema=schema, sep=sep, header=header,
        enforceSchema=names is not None or not header,
    )
    if names is not None:
        return df.toDF(*names)
    return lower_names(df) if lower else df


def reconcile(spark: SparkSession, path: str, df: DataFrame, header: bool = True) -> DataFrame:
    """One row: data lines in the source (headers taken off), rows in the table, and
    whether they agree."""
    lines = (
        spark.read.text(path)
        .where(F.length("value") > 0)
        .select(F.col("_metadata.file_path").alias("f"))
        .groupBy("f").agg(F.count("*").alias("n"))
        .agg(F.sum(F.col("n") - (1 if header else 0)).alias("source_rows"))
    )
    return lines.select(
        "source_rows", df.agg(F.count("*").alias("n")).scalar().alias("table_rows")
    ).withColumn("agree", F.col("source_rows") == F.col("table_rows"))


def load_text(
    spark: SparkSession, path: str, schema: T.StructType, target: str, sep: str = "|",
) -> tuple[DataFrame, dict[str, int]]:
    """Headed text without quotes into a Parquet table, and counts taken while it is written:
    ``lines`` that are not blank, ``headers`` among them, ``rows`` written and ``bad`` ones, with
    another number of fields than the schema. The source is read once."""
    seen, kept = Observation(), Observation()
    header = sep.join(schema.fieldNames()).lower()
    lines = spark.read.text(path).where(F.trim("value") != "")
    is_header = F.lower("value") == header
    lines = lines.observe(seen, F.count("*").alias("lines"), F.count_if(is_header).alias("headers"))
    fields = F.split("value", re.escape(sep), -1)
    width = len(schema)
    rows = lines.where(~is_header).select(fields.alias("f"), (F.size(fields) != width).alias("bad"))
    rows = rows.observe(kept, F.count("*").alias("rows"), F.count_if("bad").alias("bad"))
    rows.select(*[
        F.nullif(F.get("f", F.lit(i)), F.lit("")).try_cast(c.dataType).alias(c.name)
        for i, c in enumerate(schema)]).write.parquet(target)
    return spark.read.schema(schema).parquet(target), {**seen.get, **kept.get}


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Write a hand-off table. Sorting is local to each output file: a total order would
    cost a shuffle and no reader relies on it."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("quoteAll", False).csv(path)
    else:
        writer.format(format).save(path)


def write_extracts(
    df: DataFrame, base: str, extracts: Mapping[str, Column], whole: str = "all"
) -> dict[str, str]:
    """Write the whole table once, then each named subset from the written copy, so the
    plan behind ``df`` runs a single time and nothing has to be cached."""
    paths = {whole: f"{base}/{whole}"}
    write_table(df, paths[whole])
    stored = df.sparkSession.read.parquet(paths[whole])
    for name, condition in extracts.items():
        paths[name] = f"{base}/{name}"
        write_table(stored.where(condition), paths[name])
    return paths


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """First rows and row count, both lazy."""
    return df.limit(n), df.agg(F.count("*").alias("n"))


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Create or replace a catalog table."""
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)
