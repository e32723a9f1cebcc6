"""Posterior-draw files: one CSV a chain, comment lines marked ``#``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed pattern: <model>_<family>_<sample>_<weighting>_<measure>_<chain>.csv
DRAW_FILE = r"([a-z]+)_([a-z]+)_([a-z]+)_[a-z0-9]+_([a-z]+)_(\d+)\.csv"
#: A name in a header: what is no number, and none of the words for what is not finite.
_WORD = r"^(?!(?i)(nan|inf|infinity)$)[A-Za-z_][\w.\[\],:-]*$"


def read_draws(
    spark: SparkSession, glob: str, prefix: str = "beta", scalars: tuple[str, ...] = ()
) -> DataFrame:
    """``(fit, model, family, sample, measure, chain, draw, <prefix> array, scalars)``.

    A draw file is a file, or a folder of part files, whose name ends like ``DRAW_FILE``. It is
    read by its own header, the one line that holds a name, wherever its lines were read, so fits of
    different width may lie in one folder. A draw that is not a number stays a row, as NaN. A
    file without a header or with two, and a line with another number of fields than its header,
    fail the read. A scalar that a file lacks is NULL. ``draw`` identifies a row; draws are
    exchangeable and it does not count from 1.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.text(glob).select(
        F.regexp_extract(path, rf"^(.*{DRAW_FILE})", 1).alias("file"), path.alias("_path"), F.trim("value").alias("value")
    ).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    lines = lines.select(
        F.when(F.col("file") != "", F.col("file")).otherwise(F.col("_path")).alias("file"), "value",
        F.split("value", ",").alias("fields"))
    is_header = F.exists("fields", lambda f: F.trim(f).rlike(_WORD))
    named = F.filter(F.col("header"), lambda c: c.rlike(rf"^{re.escape(prefix)}\.\d+$"))
    headers = (
        lines.where(is_header).groupBy("file").agg(F.first("fields").alias("found"), F.count("*").alias("n"))
        .select("file", F.when(F.col("n") == 1, F.transform("found", lambda f: F.trim(f))).otherwise(
            F.raise_error(F.concat(F.lit("more than one header in "), "file"))).alias("header"))
        .withColumn("vector", F.transform(
            F.array_sort(F.transform(named, lambda c: F.struct(
                F.element_at(F.split(c, "\\."), -1).cast("int").alias("k"), c.alias("c")))),
            lambda c: c["c"]))
    )
    rows = lines.where(~is_header).join(headers, "file", "left")
    wrong = F.raise_error(F.concat(
        F.when(F.col("header").isNull(), F.lit("no header in ")).otherwise(F.lit("fields differ from the header in ")),
        "file"))
    fits = F.size("fields") == F.size("header")
    # Both columns that a draw is made of carry the check.
    rows = rows.withColumns({
        "cells": F.when(fits, F.map_from_arrays("header", "fields")).otherwise(wrong),
        "vector": F.when(fits, F.col("vector")).otherwise(wrong)})
    name = F.regexp_extract("file", r"([^/=]*)$", 1)
    part = {n: i + 1 for i, n in enumerate(("model", "family", "sample", "measure", "chain"))}
    return rows.select(
        F.regexp_replace(name, r"_\d+\.csv$", "").alias("fit"),
        *[F.regexp_extract(name, f"^{DRAW_FILE}$", i).alias(n) for n, i in part.items() if n != "chain"],
        F.regexp_extract(name, f"^{DRAW_FILE}$", part["chain"]).try_cast("int").alias("chain"),
        F.monotonically_increasing_id().alias("draw"),
        F.transform("vector", lambda c: F.col("cells")[c].try_cast("double")).alias(prefix),
        *[F.col("cells")[F.lit(c)].try_cast("double").alias(c) for c in scalars],
    )
