"""From block-level measurement files to weighted measures around institutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.functions.scalar import AREA_CODE_LENGTH, area_code, paste
from hinterland.operators.aggregates import merge_rollups, rollup, weighted_mean
from hinterland.operators.distance import nearest_join, popdist_weighted_mean
from hinterland.operators.frame import apply_to_columns
from hinterland.sources.delimited import read_table, text_schema, write_table

# Fixed values.
MEASURES = ["download", "upload", "pcount"]
MEASURE_COLUMNS = ["fullfipsid", "transtech", "frn", "downloadspeed", "uploadspeed"]
OUTSIDE_CONTINENT = ["02", "15", "72"]
NO_STATE = ["11", "72"]
METRES_TO_MILES = 0.000621371
WEIGHTED_DIGITS = 4


def read_measures(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Pipe-delimited delivery as text. ``columns`` is its full header, in order; only the
    ones used are parsed."""
    return read_table(spark, path, text_schema(*columns), sep="|").select(*MEASURE_COLUMNS)


PERIOD = ["year", "mon"]


def block_group_measures(
    raw: DataFrame, n_chars: int = AREA_CODE_LENGTH["block_group"], by: Sequence[str] = PERIOD,
    **options,
) -> DataFrame:
    """One source rolled up to block groups, for all its periods at once. Technologies
    count alike, so their code is set to one value and only the row count matters."""
    return rollup(
        raw.withColumn("transtech", F.lit(1)), "fullfipsid", n_chars, "frn",
        {"download": "downloadspeed", "upload": "uploadspeed"}, by=by, **options,
    ).withColumnRenamed("fullfipsid", "fips")


def merged_measures(
    sources: Sequence[DataFrame], by: Sequence[str] = PERIOD, **options
) -> DataFrame:
    """Block groups by period over all sources."""
    return merge_rollups(
        [block_group_measures(s, by=by, **options) for s in sources], ["fips", *by]
    )


def store_measures(sources: Sequence[DataFrame], path: str, **options) -> None:
    """Write the merged table partitioned by period, so that readers of one period skip
    the others."""
    write_table(merged_measures(sources, **options), path, partition_by=PERIOD, sort_by=["fips"])


def block_group_centres(raw: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``(stfips, fips, pop, lon, lat)`` of the centre file, some states left out."""
    return raw.where(~F.col("statefp").isin(list(exclude)) if exclude else F.lit(True)).select(
        F.col("statefp").alias("stfips"),
        paste("statefp", "countyfp", "tractce", "blkgrpce").alias("fips"),
        F.col("population").alias("pop"),
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
    )


def weighted_measures(
    panel: DataFrame, measures: DataFrame, centres: DataFrame, decay: float = 2.0
) -> DataFrame:
    """Distance-weighted measures of every institution and period, in one job.

    Periods are grouping keys, not passes: all of them, and all three measures, share the
    work. Institutions are taken once a year.
    """
    places = (
        panel.where(~F.col("stabbr").isin("AK", "HI"))
        .groupBy("unitid", "year")
        .agg(F.min_by("lon", F.struct("lon", "lat")).alias("lon"),
             F.min_by("lat", F.struct("lon", "lat")).alias("lat"))
    )
    periods = measures.select("year", "mon").distinct()
    located = (
        measures.where(F.col("download").isNotNull())
        .select("fips", "year", "mon", *MEASURES)
        .join(centres.select("fips", "pop", "lon", "lat"), "fips")
    )
    out = popdist_weighted_mean(
        places.join(periods, "year"), located, MEASURES, "unitid", by=["year", "mon"], decay=decay
    )
    weighted = [c for c in out.columns if c not in ("unitid", "year", "mon")]
    return apply_to_columns(out, weighted, lambda c: F.bround(c, WEIGHTED_DIGITS))


def county_measures(measures: DataFrame, centres: DataFrame) -> DataFrame:
    """Population-weighted measures by county and period; a NULL makes its county NULL."""
    joined = measures.select("fips", "year", "mon", *MEASURES).join(
        centres.select("fips", "pop"), "fips"
    )
    return weighted_mean(
        joined.withColumn("fips", area_code("fips", "county")),
        MEASURES, "pop", ["fips", "year", "mon"], na_propagate=True,
    )


def nearest_mean_distance(institutions: DataFrame, centres: DataFrame) -> DataFrame:
    """Population-weighted mean miles to the nearest open-admissions institution by state
    and year. States without one give no row."""
    ends = institutions.where(F.col("openadmp") == 1).select("unitid", "stfips", "year",
                                                             "lon", "lat")
    asked = ends.select("stfips", "year").distinct()
    starts = centres.join(asked, "stfips")
    nearest = nearest_join(starts, ends, "fips", "unitid", ["stfips", "year"])
    weights = centres.select("fips", "pop")
    return weighted_mean(
        nearest.join(weights, "fips").withColumnRenamed("meters", "pwm_dist_oa"),
        ["pwm_dist_oa"], "pop", ["stfips", "year"], scale=METRES_TO_MILES, na_propagate=True,
    )
