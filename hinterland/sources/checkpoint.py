"""Reliable materialisation of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where none is set, a folder of the warehouse is taken, which all executors share too.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:
        return
    if configured:
        sc.setCheckpointDir(configured)
    else:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with its lineage cut, so a
    lost executor re-reads files and never re-derives partition contents."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own beside the checkpoints and read it back.
    ``discard`` removes it once nothing reads it any more."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or (
        f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
