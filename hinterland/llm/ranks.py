"""Places of rows in a global order, without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hinterland.llm.scratch import Scratch


def global_rank(rows: DataFrame, order: Sequence[str], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with their place from 1 in the ascending ``order``, which should tell all rows apart.

    Rows are dealt by ranges and written before they are numbered, so a repeated task finds the
    same ranges; only the size of each range reaches the driver.
    """
    ranged = scratch.keep(
        rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    starts, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):
        starts.append((part, total))
        total += n
    # One row a range: its size is set by the number of partitions.
    table = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_within", within).join(F.broadcast(table), "_part")
        .withColumn(name, (F.col("_within") + F.col("_start")).cast("long"))
        .drop("_part", "_within", "_start")
    )
