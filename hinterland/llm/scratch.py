"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


#: Lists that want to know of every scratch that is made.
WATCHERS: list[list[Scratch]] = []


class Scratch:
    """Parquet tables of one run. They cut lineage, so a lost executor repeats one step only.

    ``drop`` removes a table that nothing reads any more; the rest go when the session's JVM
    ends, since the returned DataFrame still reads them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        for watcher in WATCHERS:
            watcher.append(self)
        self.root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._jvm_path(self.root, on_exit=True)
        self._paths: dict[int, str] = {}
        self._next = 0

    def _jvm_path(self, path: str, on_exit: bool = False) -> None:
        spark = self.spark
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if on_exit:
            files.mkdirs(place)
            files.deleteOnExit(place)
        else:
            files.delete(place, True)

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.root}/{self._next:03d}-{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back."""
        path = self.path(name)
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self._paths[id(back)] = path
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._jvm_path(frame._scratch_path)

    def rest(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing holds any more. It does so when
        the driver collects garbage, which a driver with little to do puts off."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()

    def close(self) -> None:
        """Remove all tables. What was returned must have been written elsewhere."""
        self._jvm_path(self.root)
        self.rest()
