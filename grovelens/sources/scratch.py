"""Intermediate tables: a frame that several plans read is written once to the folder that driver and executors share.

A plan ends at the table, so that plans over it stay small, and a lost executor loses nothing of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and everything runs on this machine."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        own = tempfile.TemporaryDirectory(prefix="grovelens-")
        atexit.register(own.cleanup)
        _own_dir = f"file://{own.name}"
    return _own_dir


class Scratch:
    """Tables of one run; release() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame) -> DataFrame:
        place = f"{self.path}/{uuid.uuid4().hex}"
        frame.write.parquet(place)
        return self.spark.read.schema(frame.schema).parquet(place)

    def release(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
