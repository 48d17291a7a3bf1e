"""Intermediate tables in the folder that the whole cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset (tests, a laptop) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run.  A written table cuts lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.read(table, df.schema)

    def read(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Delete a table that no later plan reads."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(self.path(table))
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
