"""Folders and tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir. Where that is not set, a local session gets one
    of this machine; executors of a cluster would not see it, so there it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="assize-")).as_uri()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Kept:
    """A table in the shared folder: what it holds is worked out once, its lineage ends there, and it can be dropped."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema, self.at = df.sparkSession, df.schema, shared_folder(df.sparkSession)
        df.write.parquet(self.at)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.at)

    def drop(self) -> None:
        dropped(self.spark, self.at)


def dropped(spark: SparkSession, at: str) -> None:
    """Removes a folder, if it is there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """`df` read back from a table in the shared folder."""
    return Kept(df).read()
