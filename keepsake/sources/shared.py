"""Tables and files in the folder that a cluster's tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A session on this machine alone (tests) may name none and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"{tempfile.gettempdir()}/keepsake-checkpoints"
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing stands at."""
    return f"{folder(spark)}/keepsake/{name}-{uuid.uuid4().hex}"


class Levels:
    """Tables of one schema written level by level into one folder and read as one: a plan over all of them doesn't grow with their number."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, fresh(spark, name), None

    def add(self, level: int, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.schema, path = df.schema, f"{self.path}/level={level}"
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all levels, with `level`."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("level", IntegerType())])).parquet(self.path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
