"""Cutting lineage in loops: reliable checkpoints, or rounds written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, or spark.checkpoint.dir; a temporary one in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="risklake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder: Spark knows its size, so that it can tell whether to broadcast it."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The rounds of a loop as Parquet in the shared folder, one folder each; a round is computed once, and its rows are counted as they are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", None

    def write(self, df: DataFrame, number: int, new: str = "true") -> tuple[DataFrame, int]:
        """The round as a table, and the number of its rows for which `new` holds."""
        seen = Observation()
        counted = df.observe(seen, F.count_if(F.expr(new)).alias("new"))
        counted.write.parquet(f"{self.path}/round={number}")
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={number}"), seen.get["new"]

    def all(self) -> DataFrame:
        """Every round's rows, with its number in `round`."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])).parquet(self.path)
