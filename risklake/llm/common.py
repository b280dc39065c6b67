"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' word patterns exclude it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own, or spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="risklake-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle_as_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through compressed Parquet in the shared folder: for rows that carry whole texts."""
    return settle_at(df, name)[0]


def settle_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """settle_as_table(), and the folder that it made."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of settle_at() that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no frame has a column so called (names are told apart regardless of case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Copies of a row that stay together when they are dealt out.
TOGETHER = 1024


def row_key(docs: DataFrame) -> list[Column]:
    """_a and _b, 128 bits over all columns. Nulls count (Spark's hash skips them), maps are hashed as JSON."""
    parts = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value]
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(1), *parts).alias("_b")]


def copies(counted: DataFrame) -> DataFrame:
    """counted(..., _rows) -> a row for each of the _rows that repeat whole, numbered by _copy from 0, in lots of TOGETHER (_lot).
    Lots are dealt out before they are unfolded, so that no task makes all copies of a row."""
    lots = counted.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / TOGETHER))))
    last = F.least(F.col("_rows") - 1, (F.col("_lot") + 1) * TOGETHER - 1)
    keys = [c for c in counted.columns if c != "_rows"]
    return lots.repartition(*keys, "_lot").withColumn("_copy", F.explode(F.sequence(F.col("_lot") * TOGETHER, last))).drop("_rows")


def copy_hash(base: Column) -> Column:
    """base for the first of rows that repeat whole, another hash for each other one."""
    return F.when(F.col("_copy") == 0, base).otherwise(F.xxhash64(base, "_copy"))


def whole_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs -> _a, _b, _lot, _doc: each distinct row's columns as a struct, once for each lot of its copies."""
    once = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")).groupBy("_a", "_b").agg(F.first("_doc").alias("_doc"), F.count("*").alias("_rows"))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / TOGETHER)))
    return once.withColumn("_lot", lots).drop("_rows").repartition("_a", "_b", "_lot")


def aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with columns of these names put aside, for a filter that adds columns so named; back_again() restores them."""
    return docs.select(*[F.col(f"`{c}`").alias(fresh(f"_aside_{c}", docs)) if c in names else F.col(f"`{c}`") for c in docs.columns])


def back_again(df: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{fresh(f'_aside_{c}', docs)}`").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns])
