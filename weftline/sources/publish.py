"""Publishing tables without overwriting, with read-back by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def publish(df: DataFrame, path: str) -> tuple:
    """Write to a sibling staging folder, then rename it in one step.

    Refuses a destination that exists.  The rename is atomic on HDFS and local
    file systems; on object stores Spark's own commit marker (_SUCCESS) must be
    awaited by readers instead.  Returns the digest of the rows as they were
    written, observed on the way: the input is computed once.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    try:
        df.observe(seen, *_sums(df.columns)).write.parquet(stage)
        if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), target):
            raise FileExistsError(path)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(stage), True)
    return tuple(seen.get[k] for k in ("n", "a", "b"))


def _sums(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("b")]


def digest(df: DataFrame) -> DataFrame:
    """One row, independent of order: rows and two sums of row hashes."""
    return df.agg(*_sums(df.columns))


def read_back(df: DataFrame, path: str) -> bool:
    """Does what was published equal ``df`` as a multiset?"""
    return holds(tuple(digest(df).first()), path, df.schema, df.sparkSession)


def holds(written: tuple, path: str, schema: StructType, spark: SparkSession) -> bool:
    """Does what was published hold the rows whose digest ``publish`` returned?"""
    return tuple(digest(spark.read.schema(schema).parquet(path)).first()) == tuple(written)
