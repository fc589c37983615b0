"""Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local master, whose executors share
    the driver's disk, may do without one (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        d = f"{tempfile.gettempdir()}/weftline-checkpoint"
    return d.rstrip("/")


class Scratch:
    """Tables in the shared folder that one operator writes on its way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, what: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back (see ``materialise``)."""
        path = f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete what was put; nothing may read it any more."""
        sc = self.spark.sparkContext
        for path in self.paths:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.clear()


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage on storage that every executor sees, so a lost executor
    costs no recomputation of what stands before.
    """
    return Scratch(df.sparkSession).put(df, what)


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, max_rows: int = 1_000_000, max_bytes: int = 1 << 26) -> DataFrame:
    """Join that broadcasts ``right`` only if it is counted at ``max_rows`` rows
    and ``max_bytes`` bytes or less; beyond that it is an ordinary shuffled join.
    Hand in a stored or cheap ``right``: it is read for the count as well."""
    size = F.lit(0).cast("long")
    for f in right.schema.fields:
        text = f.dataType.simpleString() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if text else F.lit(8))
    n, total = right.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    small = n <= max_rows and (total or 0) <= max_bytes
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def held(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text modulo ``modulus`` equals ``remainder``; a null
    id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def ranked(df: DataFrame, group: list[str], shard: list[str], order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """Gapless index from 0 of every row in its group, in order (shard, order).

    Each (group, shard) is ranked on its own and the shards' counts are summed
    up before, so that a hot group is spread over all its shards.  The counts
    are rows of (group, shard) only.  Group and shard columns hold no nulls.
    """
    w = Window.partitionBy(*group, *shard).orderBy(*order)
    counts = df.groupBy(*group, *shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*shard).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = df.withColumn("__rn", F.row_number().over(w).cast("long") - 1)
    placed = local.join(counts, [*group, *shard], "left").withColumn(out, F.col("__rn") + F.col("__before"))
    return placed.drop("__rn", "__before")
