"""Structured Streaming over landing folders and event tables (extension)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, what: str) -> str:
    """A new path in the cluster's shared folder.  Only a local master, whose
    executors share the driver's disk, may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = f"{tempfile.gettempdir()}/weftline-checkpoint"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that is available now and return its last
    state (complete) or all of its rows (append), from files in the shared
    folder."""
    spark = stream.sparkSession
    out = shared(spark, "stream")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'last' if mode == 'complete' else f'epoch={epoch}'}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/last") if mode == "complete" else spark.read.parquet(out).select(*stream.columns)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream; its schema is that of the files, with the
    event time as a session-zone timestamp, which watermarks need.
    The path may be one file: as a pattern it is not taken for a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n", "value")


def sliding(stream: DataFrame, width: str, step: str, late: str, *keys: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(stream: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def landing(spark: SparkSession, path: str) -> DataFrame:
    """(container, content) of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select(F.col("path").alias("container"), "content")


def progress(stream: DataFrame) -> DataFrame:
    """(batch, n_rows) of each micro-batch of a run over all that is available now,
    from the query's own progress reports (a bounded list, newest last)."""
    spark = stream.sparkSession
    q = stream.writeStream.format("noop").option("checkpointLocation", shared(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame([(int(p["batchId"]), int(p["numInputRows"])) for p in q.recentProgress], "batch long, n_rows long")
