"""Identification: files to ranked evidence.

Files are rows (path, size, head); ``head`` holds the first bytes.  Probes are
small tables (plan constants) and joins; the caps of a scan are filters that
report what they left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import top_with_floor

#: Strengths, best first.
STRENGTHS = ["probe", "filename", "extension"]
DERIVED = r"(?i)(^|/)(\.git|__pycache__|node_modules|gt_output|backup( \d+)?|copy( \(\d+\))?)(/|$)|(?i)(\.bak|\.orig|~)$"


def files(spark: SparkSession, path: str, head: int = 2048) -> DataFrame:
    """(path, size, head) below a folder, recursively."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.substring("content", 1, head).alias("head"))


def heads(listing: DataFrame, head: int = 2048, tail: int = 0) -> DataFrame:
    """(path, size, head, tail) of the files of ``listing`` (path, size): the first
    and last bytes alone, by seeking in the store (any that pyarrow opens).

    ``listing`` can come from ``binaryFile`` without its content, which then is not
    read.  A file that cannot be opened has null bytes.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            first, last = [], []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    store, name = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))
                    with store.open_input_file(name) as f:
                        first.append(f.read_at(min(head, size), 0))
                        last.append(f.read_at(min(tail, size), size - min(tail, size)))
                except (OSError, ValueError):
                    first[len(last) :] = [None]
                    last.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.binary()), pa.array(last, pa.binary())], ["path", "size", "head", "tail"])

    return listing.select("path", F.col("size").cast("long")).mapInArrow(run, "path string, size long, head binary, tail binary")


def derived(path: Column) -> Column:
    """Does the path look like a product or copy of other files?"""
    return path.rlike(DERIVED)


def limited(table: DataFrame, max_files: int, max_depth: int) -> DataFrame:
    """Files in breadth-first order with kept and the reason if not.

    Depths are counted first: whole depths lie before or behind the cap.  Only in
    the one in which it falls paths are ordered, as a top-k of at most
    ``max_files`` rows.
    """
    t = table.withColumn("depth", F.size(F.split("path", "/")) - 1)
    per = t.groupBy("depth").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before)  # one row per depth
    split = per.where((F.col("__before") < max_files) & (F.col("__before") + F.col("__n") > max_files)).select("depth", "__before").first()
    why = F.when(F.col("depth") > max_depth, "depth").when(F.col("__before") >= max_files, "files")
    out = t.join(F.broadcast(per.select("depth", "__before")), "depth").withColumn("reason", why).drop("__before")
    if split:
        first = t.where(F.col("depth") == split[0]).orderBy("path").limit(max_files - split[1]).select("path").distinct().withColumn("__in", F.lit(True))
        out = out.join(F.broadcast(first), "path", "left")
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("depth") == split[0]) & F.col("__in").isNull(), "files").otherwise(F.col("reason"))).drop("__in")
    return out.withColumn("kept", F.col("reason").isNull())


def evidence(table: DataFrame, magics: list[tuple], extensions: list[tuple[str, str]], basenames: list[tuple[str, str]]) -> DataFrame:
    """(kind, path, strength, evidence): every hit of every probe.

    ``magics``: (kind, bytes) or (kind, bytes, offset in the head); ``extensions``: (kind, suffix with its
    dot), one suffix may serve several kinds; ``basenames``: (kind, name).
    """
    spark = table.sparkSession
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    t = table.select("path", "head", name.alias("name"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("suffix"))
    m = F.broadcast(spark.createDataFrame([(k, bytearray(b), b.hex(), (at or [0])[0]) for k, b, *at in magics], "kind string, magic binary, evidence string, at int"))
    e = F.broadcast(spark.createDataFrame([(k, x.lower()) for k, x in extensions], "kind string, suffix string"))
    b = F.broadcast(spark.createDataFrame([(k, x.lower()) for k, x in basenames], "kind string, name string"))
    there = F.substring("head", F.col("at") + 1, F.octet_length("magic")) == F.col("magic")
    hit = t.join(m, there).select("kind", "path", F.lit("probe").alias("strength"), "evidence")
    hit = hit.unionByName(t.join(b, "name").select("kind", "path", F.lit("filename").alias("strength"), F.col("name").alias("evidence")))
    return hit.unionByName(t.join(e, "suffix").select("kind", "path", F.lit("extension").alias("strength"), F.col("suffix").alias("evidence")))


def strength_rank(c: Column) -> Column:
    out = F.lit(len(STRENGTHS))
    for i, s in reversed(list(enumerate(STRENGTHS))):
        out = F.when(c == s, i).otherwise(out)
    return out


def candidates(hits: DataFrame, shown: int) -> DataFrame:
    """(kind, n_files, n_hits, best, capped, shown): kinds by evidence, with up to
    ``shown`` hits, but at least one of each strength."""
    g = hits.groupBy("kind").agg(F.count_distinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_hits"), F.min(strength_rank(F.col("strength"))).alias("r"))
    top = top_with_floor(hits, "kind", strength_rank(F.col("strength")), "path", shown)
    top = top.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("s"))
    out = g.join(top, "kind", "left").withColumn("shown", F.transform("s", lambda x: x.path))
    best = F.element_at(F.array(*[F.lit(s) for s in STRENGTHS]), F.col("r") + 1)
    return out.select("kind", "n_files", "n_hits", best.alias("best"), (F.col("n_hits") > F.coalesce(F.size("shown"), F.lit(0))).alias("capped"), "shown")


def volumes(table: DataFrame) -> DataFrame:
    """(base, path, volume): sets of name.ext and name.ext.000 ..., numbered by
    (length, name)."""
    base = F.regexp_replace("path", r"\.\d{1,4}$", "")
    t = table.select("path", base.alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(F.length("path"), "path")).cast("long") - 1
    return t.withColumn("volume", n)


def paired(table: DataFrame, index_suffix: str, payload_suffix: str) -> DataFrame:
    """(stem, index_path, payload_path): files of one stem; a missing companion
    is null."""
    stem = lambda s: F.regexp_replace("path", s.replace(".", "\\.") + "$", "")
    a = table.where(F.col("path").endswith(index_suffix)).select(stem(index_suffix).alias("stem"), F.col("path").alias("index_path"))
    b = table.where(F.col("path").endswith(payload_suffix)).select(stem(payload_suffix).alias("stem"), F.col("path").alias("payload_path"))
    return a.join(b, "stem", "full_outer")
