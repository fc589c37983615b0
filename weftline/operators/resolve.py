"""Names and references: dictionaries, ambiguity, positions and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_ambiguous(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values, resolved, ambiguous): the value if only one was seen, else
    the sorted list of all."""
    g = pairs.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("v"))
    return g.select(key, F.size("v").cast("long").alias("n_values"), F.when(F.size("v") == 1, F.col("v")[0]).alias("resolved"), F.when(F.size("v") > 1, F.col("v")).alias("ambiguous"))


def with_default(rows: DataFrame, names: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Left join with the key as the default; ``names`` has one row per key."""
    return rows.join(names.select(key, F.col(name).alias(out)), key, "left").withColumn(out, F.coalesce(F.col(out), F.col(key)))


def numbered(rows: DataFrame, order: list[Column], out: str = "index", part: list[str] | None = None) -> DataFrame:
    """Row index from 0 in ``order``, per ``part``."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*(part or [])).orderBy(*order)).cast("long") - 1)


def by_position(refs: DataFrame, table: DataFrame, ref: str, index: str = "index") -> DataFrame:
    """Join a reference with the row of that index."""
    return refs.join(table.withColumnRenamed(index, ref), ref, "left")


def in_ranges(rows: DataFrame, point: Column, ranges: DataFrame, low: str, high: str, max_ranges: int = 100_000) -> DataFrame:
    """Rows with the range that holds them, low <= point < high.

    ``ranges`` is a table of disjoint ranges, broadcast if it is counted at
    ``max_ranges`` or less; larger ones belong to ``in_binned_ranges``.
    """
    if ranges.limit(max_ranges + 1).count() > max_ranges:
        raise ValueError("too many ranges to broadcast: use in_binned_ranges")
    return rows.join(F.broadcast(ranges), (point >= F.col(low)) & (point < F.col(high)), "left")


def in_binned_ranges(rows: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Range join by equal bins of ``width``: ranges go to every bin that they
    touch, points to one, and the equi join is checked exactly.  For integer
    points; no broadcast, linear in rows plus bins touched."""
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    p = rows.withColumn("__bin", F.floor(F.col(point) / width))
    return p.join(r, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def by_hash(entries: DataFrame, names: DataFrame, key: str, name: str, hashed: Column) -> DataFrame:
    """``entries`` with resolved and ambiguous: names whose ``hashed`` expression
    equals the stored ``key``.  One name regardless of case resolves it (the least
    spelling); several make it ambiguous, and all are listed."""
    n = names.select(hashed.alias(key), F.col(name).alias("__n")).distinct()
    g = n.groupBy(key).agg(F.sort_array(F.collect_set("__n")).alias("__v"), F.count_distinct(F.lower("__n")).alias("__k"))
    j = entries.join(g, key, "left")
    return j.withColumn("resolved", F.when(F.col("__k") == 1, F.get("__v", F.lit(0)))).withColumn("ambiguous", F.when(F.col("__k") > 1, F.col("__v"))).drop("__v", "__k")


def two_hops(refs: DataFrame, externals: DataFrame, objects: DataFrame) -> DataFrame:
    """References (file, file_id, path_id) to objects (file, path_id, name) of other
    files: file_id 0 is the file itself, others its externals (file, file_id,
    target).  Adds target, name and state: found, no external, no object."""
    e = externals.select("file", "file_id", "target")
    j = refs.join(e, ["file", "file_id"], "left").withColumn("target", F.when(F.col("file_id") == 0, F.col("file")).otherwise(F.col("target")))
    o = objects.select(F.col("file").alias("target"), "path_id", "name", F.lit(True).alias("__o"))
    j = j.join(o, ["target", "path_id"], "left")
    state = F.when(F.col("target").isNull(), "no external").when(F.col("__o").isNull(), "no object").otherwise("found")
    return j.select("file", "file_id", "path_id", "target", "name", state.alias("state"))
