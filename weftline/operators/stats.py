"""Aggregates and rankings of evidence, series, budgets and histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def char_entropy(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n_chars, entropy): Shannon entropy of the characters in bits; texts
    without characters give no row.  Counted within the row, without a shuffle."""

    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: _entropy(np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_counts=True)[1]) if t else None).astype("Float64")

    out = docs.where(F.char_length(text) > 0).select(doc, F.char_length(text).cast("long").alias("n_chars"), F.pandas_udf(run, T.DoubleType())(F.col(text)).alias("entropy"))
    return out


def byte_entropy(data: Column, first: int = 1 << 20) -> Column:
    """Shannon entropy of the first MiB of bytes in bits (a probe's own bound); 0
    for none."""

    def run(col: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            n = np.bincount(np.frombuffer(bytes(v)[:first], np.uint8), minlength=256)
            return _entropy(n[n > 0]) if len(v) else 0.0

        return col.map(one).astype("Float64")

    return F.pandas_udf(run, T.DoubleType())(data)


def merge_hits(hits: DataFrame, key: list[str], item: str, more: int = 4) -> DataFrame:
    """(key, first, others, n): the least item stands for all, the next few are
    listed, and all are counted.  Only a bounded top-k of a key is collected."""
    n = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(item))
    top = hits.select(*key, item, place.alias("__p")).where(F.col("__p") <= more + 1)
    top = top.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("s"))
    keyed = n.join(top, [n[k].eqNullSafe(top[k]) for k in key], "left")
    return keyed.select(*[n[k] for k in key], F.get("s", F.lit(0)).alias("first"), F.slice("s", 2, more).alias("others"), "n")


def top_with_floor(hits: DataFrame, group: str, strength: Column, seq: str, k: int) -> DataFrame:
    """The k best hits of each group by (strength, seq), but at least the first of
    each strength even beyond k; k = 0 keeps none.  Adds place, from 1."""
    s = hits.withColumn("__s", strength)
    first = F.row_number().over(Window.partitionBy(group, "__s").orderBy(seq)) == 1
    s = s.withColumn("__first", first)
    n = F.count_if("__first").over(Window.partitionBy(group))
    s = s.withColumn("__n", n).withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__first"), "__s", seq)))
    s = s.where((F.lit(k) > 0) & (F.col("__rn") <= F.greatest(F.lit(k), F.col("__n"))))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__s", seq)).cast("long")).drop("__s", "__first", "__n", "__rn")


def ordered_counts(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, n, place): most common first, ties by first appearance."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


def largest(rows: DataFrame, part: str, size: Column, tie: str, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy(size.desc(), tie)).cast("long")).where(F.col("place") <= k)


def refcount(refs: DataFrame, table: DataFrame, ref: str, key: str) -> DataFrame:
    """(key, n_refs, state) for every row of ``table``: unused, single or shared."""
    n = refs.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias("n_refs"))
    j = table.select(key).join(n, key, "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0).cast("long")))
    return j.withColumn("state", F.when(F.col("n_refs") == 0, "unused").when(F.col("n_refs") == 1, "single").otherwise("shared"))


def series(names: DataFrame, name: str, pattern: str, ahead: int, limit: int = 999) -> DataFrame:
    """(prefix, width, number): numbered names with at least two members,
    extended to ``ahead`` beyond the largest, at most ``limit``.

    ``pattern`` has groups for the prefix and the digits.
    """
    p = names.select(F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).alias("d")).where("d <> ''")
    p = p.select("prefix", F.length("d").cast("long").alias("width"), F.col("d").cast("long").alias("v")).distinct()
    g = p.groupBy("prefix", "width").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where("n >= 2")
    return g.select("prefix", "width", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.least(F.lit(limit), F.col("top") + ahead)))).alias("number"))


def merge_ranges(points: DataFrame, part: str, value: str) -> DataFrame:
    """(part, low, high, n): runs of adjacent integers."""
    p = points.select(part, value).distinct()
    p = p.withColumn("__g", F.col(value) - F.row_number().over(Window.partitionBy(part).orderBy(value)))
    return p.groupBy(part, "__g").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).drop("__g")


def within_budget(rows: DataFrame, part: str, order: str, cost: Column, budget: float) -> DataFrame:
    """Rows with their running total, and whether it stays within the budget."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).withColumn("fits", F.col("running") <= budget)


def duplicate_groups(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(digest, size, n, first): contents that occur more than once; sizes are
    compared before digests."""
    sized = docs.select(doc, text, F.octet_length(text).cast("long").alias("size"))
    g = sized.groupBy("size", F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("first"))
    return g.where("n > 1")


def pooled(rows: DataFrame, value: Column, least: int) -> DataFrame:
    """(value, n): values that repeat and are longer than ``least``: worth a pool."""
    return rows.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.length("value") > least))
