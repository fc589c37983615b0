"""Catalogue search: AND of filters, stable pages, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(entries: DataFrame, filters: list[Column], order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of the matching entries in document order, with the total, the
    number returned and the next offset (null on the last page).

    The page is taken by a bounded top-k; the total is an aggregate joined to it.
    """
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset >= 0 and 1 <= limit <= 100")
    hit = entries
    for f in filters:
        hit = hit.where(f)
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    page = hit.orderBy(*order).offset(offset).limit(limit)
    page = page.join(F.broadcast(total))  # one row
    page = page.withColumn("returned", F.least(F.lit(limit).cast("long"), F.greatest(F.col("total") - offset, F.lit(0).cast("long"))))
    return page.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


def contains_text(df: DataFrame, needle: str) -> Column:
    """Case-insensitive search in the whole entry, serialised."""
    return F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(needle.lower()))


def glob(column: Column, pattern: str) -> Column:
    """Shell pattern (* and ?) on the lower-cased name."""
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern.lower())
    return F.lower(column).rlike(f"(?s)^{body}$")


def disambiguate(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique regardless of case: the first holder of a name keeps it,
    the i-th later one gets ``_<k>`` with the i-th k that no name of the table has
    already.

    Names that differ before their last ``_<k>`` never meet, so one left join
    with the taken numbers of each name is enough.
    """
    key = F.lower(name)
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = rows.withColumn("__key", key).withColumn("__i", i.cast("long"))
    parts = rows.select(F.regexp_extract(key, r"(?s)^(.*)_([1-9]\d{0,17})$", 1).alias("__key"), F.regexp_extract(key, r"(?s)^(.*)_([1-9]\d{0,17})$", 2).alias("k")).where("k <> ''")
    taken = parts.select("__key", F.col("k").cast("long").alias("k")).distinct().groupBy("__key").agg(F.sort_array(F.collect_list("k")).alias("__taken"))
    out = numbered.join(taken, "__key", "left")
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__i"), lambda k, t: k + (t <= k).cast("long"))
    return out.withColumn("slot_name", F.when(F.col("__i") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), free.cast("string")))).drop("__key", "__i", "__taken")


def expand_refs(entries: DataFrame, pool: DataFrame, ref: str, index: str) -> DataFrame:
    """Pooled values put back by reference; a reference without a value is bad."""
    return entries.join(pool.withColumnRenamed(index, ref), ref, "left")


def view(entries: DataFrame, summary: list[str], details: bool) -> DataFrame:
    """The entries as they are asked for: the columns of a summary, or all with the
    rest as one struct column ``details``."""
    rest = [c for c in entries.columns if c not in summary]
    return entries.select(*summary, F.struct(*rest).alias("details")) if details and rest else entries.select(*summary)
