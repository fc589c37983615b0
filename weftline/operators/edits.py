"""Edits of ordered spans: relocation, splicing, slots and pools.

An edit is (doc, start, end, replacement), half open, not empty, not
overlapping; offsets are code points of the text unless said otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaps(edits: DataFrame, doc: str) -> DataFrame:
    """Edits that begin before an earlier one ends."""
    w = Window.partitionBy(doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("__e", F.max("end").over(w)).where(F.col("start") < F.col("__e")).drop("__e")


def relocate(spans: DataFrame, doc: str, order: str, delta: Column) -> DataFrame:
    """Adds shift (sum of the deltas of earlier spans) and new_start."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = spans.withColumn("shift", F.coalesce(F.sum(delta).over(w), F.lit(0)).cast("long"))
    return out.withColumn("new_start", F.col("start") + F.col("shift"))


def map_addresses(addresses: DataFrame, edits: DataFrame, doc: str, address: str) -> DataFrame:
    """(.., inside, mapped): where an old address lies after the edits; inside an
    edited span there is none.

    As-of over the union of addresses and edges of edits: one window per
    document, linear in both.  At one position an edit's end counts before the
    address and its start behind it.
    """
    row = addresses.select(F.col(doc).alias("__d"), F.col(address).cast("long").alias("__p"), F.lit(1).alias("__k"), F.lit(0).cast("long").alias("__by"), F.lit(None).cast("long").alias("__e"), F.struct(*addresses.columns).alias("__row"))
    none = F.lit(None).cast(row.schema["__row"].dataType).alias("__row")
    by = F.length("replacement").cast("long") - (F.col("end") - F.col("start"))
    edges = F.array(F.struct(F.col("end").alias("p"), F.lit(0).alias("k"), by.alias("by"), F.lit(None).cast("long").alias("e")), F.struct(F.col("start").alias("p"), F.lit(2).alias("k"), F.lit(0).cast("long").alias("by"), F.col("end").alias("e")))
    edge = edits.select(F.col(doc).alias("__d"), F.explode(edges).alias("x")).select("__d", F.col("x.p").alias("__p"), F.col("x.k").alias("__k"), F.col("x.by").alias("__by"), F.col("x.e").alias("__e"), none)
    w = Window.partitionBy("__d").orderBy("__p", "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = row.unionByName(edge).withColumn("__shift", F.sum("__by").over(w)).withColumn("__until", F.last("__e", True).over(w)).where("__k = 1")
    out = both.withColumn("inside", F.coalesce(F.col("__until") > F.col("__p"), F.lit(False)))
    return out.select("__row.*", "inside", F.when(~F.col("inside"), F.col("__p") + F.col("__shift")).alias("mapped"))


def splice(docs: DataFrame, edits: DataFrame, doc: str, text: str, out: str = "spliced") -> DataFrame:
    """Texts with all edits applied at once, and splice_status: a text whose edits
    overlap, are empty or leave it is blocked and has none.

    The pieces are cut in one pass over the sorted edits (Arrow batches).
    """
    e = edits.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("__e"))

    def run(texts: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series([_spliced(t, e) for t, e in zip(texts, every, strict=True)], dtype=object)

    j = docs.join(e, doc, "left").withColumn(out, F.pandas_udf(run, T.StringType())(F.col(text), F.col("__e")))
    state = F.when(F.col(out).isNull() & F.col(text).isNotNull(), "blocked").otherwise("success")
    return j.withColumn("splice_status", state).drop("__e")


def _spliced(text, edits):
    if text is None:
        return None
    pieces, at = [], 0
    for e in edits if edits is not None else []:
        if not at <= e["start"] < e["end"] <= len(text):
            return None
        pieces += [text[at : e["start"]], e["replacement"] or ""]
        at = e["end"]
    return "".join([*pieces, text[at:]])


def consistent_rename(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, n_after, conflict): one new name per old name, else a
    conflict without a name."""
    g = pairs.groupBy(before).agg(F.count_distinct(after).alias("n_after"), F.min(after).alias("__a"))
    return g.select(before, F.when(F.col("n_after") == 1, F.col("__a")).alias(after), "n_after", (F.col("n_after") > 1).alias("conflict"))


def fixed_slot(rows: DataFrame, value: Column, capacity: Column, pad: str = " ") -> DataFrame:
    """Adds slot (padded to the capacity in bytes) and fits; what does not fit is
    rejected, never cut."""
    n = F.octet_length(value)
    return rows.withColumn("fits", n <= capacity).withColumn("slot", F.when(n <= capacity, F.concat(value, F.repeat(F.lit(pad), (capacity - n).cast("int")))))


def pool_offsets(rows: DataFrame, part: str, order: str, value: Column) -> DataFrame:
    """Adds offset: where each NUL-ended string starts in its pool."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.octet_length(value) + 1).over(w), F.lit(0)).cast("long"))


def clone_changed(refs: DataFrame, part: str, order: str, index: str, changed: Column, pool_size: Column) -> DataFrame:
    """Copy on write: every changed reference gets a new pool entry of its own,
    in order behind the old ones; others keep theirs."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.sum(F.when(changed, 1).otherwise(0)).over(w)
    return refs.withColumn("new_index", F.when(changed, pool_size + k - 1).otherwise(F.col(index)).cast("long"))
