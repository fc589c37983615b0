"""Layered sources: which one wins, what it hides, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], precedence: list[Column]) -> DataFrame:
    """The row of each key with the highest precedence, and n_losers."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("__rn", F.row_number().over(w.orderBy(*[c.desc() for c in precedence]))).withColumn("n_losers", F.count(F.lit(1)).over(w) - 1)
    return ranked.where("__rn = 1").drop("__rn")


def override_chain(rows: DataFrame, key: list[str], order: str, name: Column) -> DataFrame:
    """(key, winner, losers): losers in the order in which they were hidden."""
    g = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), name.alias("v")))).alias("s"))
    names = F.transform("s", lambda x: x.v)
    return g.select(*key, F.element_at(names, -1).alias("winner"), F.slice(names, 1, F.size("s") - 1).alias("losers"))


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, numbered by first appearance (slot from 0 per table)."""
    g = rows.groupBy(*key).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n"))
    return g


def loose_or_packed(loose: DataFrame, packed: DataFrame, key: str, digest: str, loose_part: str = "loose") -> DataFrame:
    """Full outer join of two layers with the rule that decides: a loose entry
    beats a packed one; equal digests are no conflict."""
    a, b = loose.select(key, F.col(digest).alias("d1")), packed.select(key, F.col(digest).alias("d2"))
    j = a.join(b, key, "full_outer")
    which = F.when(F.col("d1").isNull(), "packed").when(F.col("d2").isNull(), loose_part).when(F.col("d1") == F.col("d2"), "same").otherwise("override")
    return j.select(key, which.alias("state"), F.coalesce("d1", "d2").alias("digest"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def key_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: keys on both sides, only left, only right, and whether equal.

    Both sides are made distinct first, so the join is one row per key.
    """
    a = left.select(F.col(left_key).alias("k")).distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_key).alias("k")).distinct().withColumn("r", F.lit(1))
    j = a.join(b, "k", "full_outer")
    return j.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"),
        F.count_if(F.col("r").isNull()).alias("n_left_only"),
        F.count_if(F.col("l").isNull()).alias("n_right_only"),
    ).withColumn("equal", (F.col("n_left_only") + F.col("n_right_only")) == 0)


def effective(packed: DataFrame, loose: DataFrame, sources: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, state, digest): which compiled script runs, by rule.

    ``packed`` and ``loose`` are compiled scripts (name, digest of the source that
    they came from), ``sources`` loose sources (name, digest).  A loose script
    overrides a packed one of its name.  Conflicts, which have no digest: a loose
    name that differs from a packed one in case only (case), a loose script whose
    source has another digest (stale), a packed script with a loose source but no
    loose script (both would run).  A source without any script: source only.
    """
    d = lambda df, c: df.select(F.lower(name).alias("__k"), F.col(name).alias(f"__{c}n"), F.col(digest).alias(f"__{c}"))
    j = d(packed, "p").join(d(loose, "l"), "__k", "full_outer").join(d(sources, "s"), "__k", "full_outer")
    has = lambda c: F.col(f"__{c}n").isNotNull()
    state = (
        F.when(has("p") & has("l") & (F.col("__pn") != F.col("__ln")), "case")
        .when(has("l") & has("s") & ~F.col("__l").eqNullSafe(F.col("__s")), "stale")
        .when(has("p") & ~has("l") & has("s"), "both")
        .when(has("p") & has("l"), "override")
        .when(has("l"), "loose")
        .when(has("p"), "packed")
        .otherwise("source only")
    )
    out = j.select(F.coalesce("__ln", "__pn", "__sn").alias(name), state.alias("state"), F.coalesce("__l", "__p", "__s").alias(digest))
    return out.withColumn(digest, F.when(~F.col("state").isin("case", "stale", "both"), F.col(digest)))
