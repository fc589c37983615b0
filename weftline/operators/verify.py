"""Read-back: what must not change has not, what was written is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def members(original: DataFrame, rebuilt: DataFrame, replaced: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """(key, state, ok) for every member of either side.

    ``replaced`` is (key, payload) of what was to be put in.  States: same,
    replaced (with exactly that payload), wrong (was to be replaced, is not),
    touched (was to stay, has not), lost, new.
    """
    d = lambda df, name: df.select(*key, F.sha2(payload, 256).alias(name))
    j = d(original, "a").join(d(rebuilt, "b"), key, "full_outer").join(d(replaced, "c"), key, "left")
    state = (
        F.when(F.col("b").isNull(), "lost")
        .when(F.col("a").isNull(), "new")
        .when(F.col("c").isNotNull(), F.when(F.col("b") == F.col("c"), "replaced").otherwise("wrong"))
        .otherwise(F.when(F.col("a") == F.col("b"), "same").otherwise("touched"))
    )
    return j.select(*key, state.alias("state")).withColumn("ok", F.col("state").isin("same", "replaced"))


def trial(docs: DataFrame, read: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, DataFrame], DataFrame], doc: str, index: str, text: str, mark: str = "#") -> DataFrame:
    """(doc, n_rows, n_wrong, ok): a trial edit that marks every row's text, writes
    it and reads it again.

    ``read(docs)`` gives (doc, index, text); ``write(docs, changes)`` takes the same
    columns as changes.  Every row must come back with its mark, and none else.
    """
    before = read(docs)
    marked = before.select(doc, index, F.concat(F.lit(mark), F.col(text)).alias(text))
    after = read(write(docs, marked)).select(doc, index, F.col(text).alias("__after"), F.lit(True).alias("__there"))
    j = marked.withColumn("__here", F.lit(True)).join(after, [doc, index], "full_outer")
    wrong = F.col("__here").isNull() | F.col("__there").isNull() | ~F.col("__after").eqNullSafe(F.col(text))
    g = j.groupBy(doc).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong"))
    return g.withColumn("ok", F.col("n_wrong") == 0)


def two_levels(stored: DataFrame, proxies: DataFrame, translated: DataFrame, key: list[str], text: str, restore: Callable[[Column], Column]) -> DataFrame:
    """(key, stored_ok, shown_ok): rows as they lie in the output against the proxies
    that were to be stored, and, restored, against the translation.

    Rows that one side lacks are not ok.
    """
    a = stored.select(*key, F.col(text).alias("__a"))
    b = proxies.select(*key, F.col(text).alias("__b"))
    c = translated.select(*key, F.col(text).alias("__c"))
    j = a.join(b, key, "full_outer").join(c, key, "full_outer")
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    return j.select(*key, same(F.col("__a"), F.col("__b")).alias("stored_ok"), same(restore(F.col("__a")), F.col("__c")).alias("shown_ok"))


def digests(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, size, sha256) of every file: what to hold against a later look."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of both looks at the inputs: same, changed, lost or new."""
    a = before.select("path", F.col("size").alias("__n"), F.col("sha256").alias("__a"))
    j = a.join(after.select("path", "size", "sha256"), "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "lost").when(F.col("__a").isNull(), "new").when((F.col("__n") == F.col("size")) & (F.col("__a") == F.col("sha256")), "same").otherwise("changed")
    return j.select("path", state.alias("state"))


def within_bytes(rows: DataFrame, file: str, data: str, max_file: int, max_total: int) -> DataFrame:
    """(file, n_bytes, status): what each output would take, blocked beyond
    ``max_file`` bytes, or all of them beyond ``max_total``.

    Sums only; nothing is written that would have to be taken back.
    """
    g = rows.groupBy(file).agg(F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).cast("long").alias("n_bytes"))
    total = g.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("__t"))
    j = g.crossJoin(F.broadcast(total))  # one row
    return j.withColumn("status", F.when((F.col("n_bytes") > max_file) | (F.col("__t") > max_total), "blocked").otherwise("success")).drop("__t")
