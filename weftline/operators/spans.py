"""Ordered spans of text: lines, classes, tokens, masks, fills and groups.

Positions are explicit columns throughout; no operator relies on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE


def split_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, body): one row per \\n-split line, ``line`` from 0."""
    return docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "body")).withColumn("line", F.col("line").cast("long"))


def line_kind(body: Column) -> Column:
    """blank, comment (; or //), label (*), linetag (#), command ([) or text, by
    the first characters behind white space."""
    t = F.btrim(body, F.lit(SPACE))
    return (
        F.when(t == "", "blank")
        .when(t.startswith(";") | t.startswith("//"), "comment")
        .when(t.startswith("*"), "label")
        .when(t.startswith("#"), "linetag")
        .when(t.startswith("["), "command")
        .otherwise("text")
    )


def content_kind(lines: DataFrame, doc: str, max_lines: int, min_share: float) -> DataFrame:
    """(doc, n_seen, n_text, is_script): is the share of text lines among the
    first ``max_lines`` lines that are not blank at least ``min_share``?"""
    w = Window.partitionBy(doc).orderBy("line")
    k = lines.withColumn("kind", line_kind(F.col("body"))).where("kind <> 'blank'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_lines)
    agg = k.groupBy(doc).agg(F.count(F.lit(1)).alias("n_seen"), F.count_if(F.col("kind") == "text").alias("n_text"))
    return agg.withColumn("is_script", F.col("n_text") >= F.col("n_seen") * min_share)


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("line") < n)


def tokens(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, token, n): control tokens of every row with their counts."""
    return df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def section_mask(lines: DataFrame, doc: str, opens: Column, closes: Column) -> DataFrame:
    """Adds depth (open sections at the line, the opening line included) and
    inside; a depth over 1 is a nesting error, flagged in nested."""
    w = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).otherwise(0)
    done = F.sum(F.when(closes, 1).otherwise(0)).over(w) - F.when(closes, 1).otherwise(0)
    out = lines.withColumn("depth", (F.sum(step).over(w) - done).cast("long"))
    return out.withColumn("inside", F.col("depth") > 0).withColumn("nested", F.col("depth") > 1)


def forward_fill(rows: DataFrame, part: list[str], order: str, value: Column, reset: Column | None = None, out: str = "filled") -> DataFrame:
    """Last value that is not null, at or before the row, since the last reset."""
    if reset is not None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__seg", F.sum(F.when(reset, 1).otherwise(0)).over(w))
        part = [*part, "__seg"]
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, True).over(w)).drop("__seg")


def one_shot(rows: DataFrame, part: list[str], order: str, name: Column, message: Column, out: str = "speaker") -> DataFrame:
    """A name goes to exactly the next message: rows where ``message`` holds get
    the last name since the message before."""
    w = Window.partitionBy(*part).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seg = rows.withColumn("__m", F.coalesce(F.sum(F.when(message, 1).otherwise(0)).over(before), F.lit(0)))
    fill = F.last(name, True).over(Window.partitionBy(*part, "__m").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return seg.withColumn(out, F.when(message, fill)).drop("__m")


def paragraphs(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, para, first_line, n_lines, body): runs of lines between blank ones."""
    w = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("body") == ""
    k = lines.withColumn("para", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    g = k.groupBy(doc, "para").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("line", "body"))).alias("s"))
    return g.select(doc, "para", "first_line", "n_lines", F.array_join(F.transform("s", lambda x: x.body), "\n").alias("body"))
