"""Interchange rows: export, manifest, and validation of translated rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_rows(rows: DataFrame, file: str, position: str, name: Column, message: Column) -> DataFrame:
    """(file, position, id, name, message, sha256, n_bytes, n_chars); a blank
    name is absent."""
    return rows.select(
        file, position, F.format_string("r%08d", F.col(position)).alias("id"), F.nullif(name, F.lit("")).alias("name"), message.alias("message"),
        F.sha2(message, 256).alias("sha256"), F.octet_length(message).cast("long").alias("n_bytes"), F.char_length(message).cast("long").alias("n_chars"),
    )


def manifest(rows: DataFrame, file: str, position: str, token_pattern: str) -> DataFrame:
    """(file, n_rows, digest, n_tokens): digest of the rows in position order."""
    tokens = F.size(F.regexp_extract_all("message", F.lit(token_pattern), F.lit(0)))
    g = rows.groupBy(file).agg(F.sort_array(F.collect_list(F.struct(position, F.sha2("message", 256).alias("d")))).alias("s"), F.count(F.lit(1)).alias("n_rows"), F.sum(tokens).alias("n_tokens"))
    return g.select(file, "n_rows", F.sha2(F.array_join(F.transform("s", lambda x: x.d), ""), 256).alias("digest"), "n_tokens")


def validate(original: DataFrame, translated: DataFrame, key: list[str], token_pattern: str) -> DataFrame:
    """(key, reason, valid): first failed check of each row, in this order:
    missing row, extra row, name added or removed, empty message, control tokens
    changed.

    Rows are aligned by key; rows of equal length that trade places within a
    file cannot be told from translations.
    """
    a = original.select(*key, F.col("name").alias("n1"), F.col("message").alias("m1"), F.lit(True).alias("l"))
    b = translated.select(*key, F.col("name").alias("n2"), F.col("message").alias("m2"), F.lit(True).alias("r"))
    j = a.join(b, key, "full_outer")
    tok = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(token_pattern), F.lit(0)))
    reason = (
        F.when(F.col("r").isNull(), "missing")
        .when(F.col("l").isNull(), "extra")
        .when(F.col("n1").isNull() != F.col("n2").isNull(), "name")
        .when((F.col("m2") == "") & (F.col("m1") != ""), "empty")
        .when(tok("m1") != tok("m2"), "tokens")
        .otherwise("ok")
    )
    return j.select(*key, reason.alias("reason")).withColumn("valid", F.col("reason") == "ok")


def gate(records: DataFrame, member: str, status: str = "status") -> DataFrame:
    """Rows of members without any blocked record: a blocked one empties its member."""
    bad = records.where(F.col(status) == "blocked").select(member).distinct()
    return records.join(bad, member, "left_anti")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n_lost, n_new and equal, by multiset difference both ways."""
    cols = left.columns
    k = left.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).unionByName(right.groupBy(*cols).agg((-F.count(F.lit(1))).alias("__n")))
    d = k.groupBy(*cols).agg(F.sum("__n").alias("d"))
    return d.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("n_lost"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("n_new")).withColumn("equal", (F.col("n_lost") + F.col("n_new")) == 0)


def row_shape(payload: Column) -> Column:
    """Reason why a JSON text is no interchange row, null if it is one: an object
    with a string message, a string name or an array of string names (not both), and
    nothing else; characters that stand for no code point are refused."""

    def one(v):
        if v is None:
            return "null"
        try:
            row = json.loads(v)
        except ValueError:
            return "malformed"
        if not isinstance(row, dict):
            return "object"
        if row.keys() - {"name", "names", "message"}:
            return "key"
        if not isinstance(row.get("message"), str):
            return "message"
        if {"name", "names"} <= row.keys():
            return "name"
        names = row.get("names", [row.get("name", "")])
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            return "name"
        if any("\ud800" <= c <= "\udfff" for s in (row["message"], *names) for c in s):
            return "surrogate"
        return None

    return F.pandas_udf(lambda c: c.map(one), T.StringType())(payload)
