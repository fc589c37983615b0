"""Member paths: normal form, refusals and collisions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_key

#: Device names that no file may have, with any extension.
RESERVED = frozenset("con prn aux nul clock$ conin$ conout$ com1 com2 com3 com4 com5 com6 com7 com8 com9 com¹ com² com³ lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9 lpt¹ lpt² lpt³".split())


def _normal(path: str | None) -> tuple[str | None, str | None]:
    if not path:
        return None, "empty"
    p = path.replace("\\", "/")
    if re.search(r"[\x00-\x1f\x7f]", p):
        return None, "control"
    if p.startswith("/"):
        return None, "absolute"
    if ":" in p:
        return None, "colon"
    if re.search(r'[*?"<>|]', p):
        return None, "wildcard"
    for part in p.split("/"):
        if part in ("", ".", ".."):
            return None, "segment"
        if part[-1] in ". ":
            return None, "trailing"
        if part.split(".")[0].rstrip(" ").casefold() in RESERVED:
            return None, "reserved"
    return unicodedata.normalize("NFC", p), None


def normal_path(path: Column) -> Column:
    """Struct (path, reason): the slash form, or why the path is refused."""
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType())])

    def run(col):
        import pandas as pd

        return pd.DataFrame([_normal(v) for v in col], columns=["path", "reason"])

    return F.pandas_udf(run, kind)(path)


def collisions(rows: DataFrame, path: str) -> DataFrame:
    """(key, n, kind): keys (NFC, case folded) that several paths share, and keys
    that are a file in one path and a folder in another.

    Ancestors are exploded and joined by equality; no pairs of paths are made.
    """
    k = rows.select(path_key(F.col(path)).alias("key"))
    same = k.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("kind", F.lit("same"))
    parts = F.split("key", "/")
    above = k.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "/")))).alias("key")).where("key is not null")
    above = above.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = above.join(k.distinct(), "key", "left_semi").withColumn("kind", F.lit("prefix"))
    return same.unionByName(both)
