"""Strict charsets and substitution plans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codecs import bytes_udf


def decode_strict(data: Column, charset: str) -> Column:
    """Text of strictly decoded bytes; null where they do not decode."""

    def run(col: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else bytes(v).decode(charset)
            except UnicodeDecodeError:
                return None

        return col.map(one)

    return F.pandas_udf(run, T.StringType())(data)


def encode_strict(text: Column, charset: str) -> Column:
    """Bytes of the text; null where a character has none."""

    def run(col: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else v.encode(charset)
            except UnicodeEncodeError:
                return None

        return col.map(one)

    return F.pandas_udf(run, T.BinaryType())(text)


def guess(data: Column) -> Column:
    """bom-8, bom-16le, bom-16be, utf-16le (every other byte zero), utf-8,
    cp932 or binary; text has at most 1 % control characters."""

    def run(col: pd.Series) -> pd.Series:
        def texty(s):
            return sum(c < " " and c not in "\t\r\n" for c in s) <= len(s) * 0.01

        def one(v):
            if v is None:
                return None
            v = bytes(v)
            for mark, name in ((b"\xef\xbb\xbf", "bom-8"), (b"\xff\xfe", "bom-16le"), (b"\xfe\xff", "bom-16be")):
                if v.startswith(mark):
                    return name
            if len(v) >= 4 and len(v) % 2 == 0 and v[1::2].count(0) * 2 > len(v) // 2:
                return "utf-16le"
            for name in ("utf-8", "cp932"):
                try:
                    s = v.decode(name)
                except UnicodeDecodeError:
                    continue
                if texty(s):
                    return name
            return "binary"

        return col.map(one)

    return F.pandas_udf(run, T.StringType())(data)


def substitution_plan(texts: DataFrame, text: str, charset: str, first: int = 0xE000, last: int = 0xF8FF) -> DataFrame:
    """(c, n, proxy): the characters that ``charset`` lacks and a private-use
    character for each, dealt downward from ``last`` and skipping those that the
    texts use themselves; proxy is null once none is left.

    The driver sees nothing: rows are one per distinct character.
    """
    chars = texts.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    lacking = chars.where(encode_strict(F.col("c"), charset).isNull())
    pool = texts.sparkSession.range(first, last + 1).select(F.col("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("__c"))
    pool = pool.join(chars.select(F.col("c").alias("__c")), "__c", "left_anti").withColumn("k", F.row_number().over(Window.orderBy(F.desc("id"))))
    lacking = lacking.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "c")))
    return lacking.join(pool, "k", "left").select("c", "n", F.col("__c").alias("proxy"))


def substitute(text: Column, mapping: dict[str, str]) -> Column:
    """One-to-one replacement of characters; the mapping must be a bijection."""
    if len(set(mapping.values())) != len(mapping) or any(len(k) != 1 or len(v) != 1 for k, v in mapping.items()):
        raise ValueError("not a bijection of characters")
    return F.translate(text, "".join(mapping), "".join(mapping.values()))


def lacking_places(texts: DataFrame, doc: str, text: str, charset: str, shown: int = 20) -> DataFrame:
    """(c, n, n_lines, places): every character that ``charset`` lacks, how often it
    stands and where: the first ``shown`` of its (doc, line) places, with all of
    them counted."""
    lines = texts.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    per = lines.select(doc, "line", F.explode(F.split("body", "")).alias("c")).where("c <> ''").groupBy(doc, "line", "c").agg(F.count(F.lit(1)).alias("n"))
    bad = per.select("c").distinct()
    per = per.join(bad.where(encode_strict(F.col("c"), charset).isNull()), "c", "left_semi")
    total = per.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_lines"))
    top = per.withColumn("__p", F.row_number().over(Window.partitionBy("c").orderBy(doc, "line"))).where(F.col("__p") <= shown)
    top = top.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(F.col(doc), F.col("line").cast("long").alias("line")))).alias("places"))
    return total.join(top, "c")


def transcode(data: Column, source: str, target: str, mapping: dict[str, str] | None = None) -> Column:
    """Bytes of one charset in another, some characters replaced on the way; null
    where a character has no place in the target or the bytes do not decode."""
    table = str.maketrans(mapping or {})
    for v in (mapping or {}).values():
        v.encode(target)

    def run(col: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else bytes(v).decode(source).translate(table).encode(target)
            except UnicodeError:
                return None

        return col.map(one)

    return F.pandas_udf(run, T.BinaryType())(data)


#: Control pairs of scripts and the escapes that stand for them.
CONTROLS = {b"\xef\xf0": b"\r\n", b"\xef\xf2": b"\\p", b"\xef\xf3": b"\\c", b"\xef\xf5": b"\\u"}
_CHARACTER = rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[^\x81-\x9f\xe0-\xfc]"


def _controls(data: bytes, back: bool) -> bytes:
    table = {v: k for k, v in CONTROLS.items()} if back else CONTROLS
    token = re.compile(b"(" + b"|".join(map(re.escape, table)) + b")|" + _CHARACTER, re.S)
    out, at = [], 0
    for m in token.finditer(data):
        if m.start() != at or (not back and m[1] is None and m[0][0] == 0xEF):
            break
        out.append(table[m[1]] if m[1] else m[0])
        at = m.end()
    if at != len(data):
        raise ValueError("no character or control here")
    return b"".join(out)


def control_escapes(data: Column, back: bool = False) -> Column:
    """Control pairs of double-byte text as escapes, or back, character by character
    so that no second byte is taken for a control; null where it does not scan."""
    return bytes_udf(lambda d: _controls(d, back))(data)


def preflight(reserved: DataFrame, translated: DataFrame, doc: str, text: str, mapping: DataFrame, charset: str, shown: int = 20) -> DataFrame:
    """(c, proxy, n, state, n_literal, places): characters of the translations that
    ``charset`` lacks, against the proxies (c, proxy) that would stand for them.

    States: missing (no proxy), conflict (the proxy is itself a character of the
    texts), ok.  places: the first ``shown`` documents with the proxy as a literal.
    """
    chars = lambda df: df.select(doc, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(doc, "c").agg(F.count(F.lit(1)).alias("n"))
    need = chars(translated).groupBy("c").agg(F.sum("n").alias("n"))
    need = need.where(encode_strict(F.col("c"), charset).isNull()).join(mapping.select("c", "proxy"), "c", "left")
    used = chars(reserved.select(doc, text).unionByName(translated.select(doc, text))).withColumnRenamed("c", "proxy")
    used = used.join(mapping.select("proxy"), "proxy", "left_semi")
    total = used.groupBy("proxy").agg(F.sum("n").alias("n_literal"))
    top = used.withColumn("__p", F.row_number().over(Window.partitionBy("proxy").orderBy(doc))).where(F.col("__p") <= shown)
    total = total.join(top.groupBy("proxy").agg(F.sort_array(F.collect_list(doc)).alias("places")), "proxy")
    out = need.join(total, "proxy", "left").withColumn("n_literal", F.coalesce("n_literal", F.lit(0).cast("long")))
    state = F.when(F.col("proxy").isNull(), "missing").when(F.col("n_literal") > 0, "conflict").otherwise("ok")
    return out.select("c", "proxy", "n", state.alias("state"), "n_literal", "places")


#: Code pages that follow the system.
SYSTEM_PAGES = (0, 3)


def page_verdict(sites: DataFrame, file: str) -> DataFrame:
    """(file, n_system, n_fixed, n_branches, verdict, confidence) from the evidence
    rows of a program: (file, kind, page), kind one of convert (a conversion call
    with that code page, null if unknown), branch (the system page decides), table
    (a built-in double-byte table) and packed."""
    k, page = F.col("kind"), F.col("page")
    g = sites.groupBy(file).agg(
        F.count_if((k == "convert") & page.isin(*SYSTEM_PAGES)).alias("n_system"),
        F.count_if((k == "convert") & (page == 932)).alias("n_fixed"),
        F.count_if(k == "branch").alias("n_branches"),
        F.count_if(k == "table").alias("__t"),
        F.count_if(k == "packed").alias("__p"),
    )
    system, fixed = (F.col("n_system") + F.col("n_branches")) > 0, (F.col("n_fixed") + F.col("__t")) > 0
    verdict = F.when(F.col("__p") > 0, "undetermined").when(system & fixed, "mixed").when(system, "acp-following").when(fixed, "fixed-cp932").otherwise("undetermined")
    strong = F.when(verdict == "acp-following", F.col("n_branches") > 0).when(verdict == "fixed-cp932", (F.col("n_fixed") >= 2) | (F.col("__t") > 0))
    return g.select(file, "n_system", "n_fixed", "n_branches", verdict.alias("verdict"), F.when(strong, "strong").when(~strong, "weak").alias("confidence"))
