"""Text functions as Column expressions; Python only where Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_token(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def same_tokens(before: Column, after: Column, pattern: str) -> Column:
    """Do both hold the same multiset of tokens?"""
    t = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return t(before) == t(after)


def only_breaks_dropped(before: Column, after: Column, brk: str) -> Column:
    """Token arrays: are the tokens other than ``brk`` the same, and is every
    run of breaks between them at most as long as before?"""

    def gaps(c: Column) -> Column:
        # number of breaks before each other token, and after the last
        z = F.aggregate(c, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("g")), lambda s, x: F.when(x == brk, F.struct((s.n + 1).alias("n"), s.g.alias("g"))).otherwise(F.struct(F.lit(0).alias("n"), F.concat(s.g, F.array(s.n)).alias("g"))), lambda s: F.concat(s.g, F.array(s.n)))
        return z

    kept = lambda c: F.filter(c, lambda x: x != brk)
    fits = F.forall(F.zip_with(gaps(before), gaps(after), lambda a, b: F.coalesce(b <= a, F.lit(False))), lambda x: x)
    return (kept(before) == kept(after)) & fits


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters with white space runs as one blank (a display
    feature, not a filter)."""
    return F.substring(F.regexp_replace(F.trim(text), r"[ \t\n\x0b\f\r]+", " "), 1, n)


def split_name(line: Column) -> list[Column]:
    """name and message of 【name】message; no name: null."""
    p = r"^【([^】\r\n]+)】"
    name = F.regexp_extract(line, p, 1)
    return [F.nullif(name, F.lit("")).alias("name"), F.regexp_replace(line, p, "").alias("message")]


RUBY = r"\[([^/\[\]]+)/([^/\[\]]+)\]"


def strip_ruby(text: Column) -> Column:
    return F.regexp_replace(text, RUBY, "$1")


def ruby_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(RUBY)).cast("long")


def count_between(text: Column, low: str, high: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{low}-{high}]")).cast("long")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def cell(head: Column, row: Column, name: str) -> Column:
    """Cell under a header name, empty if there is none."""
    n = F.array_position(head, name)
    return F.when(n == 0, "").otherwise(F.coalesce(F.get(row, (n - 1).cast("int")), F.lit("")))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def name_variants(names: DataFrame, stem: str, extensions: list[str]) -> DataFrame:
    """Each name with every extension, first spelling of each kept, by case."""
    v = names.select(stem, F.explode(F.array(*[F.concat(stem, F.lit(e)) for e in extensions])).alias("candidate"))
    return v.groupBy(F.lower("candidate").alias("key")).agg(F.min("candidate").alias("candidate"))


@F.pandas_udf(T.StringType())
def path_key(path: pd.Series) -> pd.Series:
    """Comparison key of a path: NFC and case folded."""
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).casefold())


def unescape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace escapes in one pass over backslash pairs: each ``\\x`` that is
    listed becomes its value, others stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    table = F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v)])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def escape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The inverse of ``unescape``: every listed value becomes its escape; the
    backslash itself must be listed."""
    if "\\" not in dict((v, k) for k, v in pairs):
        raise ValueError("the backslash needs an escape")
    table = F.create_map(*[F.lit(x) for k, v in pairs for x in (v, k)])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def with_ruby(base: Column, reading: Column) -> Column:
    """[base/reading]; a part that could not be read back gives null."""
    bad = r"[/\[\]]"
    ok = (base != "") & (reading != "") & ~base.rlike(bad) & ~reading.rlike(bad)
    return F.when(ok, F.concat(F.lit("["), base, F.lit("/"), reading, F.lit("]")))


def ruby_pairs(text: Column) -> Column:
    """Array of (base, reading) in the order of the text."""
    take = lambda k: F.regexp_extract_all(text, F.lit(RUBY), F.lit(k))
    return F.arrays_zip(take(1).alias("base"), take(2).alias("reading"))


#: All of Unicode's white space.
SPACE = "".join(filter(str.isspace, map(chr, range(0x3001))))


def clean_token(token: Column) -> Column:
    """A name out of a table's cell: quotes, an index before a colon, a tag behind
    ``|``, ``#`` or ``@`` and brackets go; null for comments, numbers, wildcards,
    anything with white space, and what is longer than 180 characters."""
    t = F.btrim(F.btrim(F.btrim(token, F.lit(SPACE)), F.lit("\"'`")), F.lit(SPACE))
    t = F.ltrim(F.replace(F.regexp_replace(t, r"^\d+:", ""), F.lit("\\"), F.lit("/")), F.lit("@"))
    t = F.regexp_extract(t, r"(?s)^([^|#@]*)", 1)
    t = F.btrim(F.btrim(F.btrim(t, F.lit(SPACE)), F.lit(",;:[](){}")), F.lit(SPACE))
    bad = (t == "") | (F.char_length(t) > 180) | t.rlike(r"^[#@&*%$]|[?<>]|[\x00-\x1f]|(?U)\s") | t.rlike(r"^\d*\.?\d+$|^\d+\.$")
    return F.nullif(F.when(~bad, F.ltrim(F.ltrim(t, F.lit("./")), F.lit("/"))), F.lit(""))


def is_stem(name: Column) -> Column:
    """Does the last part look like a file's stem (2 to 80 characters, a digit, ``_``
    or ``-`` among them)?"""
    leaf = F.element_at(F.split(name, "/"), -1)
    return F.char_length(leaf).between(2, 80) & leaf.rlike("[0-9_-]")


def union_first(sources: list[DataFrame], name: str) -> DataFrame:
    """(key, name, n_sources): names of all sources, one row per name regardless of
    case, in the spelling of the first source that has it."""
    every = None
    for i, s in enumerate(sources):
        part = s.select(F.col(name)).where(F.col(name).isNotNull()).withColumn("__i", F.lit(i))
        every = part if every is None else every.unionByName(part)
    g = every.groupBy(F.lower(name).alias("key")).agg(F.min(F.struct("__i", name)).alias("f"), F.count_distinct("__i").alias("n_sources"))
    return g.select("key", F.col("f").getField(name).alias(name), "n_sources")
