"""Structured texts: strict JSON, selected leaves, delimited rows, XML, grids,
trees, and lexers with quotes."""

from __future__ import annotations

import json
import pickletools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strict(v: str, limit: int):
    def pairs(items):
        d = dict(items)
        if len(d) != len(items):
            raise ValueError("duplicate key")
        return d

    def no(x):
        raise ValueError(f"constant {x}")

    if len(v.encode()) > limit:
        raise ValueError("beyond the limit")
    return json.loads(v.removeprefix("﻿"), object_pairs_hook=pairs, parse_constant=no)


def strict_json(text: Column, limit: int = 1 << 24) -> Column:
    """Reason why a text is not strict JSON (duplicate keys, NaN, Infinity,
    oversize, malformed), null if it is; Spark's own parser accepts the first
    two."""

    def one(v):
        if v is None:
            return "null"
        try:
            _strict(v, limit)
        except (ValueError, RecursionError) as e:
            m = str(e)
            return m.split(" ")[0] if m.startswith(("duplicate", "constant", "beyond")) else "malformed"
        return None

    return F.pandas_udf(lambda c: c.map(one), T.StringType())(text)


def _walk(v, path, max_depth):
    if len(path) > max_depth:
        raise ValueError("too deep")
    yield path, v
    if isinstance(v, dict):
        for k, x in v.items():
            yield from _walk(x, (*path, k), max_depth)
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield from _walk(x, (*path, str(k)), max_depth)


def tree_nodes(df: DataFrame, key: str, text: str, max_depth: int = 64, max_nodes: int = 1_000_000) -> DataFrame:
    """(key, pos, parent, path, tag, value, status): the nodes of a JSON tree in
    pre-order.  A tree that breaks a rule is one blocked row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("row", "pos", "parent", "path", "tag", "value", "status")}

            def add(*v, out=out):
                for k, x in zip(out, v, strict=True):
                    out[k].append(x)

            for i, v in enumerate(batch.column(1).to_pylist()):
                try:
                    nodes, at = [], {}
                    for path, x in _walk(_strict(v or "", 1 << 24), (), max_depth):
                        if len(nodes) >= max_nodes:
                            raise ValueError("too many nodes")
                        at[path] = len(nodes)
                        tag = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(x)]
                        value = None if isinstance(x, (dict, list)) or x is None else x if isinstance(x, str) else json.dumps(x)
                        nodes.append((i, len(nodes), at[path[:-1]] if path else None, list(path), tag, value, "success"))
                    for n in nodes:
                        add(*n)
                except (ValueError, RecursionError):
                    add(i, -1, None, [], "blocked", None, "blocked")
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
            cols = [pa.array(out[k], t) for k, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:]], [key, *list(out)[1:]])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, pos long, parent long, path array<string>, tag string, value string, status string")


def selected_leaves(df: DataFrame, key: str, text: str, codes: list[int]) -> DataFrame:
    """(key, event, ordinal, code, leaf): string parameters of commands with one
    of ``codes`` in {"events": [{"list": [{"code", "parameters"}]}]}."""
    schema = "events array<struct<list:array<struct<code:int,parameters:array<string>>>>>"
    e = df.select(key, F.posexplode(F.from_json(text, schema).getField("events")).alias("event", "e"))
    c = e.select(key, F.col("event").cast("long"), F.posexplode("e.list").alias("k", "c")).where(F.col("c.code").isin(codes))
    return c.select(key, "event", F.col("k").cast("long").alias("ordinal"), F.col("c.code").alias("code"), F.explode("c.parameters").alias("leaf"))


def delimited(df: DataFrame, key: str, text: str, delimiter: str, column: str) -> DataFrame:
    """(key, line, value, n_fields, rectangular): one column of a delimited text
    with a header line; rows whose width differs are flagged, none is dropped."""
    lines = df.select(key, F.split(text, r"\r?\n").alias("l"))
    head = F.split(F.element_at("l", 1), delimiter)
    at = F.array_position(head, column)
    body = lines.select(key, F.size(head).cast("long").alias("w"), at.alias("at"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line", "b")).where("b <> ''")
    f = body.withColumn("f", F.split("b", delimiter))
    return f.select(key, F.col("line").cast("long"), F.get("f", (F.col("at") - 1).cast("int")).alias("value"), F.size("f").cast("long").alias("n_fields"), (F.size("f") == F.col("w")).alias("rectangular"))


def text_resources(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, position, name, message, dangling): log rows of an XML document
    resolved through its text resources by id.

    Documents with a DTD or an entity declaration are not read (one dangling row).
    """
    schema = "Res array<struct<_id:string,_VALUE:string>>, Log array<struct<_text:string,_name:string>>"
    safe = F.when(~F.col(xml).rlike("(?i)<!DOCTYPE|<!ENTITY"), F.from_xml(F.col(xml), schema))
    d = df.select(key, safe.alias("d"))
    table = F.map_from_entries(F.transform("d.Res", lambda r: F.struct(r._id, r._VALUE)))
    rows = d.select(key, table.alias("t"), F.posexplode_outer("d.Log").alias("position", "r"))
    get = lambda c: F.try_element_at("t", c)
    return rows.select(key, F.col("position").cast("long"), get(F.col("r._name")).alias("name"), get(F.col("r._text")).alias("message"), get(F.col("r._text")).isNull().alias("dangling"))


def grid_records(rows: DataFrame, book: str, index: str, cells: str, text_commands: list[str], other_commands: list[str]) -> DataFrame:
    """(book, row, command, text, role): rows below the header row (the first of
    each book) by header name.  Roles: text, other, comment, empty, unknown; an
    unknown command is reported, not skipped."""
    head = rows.groupBy(book).agg(F.min_by(cells, index).alias("h"), F.min(index).alias("i0"))
    j = rows.join(head, book).where(F.col(index) > F.col("i0"))
    cell = lambda name: F.coalesce(F.get(F.col(cells), (F.array_position("h", name) - 1).cast("int")), F.lit(""))
    first = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
    empty = F.forall(cells, lambda c: F.trim(c) == "")
    command = cell("Command")
    role = F.when(empty, "empty").when(first.startswith("//"), "comment").when(command.isin(text_commands), "text").when(command.isin(other_commands), "other").otherwise("unknown")
    return j.select(book, F.col(index).alias("row"), command.alias("command"), cell("Text").alias("text"), role.alias("role"))


def lex(df: DataFrame, key: str, text: str, left: str = "<", right: str = ">") -> DataFrame:
    """(key, ordinal, start, end, kind, token): lossless tokens of tagged text.

    A tag runs from ``left`` to the next ``right`` outside quotes that follow an
    equals sign; ``left`` twice is text; an open tag at the end is kind ``open``.
    Offsets are code points; the tokens joined are the text.
    """
    kind = df.schema[key].dataType.simpleString()

    def tokens(s):
        at = run = 0
        while True:
            a = s.find(left, at)
            if a < 0:
                break
            if s.startswith(left * 2, a):
                at = a + 2
                continue
            if a > run:
                yield run, a, "text"
            b, quote = a + 1, None
            while b < len(s):
                c = s[b]
                if quote:
                    quote = None if c == quote else quote
                elif c in "\"'" and s[b - 1] == "=":
                    quote = c
                elif c == right:
                    break
                b += 1
            end = min(b + 1, len(s))
            yield a, end, "tag" if b < len(s) else "open"
            at = run = end
        if run < len(s):
            yield run, len(s), "text"

    def work(batches):
        for batch in batches:
            row, out = [], []
            for i, s in enumerate(batch.column(1).to_pylist()):
                for k, (a, b, t) in enumerate(tokens(s or "")):
                    row.append(i)
                    out.append((k, a, b, t, s[a:b]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key, "ordinal", "start", "end", "kind", "token"])

    return df.select(key, text).mapInArrow(work, f"{key} {kind}, ordinal long, start long, end long, kind string, token string")


def attributes(token: Column) -> Column:
    """Map of the attributes of a tag; quoted or bare values, the last of a name wins."""

    def one(v):
        out, i, n = {}, 0, len(v or "")
        while i < n:
            e = v.find("=", i)
            if e < 0:
                break
            name = v[i:e].split()[-1].lstrip("<[@") if v[i:e].split() else ""
            if e + 1 < n and v[e + 1] in "\"'":
                q = v.find(v[e + 1], e + 2)
                q = n if q < 0 else q
                value, i = v[e + 2 : q], q + 1
            else:
                q = e + 1
                while q < n and not v[q].isspace() and v[q] not in ">]":
                    q += 1
                value, i = v[e + 1 : q], q
            if name:
                out[name] = value
        return out

    return F.pandas_udf(lambda c: pd.Series([one(v) for v in c]), T.MapType(T.StringType(), T.StringType()))(token)


def pickle_strings(data: Column, max_ops: int = 1_000_000) -> Column:
    """(pos, op, value) of the string pushes of a pickle, read as a list of
    opcodes; nothing is executed.  Null if it is malformed or too long."""
    kind = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("op", T.StringType()), T.StructField("value", T.StringType())]))

    def one(v):
        out = []
        try:
            for k, (op, arg, pos) in enumerate(pickletools.genops(bytes(v))):
                if k >= max_ops:
                    return None
                if isinstance(arg, str) and "UNICODE" in op.name:
                    out.append({"pos": pos, "op": op.name, "value": arg})
        except (ValueError, IndexError):
            return None
        return out

    return F.pandas_udf(lambda c: pd.Series([None if v is None else one(v) for v in c]), kind)(data)


_MARKUP = re.compile(r"<(?:!--.*?--|\?.*?\?|!\[CDATA\[.*?\]\]|/[^>]*|([A-Za-z_][^\s/>]*)((?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*/?)>", re.S)
_PAIR = re.compile(r"([^\s=/>]+)\s*=\s*(\"([^\"]*)\"|'([^']*)')")


def attribute_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, element, tag, name, start, end, value): where the attribute values of
    XML-like text stand, in code points, quotes excluded.

    The text is read lexically and nothing is normalised, so that a splice at these
    spans leaves all else as it was.  ``element`` counts start tags from 0; ``value``
    is the text between the quotes, entities and all.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, out = [], []
            for i, s in enumerate(batch.column(1).to_pylist()):
                for n, m in enumerate(x for x in _MARKUP.finditer(s or "") if x[1]):
                    for a in _PAIR.finditer(m[2]):
                        at = m.start(2) + a.start(2) + 1
                        row.append(i)
                        out.append((n, m[1], a[1], at, at + len(a[2]) - 2, a[2][1:-1]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key, "element", "tag", "name", "start", "end", "value"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, element long, tag string, name string, start long, end long, value string")


def in_language(spans: DataFrame, keys: list[str], base: str, language: str) -> DataFrame:
    """The span of ``base`` in a language for each element: the attribute ``base`` +
    language if there is one, else ``base`` itself, with the state own or fallback."""
    wanted = spans.where(F.col("name").isin(base, base + language))
    place = F.row_number().over(Window.partitionBy(*keys, "element").orderBy((F.col("name") == base).cast("int")))
    out = wanted.withColumn("__p", place).where("__p = 1").drop("__p")
    return out.withColumn("state", F.when(F.col("name") == base, "fallback").otherwise("own"))
