"""Writers: translated values put back into the texts and bytes they came from.

Every writer takes documents (doc, content) and a table of changes, and returns
(doc, content, status, reason).  A document with a change that names nothing, or
that its format cannot hold, keeps its content and is blocked; one without
changes keeps its content as it is.  A document's changes travel as one array
beside it (they are parts of that document); documents are rows of their own.
"""

from __future__ import annotations

import csv
import io
import json
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import moved, splice


def per_document(docs: DataFrame, changes: DataFrame, doc: str, content: str, fields: list[str], fn: Callable) -> DataFrame:
    """``fn(content, [changes])`` for every document, ValueError blocking it."""
    kind, data = docs.schema[doc].dataType.simpleString(), docs.schema[content].dataType.simpleString()
    c = changes.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__c"))
    to = pa.string() if data == "string" else pa.binary()

    def run(batches):
        for batch in batches:
            out, status, why = [], [], []
            for old, every in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append(fn(old, every) if every and old is not None else old)
                    if every and old is None:
                        raise ValueError("no content")
                    status.append("success")
                    why.append(None)
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, ET.ParseError) as e:
                    out[len(status) :] = [old]
                    status.append("blocked")
                    why.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, to), pa.array(status, pa.string()), pa.array(why, pa.string())], [doc, "content", "status", "reason"])

    return docs.join(c, doc, "left").select(doc, content, "__c").mapInArrow(run, f"{doc} {kind}, content {data}, status string, reason string")


def delimited(docs: DataFrame, changes: DataFrame, doc: str, content: str, column: str, delimiter: str = ",", ending: str = "\r\n") -> DataFrame:
    """Values written to the column behind ``column``; changes are (doc, line,
    value), lines counted from 0 below the header.  Only lines with a source value
    can change; quoting is made anew, cells are not."""

    def fn(text, every):
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))
        if not rows or rows[0].count(column) != 1 or rows[0].index(column) + 1 >= len(rows[0]):
            raise ValueError("no target column")
        at, width = rows[0].index(column), len(rows[0])
        for c in every:
            line = c["line"] + 1
            if not 0 < line < len(rows) or len(rows[line]) != width or not rows[line][at]:
                raise ValueError(f"line {c['line']} has no source")
            if c["value"] is None or "\0" in c["value"]:
                raise ValueError(f"line {c['line']} has no value")
            rows[line][at + 1] = c["value"]
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=delimiter, lineterminator=ending).writerows(rows)
        return out.getvalue()

    return per_document(docs, changes, doc, content, ["line", "value"], fn)


def resources(docs: DataFrame, changes: DataFrame, doc: str, content: str) -> DataFrame:
    """Texts of XML resources ``<Res id>`` that a ``<Log text name>`` refers to;
    changes are (doc, id, value).  A shared id has one text."""

    def fn(text, every):
        if "<!" in text:
            raise ValueError("declarations are not read")
        root = ET.fromstring(text)
        table = {r.get("id"): r for r in root.iter("Res")}
        used = {log.get(k) for log in root.iter("Log") for k in ("text", "name")}
        for c in every:
            if c["id"] not in table or c["id"] not in used:
                raise ValueError(f"{c['id']} is no text of a log")
            if c["value"] is None or any(x < " " and x not in "\t\r\n" for x in c["value"]):
                raise ValueError(f"{c['id']} cannot hold its text")
            table[c["id"]].text = c["value"]
        return ET.tostring(root, encoding="unicode")

    return per_document(docs, changes, doc, content, ["id", "value"], fn)


def records(docs: DataFrame, changes: DataFrame, doc: str, content: str, width: int = 2) -> DataFrame:
    """Length-prefixed records (little endian, ``width`` bytes) with some payloads
    put in; changes are (doc, index, payload).  Others stay byte for byte."""

    def fn(data, every):
        cuts, at = [], 0
        while at < len(data):
            end = at + width + int.from_bytes(data[at : at + width], "little")
            if at + width > len(data) or end > len(data):
                raise ValueError("record beyond the end")
            cuts.append((at, end))
            at = end
        new = {c["index"]: bytes(c["payload"]) for c in every if c["payload"] is not None}
        if len(new) != len(every) or any(not 0 <= k < len(cuts) for k in new):
            raise ValueError("no such record")
        if any(len(v) >= 1 << (8 * width - 1) for v in new.values()):
            raise ValueError("payload beyond its length field")
        return b"".join(len(new[k]).to_bytes(width, "little") + new[k] if k in new else data[a:b] for k, (a, b) in enumerate(cuts))

    return per_document(docs, changes, doc, content, ["index", "payload"], fn)


def append(docs: DataFrame, changes: DataFrame, doc: str, content: str, base: int = 0, end: bytes = b"\0") -> DataFrame:
    """Appended strings: changes are (doc, field, payload); the payload and an end
    mark go behind the content and the u32 at ``field`` is pointed there.  The old
    string stays, so other pointers to it keep their text."""

    def fn(data, every):
        out, taken = bytearray(data), -4
        for c in every:
            if not 0 <= c["field"] <= len(data) - 4 or c["field"] < taken + 4:
                raise ValueError("field outside the content or over another")
            if c["payload"] is None or end in bytes(c["payload"]):
                raise ValueError("payload holds the end mark")
            taken = c["field"]
            struct.pack_into("<I", out, taken, len(out) - base)
            out += bytes(c["payload"]) + end
        return bytes(out)

    return per_document(docs, changes, doc, content, ["field", "payload"], fn)


def _place(root, path):
    for k in path[:-1]:
        root = root[int(k)] if isinstance(root, list) else root[k]
    key = int(path[-1]) if isinstance(root, list) else path[-1]
    root[key]  # noqa: B018: a leaf that is not there is refused
    return root, key


def leaves(docs: DataFrame, changes: DataFrame, doc: str, content: str) -> DataFrame:
    """String leaves of JSON trees set by path; changes are (doc, path, value) with
    ``path`` an array of keys and indexes as text.  Codes, numbers and branches are
    refused: a string stays a string."""

    def fn(text, every):
        root = json.loads(text)
        for c in every:
            if not c["path"] or c["value"] is None:
                raise ValueError("no leaf")
            at, key = _place(root, c["path"])
            if not isinstance(at[key], str):
                raise ValueError("/".join(c["path"]) + " is no string")
            at[key] = c["value"]
        return json.dumps(root, ensure_ascii=False, separators=(",", ":"))

    return per_document(docs, changes, doc, content, ["path", "value"], fn)


def nested_leaves(docs: DataFrame, changes: DataFrame, doc: str, content: str, boundaries: list[list[str]]) -> DataFrame:
    """``leaves`` through strings that hold JSON themselves at the given paths,
    outer ones first; changes name the leaf as if the strings were trees.  A string
    of which nothing changes keeps its own spelling."""
    if len({tuple(b) for b in boundaries}) != len(boundaries):
        raise ValueError("a path is named twice")

    def fn(text, every):
        root, opened = json.loads(text), []
        for path in sorted(boundaries, key=len):
            at, key = _place(root, path)
            if not isinstance(at[key], str) or not isinstance(tree := json.loads(at[key]), (dict, list)):
                raise ValueError("/".join(path) + " holds no tree")
            opened.append((path, at[key], json.dumps(tree)))
            at[key] = tree
        for c in every:
            at, key = _place(root, c["path"])
            if not isinstance(at[key], str) or c["value"] is None:
                raise ValueError("/".join(c["path"]) + " is no string")
            at[key] = c["value"]
        for path, spelling, before in reversed(opened):
            at, key = _place(root, path)
            at[key] = spelling if json.dumps(at[key]) == before else json.dumps(at[key], ensure_ascii=False, separators=(",", ":"))
        return json.dumps(root, ensure_ascii=False, separators=(",", ":"))

    return per_document(docs, changes, doc, content, ["path", "value"], fn)


def code(docs: DataFrame, changes: DataFrame, jumps: DataFrame, doc: str, content: str) -> DataFrame:
    """Code with spans replaced and its jumps led to the same instructions.

    changes are (doc, start, end, payload), jumps (doc, field, relative): an
    absolute jump is a u32 address, a relative one an i32 from the field's end.
    """
    both = changes.select(doc, F.col("start").alias("a"), "end", "payload", F.lit(None).cast("boolean").alias("relative"))
    both = both.unionByName(jumps.select(doc, F.col("field").alias("a"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("binary").alias("payload"), "relative"))

    def fn(data, every):
        edits = [(c["a"], c["end"], bytes(c["payload"] or b"")) for c in every if c["relative"] is None]
        fields = [(c["a"], c["relative"]) for c in every if c["relative"] is not None]
        out, n = bytearray(splice(data, edits)), len(data)
        for k, (f, relative) in enumerate(fields):
            if f + 4 > n or any(s < f + 4 and f < e for s, e, _ in edits) or (k and f < fields[k - 1][0] + 4):
                raise ValueError("field outside the code, inside an edit or over another")
            (v,) = struct.unpack_from("<i" if relative else "<I", data, f)
            to = moved(f + 4 + v if relative else v, edits, n)
            at = moved(f, edits, n)
            struct.pack_into("<i" if relative else "<I", out, at, to - at - 4 if relative else to)
        return bytes(out)

    return per_document(docs, both, doc, content, ["a", "end", "payload", "relative"], fn)
