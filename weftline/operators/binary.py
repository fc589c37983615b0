"""Edits of bytes: splicing with relocation of pointers."""

from __future__ import annotations

import struct
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splice(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Sorted edits that do not overlap, applied at once."""
    out, at = [], 0
    for s, e, r in edits:
        if not at <= s < e <= len(data):
            raise ValueError("edits overlap, are empty or leave the data")
        out += [data[at:s], r]
        at = e
    return b"".join([*out, data[at:]])


def moved(address: int, edits: list[tuple[int, int, bytes]], size: int) -> int:
    """Where an address of ``size`` old bytes (the end included) lies after the
    edits; none inside a replaced span."""
    if not 0 <= address <= size:
        raise ValueError("address outside the data")
    k = bisect_right([s for s, _, _ in edits], address)
    if k and edits[k - 1][0] < address < edits[k - 1][1]:
        raise ValueError("address inside an edit")
    return address + sum(len(r) - (e - s) for s, e, r in edits[:k] if e <= address)


def repair(data: bytes, edits: list[tuple[int, int, bytes]], fields: list[int], base: int = 0, unit: int = 1, order: str = "<") -> bytes:
    """Splice, then rewrite the u32 pointers at the old offsets ``fields``, which
    count ``unit`` bytes from ``base``; the base is an old address and moves too.

    Refused: a field outside the data, inside an edit or over another field, and
    a target outside the data or inside an edit.
    """
    if unit < 1:
        raise ValueError("unit below 1")
    edits, n = sorted(edits), len(data)
    out = bytearray(splice(data, edits))
    fields = sorted(fields)
    if any(b - a < 4 for a, b in zip(fields, fields[1:])):
        raise ValueError("fields overlap")
    start = moved(base, edits, n)
    for f in fields:
        if not 0 <= f <= n - 4 or any(s < f + 4 and f < e for s, e, _ in edits):
            raise ValueError("field outside the data or inside an edit")
        (v,) = struct.unpack_from(order + "I", data, f)
        to = moved(base + v * unit, edits, n) - start
        if to % unit or not 0 <= to // unit < 1 << 32:
            raise ValueError("pointer cannot hold its target")
        struct.pack_into(order + "I", out, moved(f, edits, n), to // unit)
    return bytes(out)


def patch(docs: DataFrame, edits: DataFrame, pointers: DataFrame, doc: str, content: str, base: int = 0, unit: int = 1, big_endian: bool = False) -> DataFrame:
    """(doc, content, status, reason): every document with its edits (doc, start,
    end, replacement) applied and its pointers (doc, field) repaired.

    A document that breaks a rule keeps its bytes and is blocked.  The edits of a
    document travel as one array beside it.
    """
    e = edits.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("e"))
    p = pointers.groupBy(doc).agg(F.sort_array(F.collect_list("field")).alias("p"))
    kind = docs.schema[doc].dataType.simpleString()
    order = ">" if big_endian else "<"

    def run(batches):
        for batch in batches:
            out, status, why = [], [], []
            for data, es, ps in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = data.as_buffer().to_pybytes() if data.is_valid else b""
                try:
                    out.append(repair(raw, [(x["start"], x["end"], bytes(x["replacement"])) for x in es or []], ps or [], base, unit, order))
                    status.append("success")
                    why.append(None)
                except ValueError as x:
                    out.append(raw)
                    status.append("blocked")
                    why.append(str(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(status), pa.array(why, pa.string())], [doc, "content", "status", "reason"])

    return docs.join(e, doc, "left").join(p, doc, "left").select(doc, content, "e", "p").mapInArrow(run, f"{doc} {kind}, content binary, status string, reason string")
