"""Containers of named members: index scan, member read, build.

Files come in through ``binaryFile`` (any store that Spark reads) or as a
(container, content) table.  Parsers yield the index alone; payloads are cut and
decoded only when asked for, after the member filter.  A container that does
not parse gives one row with status ``blocked`` and the reason; a member that
does not decode is blocked alone.  Containers too large for a row come as
(container, piece, content), whose contents in the order of pieces are the file.

Formats
  records  u16 byte length and bytes, repeated; members are named by ordinal
  flat     "FLAT", u32 count, entries (u16 name bytes, name, u32 offset, u32
           size, u32 crc32), payloads; little endian
  chunked  magic, u64 index offset, payload segments, index of File chunks with
           info, segm and adlr parts, raw or zlib
  bundle   signature, big-endian sizes, a packed table of blocks and members, and the
           blocks (raw, LZ4 or LZMA) of one stream that holds all members
  tree     u32 4, u32, u32, u32 JSON bytes, JSON {"files": ...}, payloads
"""

from __future__ import annotations

import fnmatch
import json
import lzma
import mmap
import os
import struct
import tempfile
import zlib
from array import array
from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import inflate, lz4_block, unlz4, unlzma_props, xor_position
from ..functions.text import path_key
from ..operators.rewrite import per_document

#: Fixed values of the chunked format: the magic, and the tags File, info, segm
#: and adlr of its index with their field order.
CHUNKED_MAGIC = b"XP3\r\n \n\x1a\x8bg\x01"
#: An index offset that names a pointer block, and where that holds the offset.
POINTER_BLOCK, POINTER_AT = 0x17, 0x20
INDEX = "container string, ordinal long, name string, offset long, size long, stored_size long, codec string, checksum long, status string, reason string"


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def _records(b: bytes):
    at = k = 0
    while at < len(b):
        _need(at + 2 <= len(b), "length cut off")
        (n,) = struct.unpack_from("<H", b, at)
        _need(at + 2 + n <= len(b), "record beyond the end")
        yield {"name": f"{k:06d}", "parts": [(at + 2, n, n, "raw")], "size": n, "sum": None}
        at, k = at + 2 + n, k + 1


def _flat(b: bytes):
    _need(b[:4] == b"FLAT" and len(b) >= 8, "no FLAT header")
    (count,) = struct.unpack_from("<I", b, 4)
    at = 8
    for _ in range(count):
        _need(at + 2 <= len(b), "index cut off")
        (n,) = struct.unpack_from("<H", b, at)
        _need(at + 2 + n + 12 <= len(b), "index cut off")
        name = b[at + 2 : at + 2 + n].decode("utf-8")
        off, size, crc = struct.unpack_from("<III", b, at + 2 + n)
        _need(off + size <= len(b), f"{name}: range beyond the end")
        yield {"name": name, "parts": [(off, size, size, "raw")], "size": size, "sum": ("crc32", crc)}
        at += 14 + n


def _subchunks(b: bytes):
    at = 0
    while at < len(b):
        _need(at + 12 <= len(b), "chunk head cut off")
        tag, (n,) = b[at : at + 4], struct.unpack_from("<Q", b, at + 4)
        _need(at + 12 + n <= len(b), "chunk beyond the end")
        yield tag, b[at + 12 : at + 12 + n]
        at += 12 + n


def _chunk_index(b: bytes, at: int, limit: int) -> bytes:
    flag = b[at]
    if flag == 1:
        stored, size = struct.unpack_from("<QQ", b, at + 1)
        _need(size <= limit and at + 17 + stored <= len(b), "index size")
        index = inflate(b[at + 17 : at + 17 + stored], size)
        _need(len(index) == size, "index size")
    else:
        _need(flag == 0, "unknown index flag")
        (size,) = struct.unpack_from("<Q", b, at + 1)
        _need(at + 9 + size <= len(b), "index beyond the end")
        index = b[at + 9 : at + 9 + size]
    return index


def _chunked(b: bytes, limit: int = 1 << 28):
    _need(b[: len(CHUNKED_MAGIC)] == CHUNKED_MAGIC and len(b) >= 19, "no magic")
    (at,) = struct.unpack_from("<Q", b, 11)
    if at == POINTER_BLOCK and len(b) >= POINTER_AT + 8:  # the offset may stand in a block of its own
        (there,) = struct.unpack_from("<Q", b, POINTER_AT)
        at = there if 19 <= there < len(b) else at
    _need(19 <= at and at + 9 <= len(b), "index beyond the end")
    index = _chunk_index(b, at, limit)
    for tag, body in _subchunks(index):
        _need(tag == b"File", "unknown index chunk")
        part = dict(_subchunks(body))
        _need({b"info", b"segm", b"adlr"} <= part.keys(), "incomplete entry")
        flags, size, _, units = struct.unpack_from("<IQQH", part[b"info"])
        name = part[b"info"][22 : 22 + 2 * units].decode("utf-16-le")
        _need(flags == 0, f"{name}: unknown flags")
        parts = []
        for k in range(0, len(part[b"segm"]), 28):
            kind, off, n, stored = struct.unpack_from("<IQQQ", part[b"segm"], k)
            _need(kind in (0, 1) and off + stored <= len(b) and n <= limit, f"{name}: bad segment")
            parts.append((off, n, stored, "zlib" if kind else "raw"))
        _need(sum(p[1] for p in parts) == size, f"{name}: segments do not add up")
        yield {"name": name, "parts": parts, "size": size, "sum": ("adler32", struct.unpack("<I", part[b"adlr"])[0])}


def _tree(b: bytes):
    _need(len(b) >= 16, "head cut off")
    four, head, _, n = struct.unpack_from("<IIII", b)
    _need(four == 4 and 16 + n <= len(b), "bad head")
    base = 8 + head

    def walk(node, path):
        for k, v in node["files"].items():
            name = f"{path}{k}"
            if "files" in v:
                yield from walk(v, name + "/")
            elif not v.get("unpacked"):
                off, size = base + int(v["offset"]), int(v["size"])
                _need(0 <= off and off + size <= len(b), f"{name}: range beyond the end")
                yield {"name": name, "parts": [(off, size, size, "raw")], "size": size, "sum": None}

    yield from walk(json.loads(b[16 : 16 + n]), "")


#: Fixed values of the bundle format: its signature, and block methods by number.
BUNDLE_MAGIC, METHODS = b"UnityFS\0", {0: "raw", 1: "props-lzma", 2: "lz4", 3: "lz4"}


def _block(data: bytes, size: int, method: str) -> bytes:
    out = data if method == "raw" else unlz4(data, size) if method == "lz4" else unlzma_props(data, size)
    _need(len(out) == size, "block size")
    return out


class _Stream:
    """Members of a bundle lie in one stream that is cut into packed blocks; each is
    the blocks that it touches, and what to skip in the first.  Kept are numbers of
    the table's names, offsets and sizes: a container may hold millions."""

    def __init__(self, info: bytes, parts: list, starts: list, ends: list, table: array):
        self.info, self.parts, self.starts, self.ends, self.table = info, parts, starts, ends, table

    def __iter__(self):
        t = self.table
        for k in range(0, len(t), 3):
            p, off, size = t[k : k + 3]
            first = bisect_right(self.ends, off)
            mine = self.parts[first : bisect_left(self.starts, off + size)]
            name = self.info[p : self.info.index(b"\0", p)].decode()
            yield {"name": name, "parts": mine, "size": size, "sum": None, "at": off, "skip": off - self.starts[first] if mine else 0}


def _bundle(b: bytes, limit: int = 1 << 28) -> _Stream:
    _need(b[: len(BUNDLE_MAGIC)] == BUNDLE_MAGIC, "no signature")
    at = len(BUNDLE_MAGIC) + 4
    for _ in range(2):  # two versions as text
        at = b.find(b"\0", at) + 1
        _need(at > 0, "head cut off")
    total, packed, size, flags = struct.unpack_from(">QIII", b, at)
    at += 20
    _need(total == len(b) and packed <= len(b) and size <= max(limit, 32 * packed), "header sizes")
    tail = flags & 0x80
    start = len(b) - packed if tail else at
    info = _block(b[start : start + packed], size, METHODS.get(flags & 0x3F, ""))
    at = at if tail else at + packed
    (n,) = struct.unpack_from(">I", info, 16)
    _need(20 + 10 * n + 4 <= len(info), "block table")
    parts, starts, ends, there, pos = [], [], [], 0, at
    for k in range(n):
        whole, stored, kind = struct.unpack_from(">IIH", info, 20 + 10 * k)
        _need(pos + stored <= len(b) and whole <= limit and kind & 0x3F in METHODS, "block")
        parts.append((pos, whole, stored, METHODS[kind & 0x3F]))
        starts.append(there)
        there, pos = there + whole, pos + stored
        ends.append(there)
    p = 20 + 10 * n
    (n,) = struct.unpack_from(">I", info, p)
    p, table = p + 4, array("q")
    for _ in range(n):
        off, size = struct.unpack_from(">QQ", info, p)
        end = info.index(b"\0", p + 20)
        name = info[p + 20 : end].decode()
        _need(off + size <= there, f"{name}: range beyond the end")
        table.extend((p + 20, off, size))
        p = end + 1
    return _Stream(info, parts, starts, ends, table)


PARSERS = {"bundle": _bundle, "records": _records, "flat": _flat, "chunked": _chunked, "tree": _tree}


#: What a part of a container raises if it does not decode.
REFUSED = (ValueError, zlib.error, lzma.LZMAError)


def _unpacked(b: bytes, part: tuple) -> bytes | Exception:
    o, n, s, c = part
    try:
        return b[o : o + s] if c == "raw" else inflate(b[o : o + s], n) if c == "zlib" else _block(b[o : o + s], n, c)
    except REFUSED as x:
        return x


def _payload(b: bytes, entry: dict, undo=bytes, kept: dict | None = None) -> bytes:
    """``kept`` goes from member to member with the blocks of the one before, which
    neighbours in a stream share; without it every part is decoded anew."""
    known = {} if kept is None else kept
    blocks = {x: known[x] if x in known else _unpacked(b, x) for x in entry["parts"]}
    if kept is not None:
        kept.clear()
        kept.update(blocks)
    for x in blocks.values():
        if isinstance(x, Exception):
            raise x
    out = undo(b"".join(blocks[x] for x in entry["parts"]))
    if "skip" in entry:
        out = out[entry["skip"] : entry["skip"] + entry["size"]]
    _need(len(out) == entry["size"], "size differs")
    if entry["sum"]:
        kind, want = entry["sum"]
        _need((zlib.crc32 if kind == "crc32" else zlib.adler32)(out) == want, f"{kind} differs")
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """(container, content) of all files below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("container"), "content")


#: Bytes of payload after which a batch of members is handed on.
BATCH = 1 << 24
FIELDS = [("container", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("stored_size", pa.int64()), ("codec", pa.string()), ("checksum", pa.int64()), ("status", pa.string()), ("reason", pa.string())]


def _in_order(entries):
    """(ordinal, entry), members of a stream in its order.  Names are compared where
    their hashes meet, so that not all are held."""
    marks = np.fromiter(((hash(e["name"].casefold()), e.get("at", 0)) for e in entries), np.dtype((np.int64, 2)))
    keys = np.sort(marks[:, 0])
    twice = set(keys[1:][keys[1:] == keys[:-1]].tolist())
    if twice:
        seen = [n for n in (e["name"].casefold() for e in entries) if hash(n) in twice]
        _need(len(set(seen)) == len(seen), "two members with one name")
    every = enumerate(entries)
    return sorted(every, key=lambda x: x[1]["at"]) if (np.diff(marks[:, 1]) < 0).any() else every


def _scanned(name: str, b: bytes, fmt: str, pattern: str | None, payload: bool):
    """Record batches of one container."""
    schema = pa.schema(FIELDS + [("payload", pa.binary())] * payload)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    try:
        entries = PARSERS[fmt](b)
        every = _in_order(entries if isinstance(entries, _Stream) else list(entries))
    except (*REFUSED, KeyError, TypeError, AttributeError, IndexError, struct.error, RecursionError) as x:
        yield batch([(name, -1, None, None, None, None, None, None, "blocked", str(x) or type(x).__name__, None)[: len(schema)]])
        return
    rows, held, kept = [], 0, {}
    for k, e in every:
        if pattern and not fnmatch.fnmatchcase(e["name"].casefold(), pattern.casefold()):
            continue
        data, state, why = None, "success", None
        if payload:
            try:
                data = _payload(b, e, kept=kept)
            except REFUSED as x:
                state, why = "blocked", str(x)
        first = e["parts"][0] if e["parts"] else (0, 0, 0, "raw")
        rows.append((name, k, e["name"], first[0], e["size"], sum(p[2] for p in e["parts"]), first[3], e["sum"] and e["sum"][1], state, why, data)[: len(schema)])
        held += 256 + len(data or b"")
        if held >= BATCH:
            yield batch(rows)
            rows, held = [], 0
    yield batch(rows)


def scan(table: DataFrame, fmt: str, pattern: str | None = None, payload: bool = False) -> DataFrame:
    """Index of every container, and the payloads if asked for.

    ``pattern``: shell pattern on the case-folded member name, applied before any
    payload is read.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _scanned(name, content.as_buffer().to_pybytes() if content.is_valid else b"", fmt, pattern, payload)

    return table.select(F.col("container").cast("string"), "content").mapInArrow(run, INDEX + (", payload binary" if payload else ""))


def scan_pieces(table: DataFrame, fmt: str, pattern: str | None = None, payload: bool = False) -> DataFrame:
    """``scan`` of containers in pieces (container, piece, content), cut anywhere.  A
    task lays one container at a time into a scratch file and reads it there, so no
    row, no Arrow array and no worker's memory holds it whole."""

    def rows(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1), strict=True)

    def run(batches):
        for name, pieces in groupby(rows(batches), key=lambda r: r[0]):
            with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as f:
                for _, content in pieces:
                    if content.is_valid:
                        f.write(content.as_buffer())
                f.flush()
                if not f.tell():
                    yield from _scanned(name, b"", fmt, pattern, payload)
                    continue
                with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as b:
                    for out in _scanned(name, b, fmt, pattern, payload):
                        yield out
                        b.madvise(mmap.MADV_DONTNEED)

    t = table.select(F.col("container").cast("string").alias("container"), "piece", "content")
    t = t.repartition("container").sortWithinPartitions("container", "piece").select("container", "content")
    return t.mapInArrow(run, INDEX + (", payload binary" if payload else ""))


def _build_records(members):
    for _, d in members:
        _need(len(d) < 1 << 16, "record too long")
    return b"".join(struct.pack("<H", len(d)) + d for _, d in members)


def _build_flat(members):
    names = [n.encode() for n, _ in members]
    at = 8 + sum(14 + len(n) for n in names)
    head = [b"FLAT", struct.pack("<I", len(members))]
    for n, (_, d) in zip(names, members, strict=True):
        head.append(struct.pack("<H", len(n)) + n + struct.pack("<III", at, len(d), zlib.crc32(d)))
        at += len(d)
    return b"".join(head + [d for _, d in members])


def _build_chunked(members):
    chunk = lambda t, b: t + struct.pack("<Q", len(b)) + b
    body, index, at = [], [], 19
    for name, d in members:
        z = zlib.compress(d)
        packed = len(z) < len(d)
        s = z if packed else d
        units = name.encode("utf-16-le")
        info = struct.pack("<IQQH", 0, len(d), len(s), len(units) // 2) + units
        index.append(chunk(b"File", chunk(b"info", info) + chunk(b"segm", struct.pack("<IQQQ", int(packed), at, len(d), len(s))) + chunk(b"adlr", struct.pack("<I", zlib.adler32(d)))))
        body.append(s)
        at += len(s)
    raw = b"".join(index)
    z = zlib.compress(raw)
    return CHUNKED_MAGIC + struct.pack("<Q", at) + b"".join(body) + b"\1" + struct.pack("<QQ", len(z), len(raw)) + z


def _build_tree(members):
    root, at = {"files": {}}, 0
    for name, d in members:
        node = root
        *dirs, leaf = name.split("/")
        for k in dirs:
            node = node["files"].setdefault(k, {"files": {}})
        node["files"][leaf] = {"size": len(d), "offset": str(at)}
        at += len(d)
    j = json.dumps(root, separators=(",", ":")).encode()
    pad = -len(j) % 4
    return struct.pack("<IIII", 4, len(j) + pad + 8, len(j) + pad + 4, len(j)) + j + b"\0" * pad + b"".join(d for _, d in members)


def _write_bundle(members, block: int = 1 << 17, piece: int = 1 << 22):
    """Numbered pieces of a bundle from members one by one.  The head tells all sizes and
    so is known last, as number 0."""
    rest, blocks, table, out, held, k, at, n, stored = bytearray(), bytearray(), bytearray(), [], 0, 0, 0, 0, 0

    def pack(x):
        nonlocal held, stored
        z = lz4_block(x)
        z, kind = (z, 3) if len(z) < len(x) else (x, 0)
        blocks.extend(struct.pack(">IIH", len(x), len(z), kind))
        out.append(z)
        held, stored = held + len(z), stored + len(z)

    for name, d in members:
        table += struct.pack(">QQI", at, len(d), 4) + name.encode() + b"\0"
        at, n = at + len(d), n + 1
        rest += d
        whole = len(rest) - len(rest) % block
        for a in range(0, whole, block):
            pack(bytes(rest[a : a + block]))
            if held >= piece:
                k += 1
                yield k, b"".join(out)
                out, held = [], 0
        del rest[:whole]
    if rest:
        pack(bytes(rest))
    if out:
        yield k + 1, b"".join(out)
    info = b"".join((bytes(16), struct.pack(">I", len(blocks) // 10), blocks, struct.pack(">I", n), table))
    z = lz4_block(info)
    head = BUNDLE_MAGIC + struct.pack(">I", 6) + b"5.x.x\0" + b"2019.1\0"
    yield 0, head + struct.pack(">QIII", len(head) + 20 + len(z) + stored, len(z), len(info), 0x43) + z


def _build_bundle(members):
    return b"".join(x for _, x in sorted(_write_bundle(members)))


BUILDERS = {"bundle": _build_bundle, "records": _build_records, "flat": _build_flat, "chunked": _build_chunked, "tree": _build_tree}


def build(members: DataFrame, fmt: str, container: str = "container") -> DataFrame:
    """(container, content) from (container, ordinal, name, payload), members in
    ordinal order.  One container is one file and so one group."""
    make = BUILDERS[fmt]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        rows = zip(t.column("name").to_pylist(), t.column("payload").to_pylist(), strict=True)
        return pa.table({"container": pa.array([t.column("container")[0].as_py()], pa.string()), "content": pa.array([make([(n, d or b"") for n, d in rows])], pa.binary())})

    m = members.select(F.col(container).cast("string").alias("container"), "ordinal", "name", "payload")
    return m.groupBy("container").applyInArrow(run, "container string, content binary")


#: Formats that are written member by member.
WRITERS = {"bundle": _write_bundle}


def build_pieces(members: DataFrame, fmt: str, container: str = "container") -> DataFrame:
    """``build`` in pieces (container, piece, content) of a few megabytes, for containers
    of any size; members stream through and only the index is held."""
    write = WRITERS[fmt]

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches):
        for name, every in groupby(rows(batches), key=lambda r: r[0]):
            for k, data in write((n, d or b"") for _, n, d in every):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([k], pa.int64()), pa.array([data], pa.binary())], ["container", "piece", "content"])

    m = members.select(F.col(container).cast("string").alias("container"), "ordinal", "name", "payload")
    m = m.repartition("container").sortWithinPartitions("container", "ordinal").select("container", "name", "payload")
    return m.mapInArrow(run, "container string, piece long, content binary")


def replace_members(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Members of (container, ordinal, name, payload) with the payloads of
    ``changes`` (container, name, payload) put in; others stay byte for byte."""
    c = changes.select("container", "name", F.col("payload").alias("__new"), F.lit(True).alias("__hit"))
    j = index.join(c, ["container", "name"], "left")
    return j.select("container", "ordinal", "name", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("payload")).alias("payload"))


def _patch_flat(b: bytes, new: dict[str, bytes]) -> bytes:
    out, at = bytearray(b), 8
    for _ in range(struct.unpack_from("<I", b, 4)[0]):
        (n,) = struct.unpack_from("<H", b, at)
        name = b[at + 2 : at + 2 + n].decode()
        if name in new:
            struct.pack_into("<III", out, at + 2 + n, len(out), len(new[name]), zlib.crc32(new[name]))
            out += new[name]
        at += 14 + n
    return bytes(out)


def _patch_chunked(b: bytes, new: dict[str, bytes]) -> bytes:
    (at,) = struct.unpack_from("<Q", b, 11)
    if at == POINTER_BLOCK and 19 <= struct.unpack_from("<Q", b, POINTER_AT)[0] < len(b):
        field, (at,) = POINTER_AT, struct.unpack_from("<Q", b, POINTER_AT)
    else:
        field = 11
    chunk = lambda t, d: t + struct.pack("<Q", len(d)) + d
    out, index = bytearray(b), []
    for tag, body in _subchunks(_chunk_index(b, at, 1 << 28)):
        parts = list(_subchunks(body))
        info = dict(parts)[b"info"]
        name = info[22 : 22 + 2 * struct.unpack_from("<H", info, 20)[0]].decode("utf-16-le")
        if name in new:
            d = new[name]
            own = {b"info": info[:4] + struct.pack("<QQ", len(d), len(d)) + info[20:], b"segm": struct.pack("<IQQQ", 0, len(out), len(d), len(d)), b"adlr": struct.pack("<I", zlib.adler32(d))}
            out += d
            parts = [(t, own.get(t, x)) for t, x in parts]
        index.append(chunk(tag, b"".join(chunk(t, x) for t, x in parts)))
    struct.pack_into("<Q", out, field, len(out))
    raw = b"".join(index)
    return bytes(out) + b"\0" + struct.pack("<Q", len(raw)) + raw


PATCHERS = {"flat": _patch_flat, "chunked": _patch_chunked}


def patch(table: DataFrame, changes: DataFrame, fmt: str) -> DataFrame:
    """(container, content, status, reason): containers with the payloads of
    ``changes`` (container, name, payload) put in place.

    New payloads go behind the old bytes and the index is led to them: what the
    parser does not know (gaps, further index parts, old payloads) stays byte for
    byte.  A change that names no member blocks its container.
    """
    parser, patcher = PARSERS[fmt], PATCHERS[fmt]

    def fn(data, every):
        new = {c["name"]: bytes(c["payload"]) for c in every}
        _need(new.keys() <= {e["name"] for e in parser(data)}, "no such member")
        return patcher(data, new)

    return per_document(table.select(F.col("container").cast("string"), "content"), changes, "container", "content", ["name", "payload"], fn)


#: Profiles of the chunked format in the order in which they are tried.
PROFILES = {"plain": lambda b: b, "xor-low-byte": lambda b: xor_position(b, 0)}


def detect_profile(table: DataFrame) -> DataFrame:
    """(container, profile): the first profile under which a chunked container's
    every member passes its checksum; null if none does."""

    def one(data):
        for name, undo in PROFILES.items():
            try:
                entries = list(_chunked(data))
                for e in entries:
                    _payload(data, e, undo)
                return name
            except (ValueError, KeyError, struct.error, zlib.error):
                continue
        return None

    def run(batches):
        for batch in batches:
            found = [None if v is None else one(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["container", "profile"])

    return table.select(F.col("container").cast("string"), "content").mapInArrow(run, "container string, profile string")


def changed_members(new: DataFrame, old: DataFrame) -> DataFrame:
    """Members that are new in their container or whose bytes differ there."""
    known = old.select("container", "name", F.sha2("payload", 256).alias("__d"))
    return new.withColumn("__d", F.sha2("payload", 256)).join(known, ["container", "name", "__d"], "left_anti").drop("__d")


def flat_patch(changed: DataFrame, members: DataFrame) -> DataFrame:
    """``changed`` members under their base names: adds packed_as and conflict.

    conflict: another member of the container (changed or not, in ``members``)
    has the same base name regardless of case; such a patch would shadow it and
    packed_as is null.  An empty result means that there is nothing to pack.
    """
    base = F.element_at(F.split("name", "/"), -1)
    used = members.select("container", "name", path_key(base).alias("__b")).distinct()
    used = used.groupBy("container", "__b").agg(F.count(F.lit(1)).alias("__n"))
    out = changed.withColumn("__b", path_key(base)).join(used, ["container", "__b"], "left")
    out = out.withColumn("conflict", F.coalesce(F.col("__n"), F.lit(0)) > 1)
    return out.withColumn("packed_as", F.when(~F.col("conflict"), base)).drop("__b", "__n")
