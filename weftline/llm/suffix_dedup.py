"""Removal of repeated strings by prefix-free parsing.

Every byte that lies in a ``length``-byte string which also starts somewhere
else in the corpus (same text included) is removed.

Parsing.  The trigger of a window of ``length`` bytes is the ``gram``-byte
string in it with the least rolling hash (the first on ties).  It depends on
the window's bytes alone, so equal windows have equal triggers at equal places,
and every window has one, whatever the text.  Consecutive windows with one
trigger make a phrase; the trigger splits its bytes in two:

* the left part, up to the trigger, is a phrase of the dictionary;
* the right part, from the trigger on, is the parse as it goes on there, to the
  depth that a window can reach (``length`` bytes).

Order.  The window that begins a bytes before a trigger is the last a bytes of a
left part and the first ``length - a`` of a right part.  So the dictionary's
suffix array (left parts, sorted from their ends, with the lengths of common
suffixes) and the parse's suffix array (right parts, sorted from the trigger on,
with the lengths of common prefixes) combine into the order of the corpus'
windows: the class of a window is the pair of its two classes at depth a, and a
class of two is a repeated string (``window_classes``).  This compares bytes.

Scale.

* A trigger that occurs once in the corpus has no repeated window.  This drops
  most of the text before any text is moved.
* A phrase that occurs twice in the parse is repeated as a whole.
* What is left are distinct phrases that share a trigger, mostly borders of
  repeated passages.  They are dealt out by trigger and ordered as above.
* A trigger with more than ``hot_phrases`` distinct phrases is split: its windows
  are dealt into ranges of their distances a, and in each range by the bytes that
  all windows of that range share around the trigger.  Ranges are cut in four
  again and again until every group is small; at a single distance the shared
  bytes are the window itself.  Equal windows stay together at every
  step, so the same order decides all of them and nothing is dropped.

Triggers and whole phrases are matched by two independent 64-bit hashes, of the
trigger and of the phrase; only the ordered parts are compared on bytes.  Texts
travel once for the dictionary and once for the result, copies of a text within
a task only twice (a second copy is what makes it repeated).

Nulls: a null text is the empty text; texts shorter than ``length`` keep all.
A null id is carried through.  Empty table: empty result.  Repeated rows make
each other's text repeated, as any two equal texts do.  Columns other than the
id and the text are not read by ``removals``; ``remove_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, materialise
from ._text import BASE, U64, Hasher, chunks, ranges

POS_BITS = 24
SEGMENT = 1 << 22
UID = ["u1", "u2"]
#: Base of the phrases' own rolling hash.
CONTEXT = 0xD6E8FEB86659FD93


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (two passes over blocks)."""
    n = len(v) - width + 1
    pad = -len(v) % width
    b = np.concatenate([v, np.full(pad, ~U64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def phrases(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """((key, at), ctx, text, lo, size) of every phrase of a chunk.

    key: hash of the trigger; at: its place in the phrase; ctx: hash of the
    phrase and of that place; lo: the phrase's start in its text; size: its bytes.
    """
    parts = []
    n_windows = len(buf) - length + 1
    for at in range(0, max(n_windows, 0), SEGMENT):
        part = buf[at : at + SEGMENT + length - 1]
        h, other = Hasher(part), Hasher(part, CONTEXT)
        g = np.arange(len(part) - gram + 1)
        gh = h(g, g + gram)
        packed = (gh >> U64(POS_BITS) << U64(POS_BITS)) | g.astype(U64)
        own = (_sliding_min(packed, length - gram + 1) & U64((1 << POS_BITS) - 1)).astype(np.int64)
        p = np.arange(len(own))
        doc = np.searchsorted(offs, p + at, "right") - 1
        ok = p + at + length <= offs[doc + 1]
        p, own, doc = p[ok], own[ok], doc[ok]
        if len(p) == 0:
            continue
        new = np.ones(len(p), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(p)]]) - 1
        lo, hi = p[first], p[last] + length
        t = own[first]
        ctx = other(lo, hi) ^ ((t - lo).astype(U64) * BASE)
        parts.append((gh[t], t - lo, ctx, doc[first], lo + at - offs[doc[first]], hi - lo))
    if not parts:
        z = np.zeros(0, np.int64)
        return (z.astype(U64), z), z.astype(U64), z, z, z
    key, place, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    return (key, place), *rest


def suffix_classes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class of the ``length``-byte string at each of the positions ``at``, by
    ranks of a suffix array of ``data`` that prefix doubling orders up to
    ``length`` bytes.  Equal classes are equal strings."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    depth = 1
    rank = padded[:n]
    while depth * 2 <= length:
        if depth < 8:  # eight bytes fit one word: no sort is needed yet
            nxt = np.zeros(n, U64)
            nxt[: n - depth] = rank[depth:]
            rank = (rank << U64(8 * depth)) | nxt
        else:
            if depth == 8:
                rank = np.unique(rank, return_inverse=True)[1].astype(U64)
            nxt = np.zeros(n, U64)
            nxt[: n - depth] = rank[depth:]
            rank = np.unique((rank << U64(32)) | nxt, return_inverse=True)[1].astype(U64)
        depth *= 2
    if depth <= 8:
        rank = np.unique(rank, return_inverse=True)[1].astype(U64)
    pair = (rank[at] << U64(32)) | rank[at + length - depth]
    return np.unique(pair, return_inverse=True)[1]


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): byte rows sorted, and how many first bytes each shares
    with the one before (-1 for the first)."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").ravel(), kind="stable")
    differ = np.ones((n, width + 1), bool)
    differ[1:, :width] = rows[order[1:]] != rows[order[:-1]]
    common = differ.argmax(axis=1)
    common[0] = -1
    return order, common


def window_classes(phrases: list[bytes], at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which windows of the phrases are equal to another: a boolean matrix of
    (phrase, a) for the windows that begin ``a`` bytes before the trigger.

    ``at``: the trigger's place in each phrase; windows with low <= a <= high
    exist.  Left parts are ordered from the trigger backwards, right parts from
    it on; a window's class is the pair of both at depth a and ``length - a``.
    """
    n, reach = len(phrases), length - gram
    data = np.frombuffer(b"".join(phrases), np.uint8)
    size = np.fromiter(map(len, phrases), np.int64, n)
    begin = np.cumsum(size) - size
    left, right = np.zeros((n, reach + 1), np.uint8), np.zeros((n, length), np.uint8)
    back = np.arange(reach + 1)
    there = back[None] < at[:, None]
    left[there] = data[((begin + at - 1)[:, None] - back)[there]]
    ahead = np.arange(length)
    there = ahead[None] < (size - at)[:, None]
    right[there] = data[((begin + at)[:, None] + ahead)[there]]
    lo, lc = _order(left)
    ro, rc = _order(right)
    hit = np.zeros((n, reach + 1), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(low.min()), int(high.max()) + 1):
        some = np.flatnonzero((low <= a) & (a <= high))
        if len(some) < 2:
            continue
        left_class[lo] = np.cumsum(lc < a)
        right_class[ro] = np.cumsum(rc < length - a)
        pair = left_class[some] * (n + 1) + right_class[some]
        order = np.argsort(pair)
        same = pair[order[1:]] == pair[order[:-1]]
        hit[some[order[1:][same]], a] = True
        hit[some[order[:-1][same]], a] = True
    return hit


def _uid(text: str):
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("u1"), F.xxhash64(F.lit(7), t).alias("u2")]


def _once(copies: int):
    """Arrow map: rows (u1, u2, ..) without all but the first ``copies`` of each
    text in a task."""

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            keep = []
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n = seen.get(k, 0)
                if n < copies:
                    seen[k] = n + 1
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(u1, u2, text), every text at most once for each task."""
    rows = docs.select(*_uid(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_once(1), "u1 long, u2 long, text string")


ENTRY = "key long, ctx long, u1 long, u2 long, lo long, at int, low int, high int, open boolean, bytes binary"
_ENTRY = pa.schema(
    [("key", pa.int64()), ("ctx", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64()), ("lo", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("open", pa.bool_()), ("bytes", pa.binary())]
)


def _cutter(length: int, part_bytes: int):
    """Arrow map: (u1, u2, text, entries of the text) -> entries with their bytes."""

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for u1, u2, t, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                for x in entries:
                    lo, size, at = x["lo"], x["size"], x["at"]
                    out.append((x["key"], x["ctx"], u1, u2, lo, at, at - size + length, at, x["open"], raw[lo : lo + size]))
                    held += size
                if held > part_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    return run


def split_entry(at: int, low: int, high: int, data: bytes, shift: int, length: int, reach: int):
    """The windows of an entry dealt by ``a >> shift``: (core, lo, at, low, high,
    bytes) of each range that holds any.

    core: what all windows of the range have in common, wherever they lie.  lo:
    first byte of the new entry in the old one's bytes.
    """
    for r in range(low >> shift, (high >> shift) + 1):
        first, last = r << shift, min(((r + 1) << shift) - 1, reach)
        a, b = max(low, first), min(high, last)
        lo = at - b
        yield data[at - first : at + length - last] + bytes([r]), lo, at - lo, a, b, data[lo : at + length - a]


def _splitter(shift: int, length: int, reach: int):
    """Arrow map: entries of hot triggers -> entries of smaller ranges."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, u1, u2, lo, at, low, high, is_open, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for core, off, place, a, b, part in split_entry(at, low, high, data, shift, length, reach):
                    key = xxhash.xxh64_intdigest(core, shift) - (1 << 63)
                    ctx = xxhash.xxh64_intdigest(part, place) - (1 << 63)
                    rows.append((key, ctx, u1, u2, lo + off, place, a, b, is_open, part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    return run


def _joined_keys(left: DataFrame, right: DataFrame, on: list[str], how: str, n: int, max_rows: int = 200_000) -> DataFrame:
    """Join with a stored table of ``n`` keys of fixed width, broadcast if those are few."""
    return left.join(F.broadcast(right) if n <= max_rows else right.hint("merge"), on, how)


SPAN = "u1 long, u2 long, start long, end long"


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 200, gram: int = 32, hot_phrases: int = 512, part_bytes: int = 1 << 20) -> DataFrame:
    """(u1, u2, start, end): byte spans whose bytes are all to be removed.

    Texts are named by two 64-bit hashes (see ``_uid``); spans of one text may
    overlap or touch.  ``hot_phrases``: the largest group that one task orders.
    """

    def parse(batches):
        for batch, buf, offs in chunks(_once(2)(batches)):
            (key, at), ctx, doc, lo, size = phrases(buf, offs, length, gram)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(lo), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))],
                ["key", "ctx", "u1", "u2", "lo", "size", "at"],
            )

    spark, reach = docs.sparkSession, length - gram
    scratch = Scratch(spark)
    texts = docs.select(*_uid(text), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    parsed = scratch.put(texts.mapInArrow(parse, "key long, ctx long, u1 long, u2 long, lo long, size int, at int"), "pfp-parse")
    # stored, so that the join below shuffles both sides and a hot key can be split
    common = scratch.put(parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "pfp-common")
    cand = scratch.put(parsed.join(common, "key", "left_semi"), "pfp-candidates")
    dictionary = cand.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u1", "u2", "lo", "size", "at")).alias("r"))
    dictionary = scratch.put(dictionary.select("key", "ctx", "n", "r.*"), "pfp-dictionary")
    # phrases of many places are known by broadcast and spread over ranges of their
    # own; the others' places are counted where they meet
    many = dictionary.where(F.col("n") > hot_phrases).select("key", "ctx", F.ceil(F.col("n") / hot_phrases).alias("m"))
    place = _joined_keys(cand, many, ["key", "ctx"], "left", many.count())
    spread = F.pmod(F.xxhash64(*UID, "lo"), F.coalesce("m", F.lit(1)))
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "ctx", "__s"))
    whole = place.withColumn("__s", spread).withColumn("__n", n).where((F.col("__n") > 1) | F.col("m").isNotNull())
    whole = whole.select(*UID, F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end"))

    shared = dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    entry = dictionary.join(shared, "key", "left_semi").select(*UID, F.struct("key", "ctx", "lo", "size", "at", (F.col("n") == 1).alias("open")).alias("x"))
    entry = entry.groupBy(*UID).agg(F.collect_list("x").alias("e"))
    cuts = _texts(docs, text).join(entry, UID).select(*UID, "text", "e").mapInArrow(_cutter(length, part_bytes), ENTRY)
    cuts = scratch.put(cuts, "pfp-cuts")

    groups, found, shift = [], [], (reach | 1).bit_length()
    while True:
        # texts that two tasks have cut come twice, and parts of different phrases can be equal
        same = cuts.select("key", "ctx", *UID, "lo").distinct().groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"))
        size = scratch.put(same.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") > 1).alias("e")), "pfp-groups")
        small, large, n_equal = size.agg(F.count_if((F.col("k") > 1) & (F.col("k") <= hot_phrases)), F.count_if(F.col("k") > hot_phrases), F.coalesce(F.sum("e"), F.lit(0))).first()
        one = cuts.dropDuplicates(["key", "ctx"])
        if n_equal:
            equal = scratch.put(same.where("n > 1").select("key", "ctx", F.lit(True).alias("m")), "pfp-equal")
            more = _joined_keys(cuts.where("open"), equal.drop("m"), ["key", "ctx"], "left_semi", n_equal)
            found.append(more.select(*UID, F.col("lo").alias("start"), (F.col("lo") + F.octet_length("bytes")).alias("end")))
            one = _joined_keys(one, equal, ["key", "ctx"], "left", n_equal).withColumn("open", F.col("open") & F.col("m").isNull()).drop("m")
        last = shift == 0 or not large
        cool = size.where((F.col("k") > 1) & (F.lit(last) | (F.col("k") <= hot_phrases))).select("key")
        groups.append(_joined_keys(one, cool, ["key"], "left_semi", small + large * last))
        if last:
            break
        shift = max(shift - 2, 0)
        hot = size.where(F.col("k") > hot_phrases).select("key")
        cuts = scratch.put(_joined_keys(one, hot, ["key"], "left_semi", large).mapInArrow(_splitter(shift, length, reach), ENTRY), "pfp-parts")

    def search(batches):
        for rows in _whole_keys(batches, part_bytes):
            at, low, high = rows["at"].astype(np.int64), rows["low"], rows["high"]
            hit = window_classes(rows["bytes"], at, low, high, length, gram) & rows["open"][:, None]
            # columns by rising start: the window of distance a starts at ``at - a``
            g, s, e = _spans(hit[:, ::-1].ravel(), np.arange(reach + 1), length)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k][g]) for k in UID] + [pa.array(x + at[g] - reach + rows["lo"][g]) for x in (s, e)], [*UID, "start", "end"])

    part = groups[0]
    for g in groups[1:]:
        part = part.unionByName(g)
    edges = part.repartition("key").sortWithinPartitions("key").mapInArrow(search, SPAN)
    for x in (*found, edges):
        whole = whole.unionByName(x)
    spans = materialise(whole, "pfp-spans")
    scratch.drop()
    return spans


def _spans(mask: np.ndarray, start: np.ndarray, length: int):
    """Maximal runs of repeated windows: (row, first byte, end) of a flat mask of
    rows with the same ``start`` positions."""
    i = np.flatnonzero(mask)
    if len(i) == 0:
        return i, i, i
    row, col = np.divmod(i, len(start))
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(i)]]) - 1
    return row[new], start[col[new]], start[col[last]] + length


def _whole_keys(batches, part_bytes: int):
    """Rows sorted by key, in parts of about ``part_bytes`` that end with a key."""
    names = [f.name for f in _ENTRY][:-1]
    held: list[dict] = []
    size = 0

    def joined():
        out = {k: np.concatenate([h[k] for h in held]) for k in names}
        out["bytes"] = [b for h in held for b in h["bytes"]]
        return out

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        cols["open"] = cols["open"].astype(bool)
        raw = batch.column(len(names)).to_pylist()
        edge = np.concatenate([[0], np.flatnonzero(cols["key"][1:] != cols["key"][:-1]) + 1, [batch.num_rows]])
        at = 0
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            begins = a > 0 or not held or held[-1]["key"][-1] != cols["key"][0]
            if begins and size >= part_bytes:
                if a > at:
                    held.append({k: v[at:a] for k, v in cols.items()} | {"bytes": raw[at:a]})
                    at = a
                yield joined()
                held, size = [], 0
            size += sum(map(len, raw[a:b]))
        held.append({k: v[at:] for k, v in cols.items()} | {"bytes": raw[at:]})
    if held:
        yield joined()


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal runs, in order, of rows (start, end)."""
    if len(spans) == 0:
        return spans.reshape(0, 2)
    s = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], reach[np.concatenate([at[1:], [len(s)]]) - 1]], axis=1)


def _joined(docs: DataFrame, spans: DataFrame, text: str) -> DataFrame:
    by = spans.groupBy(*UID).agg(F.collect_set(F.struct("start", "end")).alias("e"))
    return _texts(docs, text).join(by, UID, "left").select(*UID, "text", "e")


def _pieces(batch):
    """(bytes, merged spans) of every row of (u1, u2, text, e)."""
    e = batch.column(3)
    flat = e.flatten()
    se = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
    n = np.array([0 if v is None else v for v in e.value_lengths().to_pylist()], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(batch.column(2)):
        yield t.as_buffer().to_pybytes(), merge_spans(se[at[i] : at[i + 1]])


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def digest(batches):
        for batch in batches:
            rows = []
            for raw, runs in _pieces(batch):
                h, at = hashlib.sha256(), 0
                for s, e in runs.tolist():
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                rows.append((len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), h.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["u1", "u2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs, text, **options)
    out = _joined(docs, spans, text).mapInArrow(digest, "u1 long, u2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = out.dropDuplicates(UID)
    return docs.select(F.col(doc_id), *_uid(text)).join(out, UID, "left").select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated spans taken out of the text and, if there is
    such a column, ``n_chars`` counted anew.  Spans are drawn in to whole code
    points, so the rest stays valid UTF-8."""

    def rest(batches):
        for batch in batches:
            kept = []
            for raw, runs in _pieces(batch):
                out, at = [], 0
                for s, e in runs.tolist():
                    while s < len(raw) and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    if e > s:
                        out.append(raw[at:s])
                        at = e
                out.append(raw[at:])
                kept.append(b"".join(out).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], ["u1", "u2", "__weft_kept"])

    spans = repeated_spans(docs, text, **options)
    out = _joined(docs, spans, text).where("e is not null").mapInArrow(rest, "u1 long, u2 long, __weft_kept string").dropDuplicates(UID)
    u = [c.alias(f"__weft_{k}") for c, k in zip(_uid(text), UID, strict=True)]
    out = out.withColumnsRenamed({k: f"__weft_{k}" for k in UID})
    joined = docs.select("*", *u).join(out, ["__weft_u1", "__weft_u2"], "left")
    new = F.coalesce(F.col("__weft_kept"), F.col(text))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(new.alias(c))
        elif c == n_chars:
            cols.append(F.when(F.col("__weft_kept").isNull(), F.col(c)).otherwise(F.char_length("__weft_kept").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)
