"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``width`` words joined by one space, repeats included (a text with fewer words
has its whole sequence as one shingle, one without words fingerprint zero); bit
b is set if it is set in over half of the shingles' XXH64 values (seed 42).

Links: two fingerprints are linked at ``radius`` (4) or fewer differing bits.
The 64 bits are split into ``radius + 2`` blocks, so a linked pair agrees in at
least two of them: fingerprints meet in the 15 pairs of blocks (21 bits each),
which keeps chance meetings rare, and every meeting is verified by the Hamming
distance.  Equal fingerprints are one node from the start.

Inside a bucket no list of pairs is made: a breadth-first search removes the
neighbours of each reached fingerprint from the unreached ones, so a bucket
gives at most one edge per member (to the least member of its component there).
Buckets above ``slice_rows`` members are cut into slices, and each pair of
slices is searched by a task of its own; nothing is dropped.  Components of the
edges follow from alternating large-star and small-star rounds, each written to
the shared folder.

Nulls: a null text is the empty text; a null id has its fingerprint but is
never a component's id (null if there is no other).  Ties, repeated rows: rows
with one id or one text are members each.  Empty table: empty result.  Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, materialise
from ._text import U64, chunks, words, xxh64

BITS = 64


def fingerprints(buf: np.ndarray, offs: np.ndarray, width: int = 4) -> np.ndarray:
    """Fingerprint (uint64) of every text of a chunk."""
    n = len(offs) - 1
    ws, we, wd = words(buf, offs)
    out = np.zeros(n, U64)
    if len(ws) == 0:
        return out
    # all words, lower-cased, joined by single spaces: a shingle is then one slice
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    size = we - ws
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(at[-1]), 32, np.uint8)
    moved = np.repeat(at[:-1] - ws, size)
    src = np.flatnonzero(_inside(ws, we, len(buf)))
    flat[src + moved] = low[src]
    per = np.bincount(wd, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    # shingle i starts at word i and ends `width - 1` later; short texts have one
    count = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    begin = np.repeat(first, count) + _within(count)
    end = np.minimum(begin + width, np.repeat(first + per, count))
    h = np.empty(len(begin), U64)
    for a in range(0, len(begin), 1 << 16):  # parts that stay in a cache
        s, e = at[begin[a : a + (1 << 16)]], at[end[a : a + (1 << 16)]] - 1
        h[a : a + (1 << 16)] = xxh64(flat[s[0] : e.max()], s - s[0], e - s[0], 42)
    owner = np.flatnonzero(count)
    starts = np.concatenate([[0], np.cumsum(count[owner])])[:-1]
    weight = U64(1) << np.arange(BITS, dtype=U64)
    step = 1 << 14  # texts in groups of about so many shingles bound the bit matrix
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        a = starts[lo]
        b = starts[hi] if hi < len(starts) else len(h)
        sums = np.zeros((hi - lo, BITS), np.int64)
        for c in range(a, b, step):  # a long text in parts
            d = min(b, c + step)
            bits = np.unpackbits(h[c:d].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.searchsorted(starts, c, "right") - 1, np.searchsorted(starts, d, "left")
            edge = np.maximum(starts[i:j], c) - c
            sums[i - lo : j - lo] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        up = 2 * sums > count[owner[lo:hi], None]
        out[owner[lo:hi]] = (up * weight).sum(axis=1, dtype=U64)
        lo = hi
    return out


def _inside(s: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int8)
    d[s] += 1
    d[e] -= 1
    return np.cumsum(d[:-1], dtype=np.int8) > 0


def _within(count: np.ndarray) -> np.ndarray:
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def fingerprint(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every document as a signed
    long, and XXH64 of its text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, buf, offs in chunks(batches):
            fp = fingerprints(buf, offs, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], [doc_id, "fp", "text_hash"])

    rows = docs.select(doc_id, F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(run, f"{doc_id} {kind}, fp long, text_hash long")


def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of the ``radius + 2`` blocks."""
    n = radius + 2
    edge = [round(i * BITS / n) for i in range(n + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(n)]
    return [a | b for a, b in combinations(block, 2)]


def star_edges(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, for each component of links among ``a`` (or between
    ``a`` and ``b`` and inside both), every member to the least one."""
    rest = np.unique(a if b is None else np.concatenate([a, b]))
    src, dst = [], []
    while len(rest) > 1:
        queue, seen = [rest[0]], [rest[:1]]
        rest = rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                seen.append(found)
                queue.extend(found)
        member = np.concatenate(seen)
        if len(member) > 1:
            low = member.view(np.int64).min()
            other = member.view(np.int64)[member.view(np.int64) != low]
            src.append(np.full(len(other), low))
            dst.append(other)
    z = np.zeros(0, np.int64)
    return (np.concatenate(src) if src else z), (np.concatenate(dst) if dst else z)


def links(fps: DataFrame, radius: int = 4, slice_rows: int = 4096) -> DataFrame:
    """(u, v): edges whose components are those of all links among the distinct
    fingerprints ``fps`` (fp)."""
    masks = block_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "key"))
    size = keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(size, ["m", "key"])
    n_slices = F.ceil(F.col("n") / slice_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_slices).cast("int")
    # row of slice s goes to the tasks (min(s, o), max(s, o)) of all slices o
    keyed = keyed.withColumn("s", own).withColumn("o", F.explode(F.sequence(F.lit(0), n_slices - 1)))
    keyed = keyed.select("m", "key", F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"), "fp")
    keyed = keyed.repartition("m", "key", "p", "q").sortWithinPartitions("m", "key", "p", "q")

    def search(batches):
        for k, fp in _groups(batches):
            u, v = star_edges(fp, None, radius)
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return keyed.mapInArrow(search, "u long, v long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _groups(batches):
    """Consecutive rows with equal (m, key, p, q), across batches."""
    held_key, held = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        fp = cols[4].astype(np.int64).view(U64)
        for i, s in enumerate(at):
            e = at[i + 1] if i + 1 < len(at) else batch.num_rows
            key = tuple(c[s] for c in cols[:4])
            if key != held_key:
                if held:
                    yield held_key, np.concatenate(held)
                held_key, held = key, []
            held.append(fp[s:e])
    if held:
        yield held_key, np.concatenate(held)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (u, v): root is the least node of
    its component, and its own root.

    Large-star: every node's larger neighbours link to its least neighbour
    (itself included); small-star: its smaller neighbours do.  Edges only move
    towards lesser nodes, and the rounds end when neither changes an edge.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc")
    while True:  # rounds are logarithmic in the longest path
        # edges point from the larger to the lesser end
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        new = scratch.put(small, "cc")
        # a forest of stars: each node has one edge and no centre has one
        bad = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not bad and not new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            roots = new.select(F.col("v"), F.col("v").alias("root")).distinct()
            out = materialise(new.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots), "cc-roots")
            scratch.drop()
            return out
        e = new


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root, text_hash) for every row of ``docs``;
    ``root`` names the component by a fingerprint."""
    fps = materialise(fingerprint(docs, width, doc_id, text), "simhash")
    return members(fps, components(links(fps.select("fp").distinct(), radius)), doc_id)


def members(fps: DataFrame, comp: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id, root, text_hash) for every row of ``fps``
    (doc_id, fp, text_hash), by the ``components`` of its fingerprints."""
    nodes = fps.groupBy("fp").agg(F.min(doc_id).alias("__low"))
    comp = comp.select(F.col("v").alias("fp"), "root")
    node = nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    node = materialise(node, "simhash-nodes")
    least = node.groupBy("root").agg(F.min("__low").alias("component_id"))
    node = node.join(least, "root").select("fp", "component_id", "root")
    return fps.join(node, "fp", "left").select(doc_id, "fp", "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: a row with its
    least id stays, of several texts with that id the one of least hash, and of
    equal such rows any one.  Rows without an id stay."""
    return keep_found(docs, near_duplicates(docs, doc_id=doc_id, text=text, **options), doc_id, text)


def keep_found(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep_one`` for components that are ``found`` already."""
    won = found.where(F.col(doc_id) == F.col("component_id")).groupBy("root").agg(F.min(doc_id).alias(doc_id), F.min("text_hash").alias("__weft_h"), F.count(F.lit(1)).alias("__weft_n"))
    won = materialise(won.groupBy(doc_id, "__weft_h").agg(F.sum("__weft_n").alias("__weft_n")), "simhash-kept")
    keyed = docs.withColumn("__weft_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    single = keyed.join(won.where("__weft_n = 1").drop("__weft_n"), [doc_id, "__weft_h"], "left_semi").select(docs.columns)
    # few: winners whose id stands for several rows
    several = keyed.join(won.where("__weft_n > 1").drop("__weft_n"), [doc_id, "__weft_h"], "left_semi").dropDuplicates([doc_id, "__weft_h"]).select(docs.columns)
    return single.unionByName(several).unionByName(docs.where(F.col(doc_id).isNull()))
