"""Near copies: SimHash with blocks wide enough for a similarity of shingle sets.

Shingles: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, sets of 64-bit hashes
of ``width`` words joined by one space (a text with fewer words has its whole
sequence as one shingle, one without words the empty set).  Two texts are linked
if their sets' Jaccard similarity is ``similarity`` (0.8) or more; equal sets are
one node from the start.

Fingerprints.  Every shingle stands for a word of random signs (the row of its
hash in a fixed sign matrix, with a sign of its own); bit b of a text is set if
more of its shingles have + than - there.  Two sets of cosine c differ in a bit
with probability acos(c) / pi: 0.15 at a similarity of 0.8, 0.5 for unrelated
texts.  A radius of 4 of 64 bits, as ``simhash`` has, is a similarity of about
0.95; no single split of 64 bits lets pairs at 0.8 share a block and others not.
So the fingerprint is longer, and its blocks are as many as it takes:

* block width: log2 of the texts over ``bucket`` (16), so that chance meetings
  per block stay alike at every size;
* blocks: so many that a pair at exactly ``similarity`` shares none of them with
  probability ``miss`` (0.001) at most; above it the probability falls steeply;
* meeting pairs are verified by the Hamming distance of ``CHECK`` further bits
  (at most ``RADIUS`` of 128: four deviations above the mean of a pair at 0.8,
  and nearly five below that of unrelated ones).

Texts that pass, directly or over others, form a cluster, whose members are all
compared by their whole sets: nothing is linked on fingerprints alone.

Buckets of more than ``slice_rows`` members and clusters of more than
``slice_bytes`` of sets are cut into slices, and each pair of slices is compared
by a task of its own; nothing is dropped.  Inside a task each member gives at
most one edge.

Nulls, ties, repeated rows, empty table: as in ``simhash``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, sized_join
from ._text import BASE, U64, Hasher, chunks, mix, ranges, words
from .simhash import components, keep_found, members

#: Entries of the sign matrix, bits of the Hamming check and its radius.
ENTRIES, CHECK, RADIUS = 2048, 128, 36


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the distinct hashes[bounds[i]:bounds[i + 1]],
    in ascending order."""
    n = len(offs) - 1
    ws, we, wd = words(buf, offs)
    if len(ws) == 0:
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    # all words, lower-cased, joined by single spaces: a shingle is then one slice
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    size = we - ws
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(at[-1]), 32, np.uint8)
    flat[ranges(at[:-1], size)] = low[ranges(ws, size)]
    per = np.bincount(wd, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    count = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    begin = ranges(first, count)
    end = np.minimum(begin + width, np.repeat(first + per, count))
    h = Hasher(flat)(at[begin], at[end] - 1)
    owner = np.repeat(np.arange(n), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def shape(n_texts: int, similarity: float, bucket: int, miss: float) -> tuple[int, int]:
    """(bits of a block, blocks) for so many texts."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(max(10, math.ceil(math.log2(max(n_texts, 1) / bucket))), 48)
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


@lru_cache(maxsize=2)
def signs(columns: int) -> np.ndarray:
    """The sign matrix: a fixed random word of ``columns`` signs for each entry."""
    return np.random.default_rng(5).integers(0, 2, (ENTRIES, columns), dtype=np.int8).astype(np.float32) * 2 - 1


def fingerprints(h: np.ndarray, bounds: np.ndarray, bits: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set hash, check bits as two words, block keys) of every set; the empty set
    has hash 0 and no meaning beyond that."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    ident = np.zeros(n, U64)
    full = np.flatnonzero(size)
    if len(full):
        ident[full] = mix(np.add.reduceat(mix(h ^ BASE), bounds[full]) + size[full].astype(U64))
    check, keys = np.zeros((n, 2), U64), np.zeros((n, blocks), U64)
    matrix = signs(CHECK + bits * blocks)
    own = np.repeat(np.arange(n), size)
    entry, sign = (h % U64(ENTRIES)).astype(np.int64), np.where((h >> U64(63)).astype(bool), 1.0, -1.0)
    for a in range(0, n, 256):
        b = min(n, a + 256)
        of = slice(bounds[a], bounds[b])
        v = np.bincount((own[of] - a) * ENTRIES + entry[of], weights=sign[of], minlength=(b - a) * ENTRIES)
        up = v.reshape(b - a, ENTRIES).astype(np.float32) @ matrix > 0
        check[a:b] = np.packbits(up[:, :CHECK], axis=1).view(U64)
        for k in range(blocks):
            at = CHECK + k * bits
            word = up[:, at : at + bits] @ (U64(1) << np.arange(bits, dtype=U64))
            keys[a:b, k] = mix(word * BASE + U64(k))
    return ident, check, keys


def signatures(docs: DataFrame, width: int, bits: int, blocks: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp, text_hash, node, a, b, keys): set hash, XXH64 of the text, hash
    of the check bits, the check bits, block keys."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, buf, offs in chunks(batches):
            ident, check, keys = fingerprints(*shingle_sets(buf, offs, width), bits, blocks)
            node = mix(check[:, 0] * BASE + check[:, 1])
            at = np.arange(0, keys.size + 1, blocks, dtype=np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))
            cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (ident, node, check[:, 0], check[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), cols[0], batch.column(2), *cols[1:], keys], [doc_id, "fp", "text_hash", "node", "a", "b", "keys"])

    table = docs.select(doc_id, F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    return table.mapInArrow(run, f"{doc_id} {kind}, fp long, text_hash long, node long, a long, b long, keys array<long>")


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def bucket_edges(group: np.ndarray, words: np.ndarray, small: int = 64) -> np.ndarray:
    """For rows sorted by ``group``: the first row of each row's component (and so
    the least, if they are sorted) of pairs within ``RADIUS`` bits of each other in one group."""
    n = len(group)
    root = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(start, size)) - 1  # rows of the group behind each
    left[np.repeat(size > small, size)] = 0
    src, dst = [], []
    for d in range(1, small):
        i = np.flatnonzero(left >= d)
        if len(i) == 0:
            break
        i = i[_far(words[i], words[i + d]) <= RADIUS]
        src.append(i)
        dst.append(i + d)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst))
    while len(u):  # least labels spread until nothing changes
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    for s, m in zip(start[size > small], size[size > small], strict=True):
        rest = np.arange(s, s + m)
        while len(rest) > 1:
            first, queue, rest = rest[0], [rest[0]], rest[1:]
            while queue and len(rest):
                near = _far(words[rest], words[queue.pop()]) <= RADIUS
                root[rest[near]] = first
                queue.extend(rest[near].tolist())
                rest = rest[~near]
    return root


def meetings(nodes: DataFrame, slice_rows: int, first: int, last: int) -> DataFrame:
    """(u, v): edges between the labels of nodes (label, a, b, keys) that share one
    of the blocks ``first`` to ``last - 1`` and pass the Hamming check."""
    keyed = nodes.select("label", "a", "b", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows)
    keyed = sized_join(keyed, hot, "key", "left", 200_000)
    slices = F.ceil(F.coalesce("n", F.lit(1)) / slice_rows).cast("int")
    keyed = keyed.withColumn("s", F.pmod(F.xxhash64("a", "b"), slices).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), slices - 1)))
    # row of slice s goes to the tasks (min(s, o), max(s, o)) of all slices o
    keyed = keyed.select(F.xxhash64("key", F.least("s", "o"), F.greatest("s", "o")).alias("g"), "label", "a", "b")
    # by label, so that the least of a component stands for it in every bucket
    keyed = keyed.repartition("g").sortWithinPartitions("g", "label")

    def search(batches):
        for g, label, words in _runs(batches):
            root = bucket_edges(g, words)
            i = np.flatnonzero(label[root] != label)
            if len(i):
                pairs = np.unique(np.stack([label[i], label[root[i]]]), axis=1)
                yield pa.RecordBatch.from_pydict({"u": pairs[0], "v": pairs[1]})

    return keyed.mapInArrow(search, "u long, v long")


def clusters(sig: DataFrame, scratch: Scratch, slice_rows: int, blocks: int, ahead: int = 4) -> DataFrame:
    """(node, cluster) of every node but the empty set's.

    The first ``ahead`` blocks find most groups of close copies; the others then
    speak of those groups by one label, so that a large group gives edges only
    where it meets another.
    """
    nodes = scratch.put(sig.where("fp <> 0").dropDuplicates(["node"]).select("node", "a", "b", "keys"), "near-copies-nodes")
    near = components(meetings(nodes.withColumnRenamed("node", "label"), slice_rows, 0, ahead))
    nodes = nodes.join(near.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    more = components(meetings(nodes, slice_rows, ahead, blocks)).withColumnRenamed("v", "label")
    return nodes.select("node", "label").join(more, "label", "left").select("node", F.coalesce("root", "label").alias("cluster"))


def _runs(batches, least: int = 1 << 16):
    """(g, label, check words) of ``least`` or more sorted rows that end with a g."""
    held: list[list[np.ndarray]] = []
    size = 0

    def joined(part):
        g, label, a, b = (np.concatenate(c) for c in zip(*part, strict=True))
        return g, label, np.stack([a, b], axis=1).view(U64)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if size >= least and (last or held[-1][0][-1] != cols[0][0]):
            yield joined([*held, [c[:last] for c in cols]])
            held, size, cols = [], 0, [c[last:] for c in cols]
        held.append(cols)
        size += len(cols[0])
    if held:
        yield joined(held)


def star_edges(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, for each component of links, every node to the least."""
    node, at = np.unique(node, return_index=True)
    sets = [sets[i] for i in at]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    who = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    rest = np.ones(len(node), bool)
    src, dst = [], []
    for i in range(len(node)):
        if not rest[i]:
            continue
        rest[i] = False
        queue, seen = [i], [i]
        while queue and rest.any():
            x = queue.pop()
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            both = np.bincount(who[ranges(lo, hi - lo)], minlength=len(node))
            found = np.flatnonzero(rest & (both / (size + size[x] - both) >= similarity))
            rest[found] = False
            seen.extend(found.tolist())
            queue.extend(found.tolist())
        if len(seen) > 1:  # nodes are in ascending order, so the first is the least
            src.extend([node[i]] * (len(seen) - 1))
            dst.extend(node[seen[1:]])
    return np.array(src, np.int64), np.array(dst, np.int64)


def links(docs: DataFrame, sig: DataFrame, scratch: Scratch, width: int, similarity: float, slice_bytes: int, slice_rows: int, blocks: int, text: str) -> DataFrame:
    """(u, v): edges whose components are those of all links among the sets."""
    one = sig.groupBy("fp", "node").agg(F.min("text_hash").alias("text_hash"))
    one = one.join(clusters(sig, scratch, slice_rows, blocks), "node").select("fp", "cluster", "text_hash")
    several = one.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    one = scratch.put(one.join(several, "cluster", "left_semi"), "near-copies-candidates")
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    texts = sized_join(texts, one, "text_hash", "inner").select("fp", "cluster", "text")

    def sets(batches):
        for batch, buf, offs in chunks(batches):
            h, bounds = shingle_sets(buf, offs, width)
            data = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["fp", "cluster", "shingles"])

    found = scratch.put(texts.mapInArrow(sets, "fp long, cluster long, shingles binary").dropDuplicates(["fp"]), "near-copies-sets")
    total = found.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("shingles")) / slice_bytes).cast("int").alias("n"))
    cut = found.join(total, "cluster").withColumn("s", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    # row of slice s goes to the tasks (min(s, o), max(s, o)) of all slices o
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select("cluster", F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"), "fp", "shingles")
    cut = cut.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")

    def search(batches):
        for node, held in _groups(batches):
            u, v = star_edges(np.array(node, np.int64), [np.frombuffer(s, U64) for s in held], similarity)
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return cut.mapInArrow(search, "u long, v long")


def _groups(batches):
    """(nodes, sets) of consecutive rows with equal (cluster, p, q)."""
    key, node, held = None, [], []
    for batch in batches:
        for *k, fp, shingles in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if k != key:
                if held:
                    yield node, held
                key, node, held = k, [], []
            node.append(fp)
            held.append(shingles)
    if held:
        yield node, held


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, bucket: int = 16, miss: float = 1e-3, slice_bytes: int = 1 << 24, slice_rows: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component of links, by
    the rule of ``simhash.keep_one``."""
    scratch = Scratch(docs.sparkSession)
    bits, blocks = shape(docs.count(), similarity, bucket, miss)
    sig = scratch.put(signatures(docs, width, bits, blocks, doc_id, text), "near-copies")
    comp = components(links(docs, sig, scratch, width, similarity, slice_bytes, slice_rows, blocks, text))
    kept = keep_found(docs, members(sig.select(doc_id, "fp", "text_hash"), comp, doc_id), doc_id, text)
    scratch.drop()
    return kept
