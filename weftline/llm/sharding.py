"""Sharding by minimax contiguous partition.

Equal texts form one atomic group; groups stand in the order of their text's
64-bit hash.  The smallest feasible capacity of a shard is found by binary
search with the greedy check (fill each shard up to the capacity, never split a
group), and the order is cut there, so the largest shard is as small as any
contiguous partition allows.

At scale: group sizes are summed per text hash with partial aggregation, then
once more into ``2**FINE_BITS`` ranges of the order.  Only that fixed-size
histogram and the groups of the few ranges in which a cut can fall reach the
driver: cutting at range borders alone gives a feasible capacity, total/shards
and the largest group give a lower one, and between those two each cut can only
move within a few ranges.  Rows then find their shard by comparing their hash
with at most ``shards - 1`` thresholds, without a shuffle.

Nulls: a null text counts as the empty text (size 1, crc32 0); a null id is an
ordinary value.  Empty table: empty result.  Repeated rows each get a slot of
their own.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import ranked

FINE_BITS = 16


def _greedy(sizes: list[int], starts: list[int], shards: int, capacity: int) -> list[int] | None:
    """Indexes at which shards 1.. begin, or None if ``capacity`` is too small.
    ``starts``: prefix sums of ``sizes`` with a leading 0."""
    cuts, at, n = [], 0, len(sizes)
    for _ in range(shards):
        to = bisect_right(starts, starts[at] + capacity) - 1
        if to >= n:
            return cuts
        if to == at:
            return None
        cuts.append(to)
        at = to
    return None


def minimax_cuts(sizes: list[int], shards: int, low: int = 0) -> tuple[int, list[int]]:
    """Smallest capacity with which ``sizes`` fit contiguously in ``shards``
    shards, and where shards 1.. begin."""
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    lo = max([low, -(-starts[-1] // shards), *sizes])
    hi = max(lo, starts[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(sizes, starts, shards, mid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, _greedy(sizes, starts, shards, lo) or []


def _windows(hist: list[tuple[int, int]], shards: int, lo: int, hi: int) -> set[int]:
    """Ranges (positions in ``hist``) in which a greedy cut can fall for some
    capacity in [lo, hi]: the walk that is never ahead of, and the one that is
    never behind, any exact walk bound each cut."""
    starts = [0]
    for _, s in hist:
        starts.append(starts[-1] + s)
    n, behind, ahead, found = len(hist), 0, 0, set()
    for _ in range(shards):
        # exact cuts lie at or after starts[behind] and at or before starts[ahead]
        behind = max(bisect_right(starts, starts[behind] + lo) - 1, behind)
        ahead = min(bisect_right(starts, starts[ahead] + hi), n)
        found.update(range(behind, min(ahead + 1, n)))
        if behind >= n:
            break
    return found


def thresholds(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the hashes at which shards 1.. begin.  ``groups``: one row
    (h, size) per atomic group; it is read twice, so hand in a stored table."""
    fine = F.shiftright("h", 64 - FINE_BITS)
    hist = sorted((r[0], r[1], r[2]) for r in groups.groupBy(fine.alias("b")).agg(F.sum("size"), F.max("size")).collect())
    if not hist:
        return 0, []
    total, most = sum(x[1] for x in hist), max(x[2] for x in hist)
    low = max(-(-total // shards), most)
    flat = [(b, s) for b, s, _ in hist]
    high, _ = minimax_cuts([s for _, s in flat], shards, low)
    near = _windows(flat, shards, low, high)
    wanted = [flat[i][0] for i in near]
    detail: dict[int, list[tuple[int, int]]] = {}
    for b, h, s in groups.select(fine.alias("b"), "h", "size").filter(F.col("b").isin(wanted)).collect():
        detail.setdefault(b, []).append((h, s))
    items: list[tuple[int, int]] = []
    for b, s in flat:  # ranges without detail stay whole: no cut falls inside them
        items += sorted(detail[b]) if b in detail else [(b << (64 - FINE_BITS), s)]
    capacity, cuts = minimax_cuts([s for _, s in items], shards, low)
    return capacity, [items[c][0] for c in cuts]


def shard_documents(docs: DataFrame, groups: DataFrame, shards: int = 8, sub_shards: int = 64) -> DataFrame:
    """(id, h, size, text_crc32, shard, slot) of each row of ``docs``, which has
    doc_id, h, size and text_crc32; ``slot`` counts from 0 in each shard.

    Slots are dealt per (shard, 10 hash bits, ``sub_shards`` classes of the
    id), so the copies of one text are ranked in many tasks.
    """
    _, cuts = thresholds(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("h") >= F.lit(c)).cast("int")
    placed = docs.withColumn("shard", shard.cast("int"))
    placed = placed.withColumn("__b", F.shiftright("h", 54).cast("int")).withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(sub_shards)).cast("int"))
    out = ranked(placed, ["shard"], ["__b", "__s"], [F.col("h"), F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.drop("__b", "__s")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), size (UTF-8 bytes and 1), text_crc32."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(t).alias("h"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
