"""Packing, mixing and sharding."""

import random
import re
from fractions import Fraction
from itertools import combinations

import pytest
from compare import database, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import mixing, oracles, packing, queries, sharding


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), database(sf), oracles.ORACLES[name])


def padding(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_buckets_are_optimal(hist, k):
    items = sorted(hist.items())
    lengths = [n for n, _ in items]
    got = packing.optimal_buckets(items, k)
    assert got[-1] == lengths[-1] and len(got) <= k and got == sorted(set(got))
    best = min(padding(items, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
    assert padding(items, got) == best


def test_packing_loses_nothing(spark, awkward):
    seqs = packing.sequences(awkward.select("doc_id", "text"), packing.word_count(), 500).drop("text")
    out = packing.pack(seqs.withColumn("s", F.lit(0)), ["s"], [F.col("doc_id"), F.col("n_tokens"), F.col("piece")], 4, 2000).collect()
    words = {}
    for r in awkward.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = {}
    for r in out:
        assert 0 <= r.n_tokens <= r.bucket_len and r.n_pad == r.bucket_len - r.n_tokens
        assert (r.slot + 1) * r.bucket_len <= max(2000, r.bucket_len)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == words
    assert len({(r.bucket, r.batch, r.slot) for r in out}) == len(out)


def test_packing_of_nothing(spark, awkward):
    seqs = packing.sequences(awkward.select("doc_id", "text").limit(0), packing.word_count(), 500).drop("text")
    assert packing.pack(seqs.withColumn("s", F.lit(0)), ["s"], [F.col("doc_id")]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pfair_deviation_is_below_one_block(spark, seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 7) for i in range(5)}
    rows = [(i, rng.choice([*weights, "s0", "s0", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, weights, 2, 3).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        slots.setdefault(r.slot, set()).add((r.mix_source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[t]))[0] for t in range(len(slots))]
    # fluid shares while every source still has whole periods
    share = {**weights, "*": 2}
    blocks = {s: order.count(s) for s in set(order)}
    full = min(blocks[s] // share[s] for s in blocks) * sum(share[s] for s in blocks)
    done = dict.fromkeys(blocks, 0)
    total = sum(share[s] for s in blocks)
    for t, s in enumerate(order[:full], 1):
        done[s] += 1
        assert all(abs(done[k] - Fraction(t * share[k], total)) < 1 for k in blocks)


def test_mixing_awkward(spark, awkward):
    w = {"src0": 3, "src1": 2}
    out = mixing.mix(awkward, w, 1, 2)
    assert out.count() == awkward.count() and out.where("slot is null or mix_source is null").count() == 0
    kept = mixing.mixed_order(awkward, w, 1, 2)
    assert kept.schema.names == awkward.schema.names
    assert kept.exceptAll(awkward).count() == 0 and awkward.exceptAll(kept).count() == 0
    assert mixing.mix(awkward.limit(0), w).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(awkward, {"a": 0})


def brute_minimax(sizes, k):
    best = None
    for r in range(min(k, len(sizes))):
        for c in combinations(range(1, len(sizes)), r):
            edge = [0, *c, len(sizes)]
            m = max(sum(sizes[a:b]) for a, b in zip(edge, edge[1:], strict=False))
            best = m if best is None else min(best, m)
    return best or 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=9), st.integers(1, 4))
def test_minimax_is_minimal(sizes, k):
    cap, cuts = sharding.minimax_cuts(sizes, k)
    edge = [0, *cuts, len(sizes)]
    assert cap == brute_minimax(sizes, k) and len(cuts) < k
    assert max((sum(sizes[a:b]) for a, b in zip(edge, edge[1:], strict=False)), default=0) <= cap


def test_thresholds_equal_the_whole_partition(spark):
    rng = random.Random(3)
    groups = sorted((rng.randrange(-(2**63), 2**63) if i % 3 else -(2**63) + i, rng.randint(1, 900)) for i in range(3000))
    cap, cuts = sharding.thresholds(spark.createDataFrame(groups, "h long, size long"), 8)
    want, at = sharding.minimax_cuts([s for _, s in groups], 8)
    assert cap == want and cuts == [groups[i][0] for i in at]


def test_sharding_awkward(spark, awkward, documents):
    for df in (awkward, documents, awkward.limit(0)):
        m = sharding.measured(df)
        out = sharding.shard_documents(m, m.groupBy("h").agg(F.sum("size").alias("size"))).collect()
        assert len(out) == df.count()
        for s in range(8):
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
        where = {}
        for r in out:
            where.setdefault(r.h, set()).add(r.shard)
        assert all(len(v) == 1 for v in where.values())
