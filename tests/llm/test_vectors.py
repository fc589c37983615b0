"""Inverted lists, routed queries and the adaptive scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, queries


def brute(ids, x, q_id, k=5):
    q = x[ids == q_id][0]
    s = ann.cosines(x, np.tile(q, (len(x), 1)))
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q_id]
    return [(int(ids[i]), float(s[i])) for i in order[:k]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.op9_ann(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    asked = [int(i) for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        want = brute(ids, x, q)
        hit += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s - dict(brute(ids, x, q, len(ids)))[i]) < 1e-12 for i, s in got[q])
    assert hit / (5 * len(asked)) >= 0.9


def test_a_block_is_exact_within_its_lists():
    """Without early abandonment a block returns the true best of the probed lists,
    whatever bound is carried in, as long as it is right."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 20)), rng.normal(size=(7, 20))
    ids, q_ids = rng.permutation(400), np.arange(1000, 1007)
    own, probed = rng.integers(0, 6, 400), rng.random((7, 6)) < 0.6
    turn = ann.rotation(20)
    for carried in (False, True):
        for j in range(7):
            some = np.flatnonzero(probed[j][own])
            s = ann.cosines(x[some], np.tile(q[j], (len(some), 1)))
            order = np.lexsort((ids[some], -s))[:5]
            bound = np.full(7, 2 - 2 * s[order[-1]] + 1e-9 if carried else np.inf)
            got = ann.search_block(ids, x, own, q_ids[j : j + 1], q[j : j + 1], probed[j : j + 1], bound[:1], turn, 5, eps=50.0, width=8, step=64)
            assert got[1].tolist() == ids[some][order].tolist() and np.allclose(got[2], s[order])


def test_lists_and_probes():
    rng = np.random.default_rng(9)
    x = ann.unit(rng.normal(size=(500, 12)))
    lists = ann.Lists(x, 4)
    own = lists.of(x)
    assert len(lists) == 16 and own.min() >= 0 and own.max() < 16
    far = lists.far(x)
    c = (lists.first[:, None] + lists.rest[None]).reshape(16, -1)
    assert np.allclose(far + 1, ((x[:, None] - c[None]) ** 2).sum(-1))
    assert (lists.probed(x, 5).sum(axis=1) == 5).all() and lists.probed(x, 99).all()


def test_lists_grow_with_the_root_and_hot_ones_are_cut(spark):
    """A third of the rows are one vector; blocks are tiny; names clash."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 10)), np.tile(rng.normal(size=10), (300, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit("own").alias(c) for c in ("list", "v", "q", "centre", "bound", "query_id", "score", "rank", "a", "b")])
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0, block_rows=40, block_queries=3, calibrate=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.arange(len(x))
    hit = sum(len({i for i, _ in brute(ids, x, q)} & set(v)) for q, v in got.items())
    assert hit / (5 * len(got)) >= 0.9 and len(got) == 18
    assert got[600] == [601, 602, 603, 604, 605] and got[650] == [600, 601, 602, 603, 604]
