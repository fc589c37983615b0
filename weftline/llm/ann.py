"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are normalised (so that the nearest are those of largest cosine),
rotated by a random orthogonal matrix and put into inverted lists.  A query scans
its ``probes`` nearest lists column block by column block: after d of D rotated
dimensions the partial distance, scaled by D/d, estimates the whole one, and a
candidate is abandoned once the hypothesis that it still beats the k-th best so
far is rejected, that is if the estimate exceeds (1 + eps/sqrt(d))^2 times that
distance.  Survivors are compared by the cosine of the original vectors in double
precision.

Lists.  With m the fourth root of the rows, m centres are fitted to the vectors
and m more to what the nearest centre leaves of them; a list is a pair of both,
so there are about as many lists as the root of the rows, at every size, while
the fitted tables grow with the fourth root.  Rotation and centres are fitted in
numpy on at most ``sample_rows`` vectors (least hash of the id first); every row
is indexed.  The number of lists to probe is the least that finds ``recall`` of
the true neighbours of at most ``calibrate`` of the sample's vectors among all
rows (one pass that keeps k rows a task and vector).

Routing.  A query goes to the first centres that hold any of its lists, with a
bit for each list, not to the lists.  The first pass takes only its nearest
centre; its k-th best there bounds the second pass from the start.  Rows and
queries of one centre are cut into blocks of about ``block_rows`` and
``block_queries`` by a hash of the id, so a list that holds a third of all
vectors is many groups.

Nulls: vectors that are null, zero or have null or non-finite components, and
rows without an id, take no part; nor do vectors whose dimension is not the
table's most common one (ties: the smaller).  Repeated rows: an id is returned
once per query, with its best score; rows that share the query's id are the
query's own; of several vectors of one query id the least is searched.  Ties go
to the smaller id.  Fewer candidates than ``k``: all found are returned.  Empty
table: empty result.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, materialise


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    v = raw.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double-precision cosine of rows ``a`` with rows ``b``; equal rows give
    equal values wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)

    def plain(m):  # only lengths that would overflow or vanish are scaled
        s = np.abs(m).max(axis=1, keepdims=True)
        return np.where((s > 1e100) | (s < 1e-100), m / s, m)

    a, b = plain(a), plain(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def centres(x: np.ndarray, n: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centres of unit rows; empty ones move to random rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


class Lists:
    """Inverted lists named by a centre and a centre of what it leaves."""

    def __init__(self, x: np.ndarray, m: int):
        self.first = centres(x, m)
        self.rest = centres(x - self.first[nearest(x, self.first, 1)[:, 0]], m)
        self.n_rest = len(self.rest)
        self.norm = ((self.first[:, None] + self.rest[None]) ** 2).sum(-1)

    def __len__(self) -> int:
        return len(self.first) * self.n_rest

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of every vector."""
        a = nearest(x, self.first, 1)[:, 0]
        return a * self.n_rest + nearest(x - self.first[a], self.rest, 1)[:, 0]

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared distance, less a constant, of every vector to every list."""
        d = -2 * ((q @ self.first.T)[:, :, None] + (q @ self.rest.T)[:, None, :]) + self.norm[None]
        return d.reshape(len(q), -1)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """(vector, list): is the list among the ``probes`` nearest?"""
        d = self.far(q)
        out = np.ones(d.shape, bool)
        if probes < d.shape[1]:
            out[:] = False
            np.put_along_axis(out, np.argpartition(d, probes - 1, axis=1)[:, :probes], True, axis=1)
        return out


def best_rows(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row, cosine) of the ``k`` nearest rows of every query."""
    sim = q @ x.T
    sim[q_ids[:, None] == ids[None]] = -np.inf
    n = min(k, len(ids))
    at = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(q), 1))
    value = np.take_along_axis(sim, at, 1).ravel()
    who, row = np.repeat(np.arange(len(q)), n), at.ravel()
    ok = value > -np.inf
    return who[ok], row[ok], value[ok]


def probes_for(index: DataFrame, lists: Lists, q_ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists with which the given queries find ``recall`` of their true
    ``k`` nearest among all rows of ``index`` (list, vec_id, v)."""
    shared = index.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        ids, queries = shared.value
        top = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            who, row, value = best_rows(batch.column(1).to_numpy(zero_copy_only=False), unit(_matrix(batch.column(2))), ids, queries, k)
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            top = [np.concatenate(c) for c in zip(top, (who, own[row], value), strict=True)]
            order = np.lexsort((-top[2], top[0]))
            place = np.arange(len(order)) - np.searchsorted(top[0][order], top[0][order])
            top = [c[order[place < k]] for c in top]
        yield pa.RecordBatch.from_pydict({"query": top[0], "list": top[1], "score": top[2]})

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    rows = index.mapInArrow(run, "query long, list long, score double").withColumn("place", place).where(F.col("place") <= k).select("query", "list").collect()
    if not rows:
        return len(lists)
    who, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = lists.far(q)
    need = (d[who] < d[who, own][:, None]).sum(axis=1) + 1
    return int(np.quantile(need, recall, method="higher"))


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest centres of every row, nearest first."""
    d = (c * c).sum(1)[None] - 2 * (x @ c.T)
    k = min(k, len(c))
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    order = np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


def scan(columns: list[np.ndarray], queries: list[np.ndarray], bound: np.ndarray, own: np.ndarray, eps: float, dense: float = 0.125):
    """Adaptive scan of candidates by all queries of a block.

    ``columns``, ``queries``: column blocks of the rotated vectors, each (rows,
    width); ``bound``: k-th best squared distance so far of each query; ``own``:
    (candidates, queries), true where they are one row.  Returns (candidate,
    query, squared distance) of the pairs that no test has abandoned.  While
    more than ``dense`` of the pairs stand, a column block is one matrix
    product; after that the pairs are followed one by one.
    """
    dim, lo = sum(c.shape[1] for c in columns), 0
    total = np.where(own, np.inf, 0.0)
    rows = np.arange(len(own))
    for at, (c, q) in enumerate(zip(columns, queries, strict=True)):
        c = c[rows]
        total += (c * c).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (c @ q.T)
        lo += c.shape[1]
        limit = bound * (1 + eps / np.sqrt(lo)) ** 2 * (lo / dim) if lo < dim else bound * (1 + 1e-9) + 1e-9
        total[total > limit] = np.inf
        alive = total < np.inf
        some = alive.any(axis=1)
        rows, total, alive = rows[some], total[some], alive[some]
        if alive.sum() < dense * max(own.size, 1):
            break
    i, j = np.nonzero(alive)
    d, r = total[i, j], rows[i]
    for c, q in zip(columns[at + 1 :], queries[at + 1 :], strict=True):
        diff = c[r] - q[j]
        d = d + (diff * diff).sum(1)
        lo += c.shape[1]
        limit = bound[j] * (1 + eps / np.sqrt(lo)) ** 2 * (lo / dim) if lo < dim else bound[j] * (1 + 1e-9) + 1e-9
        stay = d <= limit
        r, j, d = r[stay], j[stay], d[stay]
    return r, j, d


def fewer_copies(ids: np.ndarray, raw: np.ndarray, keep: int) -> np.ndarray:
    """Rows without all but the ``keep`` least ids of each vector; of equal rows
    with one id one stays."""
    key = (raw * np.random.default_rng(1).normal(size=raw.shape[1])).sum(axis=1)
    order = np.lexsort((ids, key))
    same = np.zeros(len(ids), bool)
    same[1:] = (raw[order[1:]] == raw[order[:-1]]).all(axis=1)
    twin = np.zeros(len(ids), bool)
    twin[1:] = same[1:] & (ids[order[1:]] == ids[order[:-1]])
    order, same = order[~twin], same[~twin]
    start = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
    return order[np.arange(len(same)) - start < keep]


def search_block(ids: np.ndarray, raw: np.ndarray, own_list: np.ndarray, q_ids: np.ndarray, q_raw: np.ndarray, probed: np.ndarray, bound: np.ndarray, turn: np.ndarray, k: int, eps: float = 2.1, width: int = 16, step: int = 1024):
    """Best ``k`` of one block for every query: (query ids, ids, scores).

    ``own_list``: each row's list; ``probed``: (query, list), whether the query
    scans that list; ``bound``: squared distance that is not to be exceeded.  Ids
    that stand for several vectors in the block are scored by each; the best stays.
    """
    stay = fewer_copies(ids, raw, k + 1)
    stay = stay[np.argsort(own_list[stay], kind="stable")]
    ids, raw, own_list = ids[stay], raw[stay], own_list[stay]
    x, q = unit(raw) @ turn, unit(q_raw) @ turn
    cut = lambda m: [np.ascontiguousarray(m[:, a : a + width]) for a in range(0, m.shape[1], width)]
    cols, qs = cut(x), cut(q)
    # ids that stand for several vectors need more than k places
    places = k + len(ids) - len(np.unique(ids))
    best = np.full((len(q_ids), places), np.inf)
    r, j, d = [], [], []
    edge = np.concatenate([[0], np.flatnonzero(own_list[1:] != own_list[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
    for start, end in zip(edge[:-1], edge[1:], strict=True):
        ask = np.flatnonzero(probed[:, own_list[start]])
        if len(ask) == 0:
            continue
        part = [c[ask] for c in qs]
        for a in range(start, end, step):
            b = min(end, a + step)
            limit = np.minimum(best[ask, -1], bound[ask])
            i, n, v = scan([c[a:b] for c in cols], part, limit, ids[a:b, None] == q_ids[ask][None], eps)
            r.append(i + a)
            j.append(ask[n])
            d.append(v)
            full = np.full((len(ask), b - a), np.inf)
            full[n, i] = v
            best[ask] = np.sort(np.partition(np.concatenate([best[ask], full], axis=1), places - 1, axis=1)[:, :places], axis=1)
    if not r:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    r, j, d = np.concatenate(r), np.concatenate(j), np.concatenate(d)
    near = d <= np.minimum(best[j, -1], bound[j]) + 1e-6
    r, j = r[near], j[near]
    score = np.empty(len(r))
    for a in range(0, len(r), 1 << 14):
        score[a : a + (1 << 14)] = cosines(raw[r[a : a + (1 << 14)]], q_raw[j[a : a + (1 << 14)]])
    order = np.lexsort((ids[r], -score, j))
    r, j, score = r[order], j[order], score[order]
    pair = np.stack([j, ids[r]])
    first = np.sort(np.unique(pair, axis=1, return_index=True)[1])
    r, j, score = r[first], j[first], score[first]
    place = np.arange(len(j)) - np.searchsorted(j, j)
    top = place < k
    return q_ids[j[top]], ids[r[top]], score[top]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as array<double>."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    dim = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (dim.d if dim else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = 16_384, calibrate: int = 256, recall: float = 0.96, block_rows: int = 16_384, block_queries: int = 2048, eps: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row
    that ``is_query`` (over ``vec_id``) selects, among all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    sample = [(r[0], r[1]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    x = unit(np.array([v for _, v in sample]))
    lists = Lists(x, int(min(max(1, round(rows.count() ** 0.25)), len(x))))
    n_rest = lists.n_rest
    shared = spark.sparkContext.broadcast((lists, rotation(x.shape[1])))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                own = shared.value[0].of(unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], ["list", "vec_id", "v"])

    scratch = Scratch(spark)
    index = scratch.put(rows.mapInArrow(assign, "list int, vec_id long, v array<double>"), "ann-index")
    probes = max(min(8, len(lists)), probes_for(index, lists, np.array([i for i, _ in sample[:calibrate]]), x[:calibrate], k, recall))

    def route(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = shared.value[0]
            q = unit(_matrix(batch.column(1)))
            bits = lists.probed(q, probes).reshape(len(q), -1, lists.n_rest)
            home = lists.far(q).argmin(axis=1) // lists.n_rest
            who, to = np.nonzero(bits.any(axis=2))
            flags = np.packbits(bits[who, to], axis=1)
            data = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.arange(0, flags.size + 1, flags.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flags))])
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), data, pa.array(home[who] == to)], ["centre", "query_id", "q", "bits", "home"])

    queries = index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.put(queries.mapInArrow(route, "centre int, query_id long, q array<double>, bits binary, home boolean"), "ann-queries")
    centre = F.floor(F.col("list") / n_rest).cast("int")
    size = dict(index.groupBy(centre.alias("centre")).count().collect())  # one row a centre
    n_cand = _blocks(size, block_rows, len(lists.first))

    def scanned(ask: DataFrame) -> DataFrame:
        n_ask = _blocks(dict(ask.groupBy("centre").count().collect()), block_queries, len(lists.first))
        cand = index.select(centre.alias("centre"), "list", "vec_id", "v").withColumn("a", F.pmod(F.xxhash64("vec_id", "v"), n_cand).cast("int"))
        cand = cand.withColumn("b", F.explode(F.sequence(F.lit(0), (n_ask - 1).cast("int"))))
        to = ask.withColumn("b", F.pmod(F.xxhash64("query_id"), n_ask).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), (n_cand - 1).cast("int"))))
        key = ["centre", "a", "b"]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                lists, turn = shared.value
                column = lambda t, c: pa.concat_arrays(t.column(c).chunks)
                plain = lambda t, c: column(t, c).to_numpy(zero_copy_only=False)
                bits = np.unpackbits(np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(right.num_rows, -1), axis=1)[:, : lists.n_rest].astype(bool)
                q, v, s = search_block(plain(left, "vec_id"), _matrix(column(left, "v")), plain(left, "list") % lists.n_rest, plain(right, "query_id"), _matrix(column(right, "q")), bits, plain(right, "bound"), turn, k, eps)
            return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

        left = cand.select(*key, "list", "vec_id", "v").groupBy(*key)
        return left.cogroup(to.select(*key, "query_id", "q", "bits", "bound").groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    near = scratch.put(best(scanned(asked.where("home").withColumn("bound", F.lit(float("inf"))))).select("query_id", "vec_id", "score"), "ann-first")
    # squared distance of unit vectors of that cosine
    bound = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + 1e-9).alias("bound"))
    rest = asked.where("not home").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    out = best(near.unionByName(scanned(rest))).select("query_id", "rank", "vec_id", "score")
    out = materialise(out, "ann-found")
    scratch.drop()
    return out


def _blocks(n: dict, per: int, groups: int) -> Column:
    """Blocks of each centre: one row a centre, so the map is bounded by them."""
    return F.element_at(F.create_map(*[F.lit(v) for g in range(groups) for v in (g, -(-max(n.get(g, 1), 1) // per))]), F.col("centre"))
