"""Packing sequences into padded batches with optimal length buckets.

A dynamic program over the global histogram of sequence lengths chooses at most
``buckets`` boundaries that minimise the total padding (every sequence is padded
to the longest length of its bucket); inside each bucket, batches of at most
``token_budget`` padded tokens are filled in order.

Texts longer than ``max_tokens`` tokens give several sequences, so nothing is
lost and the histogram has at most ``max_tokens`` entries, whatever the input:
that is all the driver sees.  Batches are numbered through per bucket from
shard-wise ranks (see ``ranked``), so the fullest bucket is spread over many
tasks.

Nulls: a null or blank text has no tokens and gives one sequence of length 0,
which joins the first bucket.  Empty table: empty result.  Repeated rows are
sequences of their own.  Ties of the program go to the smaller boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ranked

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Tokens of a text: its words ``[^\\x20\\x09-\\x0D]+``, counted as the
    places where a word begins."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit(WORD)).cast("long")


def optimal_buckets(hist: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of the buckets that minimise the padding.

    ``hist``: (length, count) with distinct lengths.  With ``cost(i, j)`` =
    padding of lengths i+1..j to length j, ``best(k, j) = min_i best(k-1, i) +
    cost(i, j)``, ties to the smaller i; fewer buckets are used if as good.
    """
    hist = sorted(hist)
    if not hist:
        return []
    x = np.array([h for h, _ in hist], np.int64)
    n = np.concatenate([[0], np.cumsum([c for _, c in hist])]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum([h * c for h, c in hist])]).astype(np.int64)
    m = len(x)
    best = np.concatenate([[0], x * n[1:] - s[1:]])
    back = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        new, arg = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        back.append(arg)
        best = new
    bounds, j, k = [], m, len(back) - 1
    while j > 0:
        while k > 0 and back[k][j] < 0:
            k -= 1
        bounds.append(int(x[j - 1]))
        j = int(back[k][j]) if k else 0
        k -= 1
    return bounds[::-1]


def sequences(docs: DataFrame, tokens: Column, max_tokens: int) -> DataFrame:
    """One row per sequence: the columns of ``docs``, piece (from 0) and n_tokens."""
    return (
        docs.withColumn("__n", tokens)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest((F.ceil(F.col("__n") / max_tokens) - 1).cast("int"), F.lit(0)))))
        .withColumn("n_tokens", F.least(F.col("__n") - F.col("piece").cast("long") * max_tokens, F.lit(max_tokens).cast("long")))
        .drop("__n")
    )


def pack(seqs: DataFrame, shard: list[str], order: list[Column], buckets: int = 8, token_budget: int = 16_384) -> DataFrame:
    """Add bucket (from 0), bucket_len, batch, slot and n_pad to ``seqs``.

    ``seqs`` has n_tokens and is read twice; rows fill the batches of their
    bucket in the order of (``shard``, ``order``), which must be total up to
    rows that may be exchanged.
    """
    hist = [(r[0], r[1]) for r in seqs.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()]
    bounds = optimal_buckets(hist, buckets) or [0]
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    out = seqs.withColumn("bucket", bucket.cast("int"))
    out = out.withColumn("bucket_len", F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1).cast("long"))
    out = ranked(out, ["bucket"], shard, order, "__i")
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        out.withColumn("batch", F.floor(F.col("__i") / rows).cast("long"))
        .withColumn("slot", (F.col("__i") % rows).cast("long"))
        .withColumn("n_pad", F.col("bucket_len") - F.col("n_tokens"))
        .drop("__i")
    )
