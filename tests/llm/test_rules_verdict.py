"""The verdict of the quality rules by an independent computation."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def word_hash(w):
    h, p = 0, 1
    for b in w:
        h, p = h + (b + 1) * p, p * BASE & M
    return mix(h + len(w) & M)


def grams(text, n):
    h = [word_hash(w) for w in WORD.findall((text or "").encode())]
    return Counter([x % n for x in h] + [mix(a * BASE + b & M) % n for a, b in zip(h, h[1:], strict=False)])


def verdicts(rows, good, n=1 << 16, share=quality_rules.SHARE, q=quality_rules.QUANTILE):
    """(llr, passes) for every (id, text), by dictionaries."""
    docs = [(i, grams(t, n), fails(t)) for i, t in rows]
    raw, parts = Counter(), [Counter(), Counter()]
    side = lambda i: zlib.crc32(str(i).encode()) % 2
    for i, g, _ in docs:
        raw.update(g)
        if i in good:
            parts[side(i)].update(g)
    sizes = [p.total() for p in parts]
    if not min(sizes):
        return [0.0] * len(docs)
    total = raw.total() + n

    def ratio(k, b):
        p = (raw[b] + 1) / total
        return math.log((parts[k][b] + share * sizes[k] * p) / (sizes[k] * (1 + share)) / p)

    def of(k, g):
        return sum(c * ratio(k, b) for b, c in g.items()) / max(g.total(), 1)

    unseen = sorted(math.floor(of(1 - side(i), g) * 1000) / 1000 for i, g, bad in docs if i in good and not bad)
    at = lambda x: unseen[int(x * (len(unseen) - 1))]
    level = at(q) - (at(0.5) - at(q)) / math.sqrt(len(unseen))
    return [(of(0, g) + of(1, g)) / 2 - level for _, g, _ in docs]


def fails(text):
    w = WORD.findall((text or "").encode())
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_every_verdict_of_the_query(spark, sf, documents, labels):
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {i: (v, not fails(t) and v >= 0) for (i, t), v in zip(rows, verdicts(rows, good), strict=True)}
    got = queries.op1_quality_rules(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.llr == pytest.approx(want[r.doc_id][0], abs=1e-9)
        assert r.kept == want[r.doc_id][1] or abs(r.llr) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_small_trusted_sets_reject_too(spark, sf):
    out = queries.op1_quality_rules(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = (out.where(f"quality = {k}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for k in (1, 0))
    assert good == 1 and bad < 0.1


def test_few_or_no_trusted_documents(spark, awkward):
    for ids in ([], [4], [None]):
        trusted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        out = quality_rules.quality_rules(awkward, trusted)
        assert out.count() == awkward.count() and out.where("kept = base_failed").count() == 0
    assert quality_rules.quality_rules(awkward.limit(0), trusted).count() == 0
