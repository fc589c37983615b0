"""The registered queries: their columns, their rows, and what they promise."""

import re
import zlib
from collections import Counter

import pytest

from weftline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_line_crf": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_site_style": {"page_id": "bigint", "text": "string", "n_chars": "bigint"},
    "op9_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    if "doc_id" in COLUMNS[name]:
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
        assert out.select("doc_id").exceptAll(docs).count() == 0 and out.count() == docs.count()


@pytest.mark.parametrize("name,label,remainder,threshold", [("op3_line_crf", "quality", (5, 0), 0.3), ("op5_toxicity", "toxic", (3, 1), 0.7)])
def test_held_out_rates_of_the_classifiers(spark, name, label, remainder, threshold):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    n, r = remainder
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % n == r]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % n == r) and 0 <= x.score <= 1 and x.predicted == int(x.score >= threshold) for x in rows)
    one, zero = ([x.predicted for x in held if x[label] == k] for k in (1, 0))
    if label == "toxic":
        assert sum(one) / len(one) > 0.5 and sum(zero) / len(zero) < 0.02
    else:
        assert sum(one) / len(one) > 0.97 and sum(zero) / len(zero) < 0.1


def test_shards(spark, sf):
    rows = queries.op10_sharding(spark, sf).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    load, slots, home = Counter(), {}, {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 8
        load[r.shard] += r.size
        slots.setdefault(r.shard, set()).add(r.slot)
        assert home.setdefault(raw, r.shard) == r.shard
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    group = Counter()
    for r in rows:
        group[text[r.doc_id]] += r.size
    assert max(load.values()) <= sum(load.values()) / 8 + max(group.values())
