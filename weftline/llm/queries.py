"""The operators as registered queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, line_crf, mixing, packing, quality_rules, sharding, simhash, site_style, suffix_dedup, toxicity
from ._spark import held, materialise, table

#: Target shares of op6, per mille of nothing in particular: integer shares.
MIX_WEIGHTS = {f"src{i}": 8 - 2 * (i // 5) for i in range(20)}
MIX_OTHER, MIX_BLOCK = 1, 4
PACK_MAX, PACK_BUCKETS, PACK_BUDGET = 2048, 8, 16_384


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seqs = packing.sequences(docs.select("doc_id", "text"), packing.word_count(), PACK_MAX).drop("text")
    seqs = materialise(seqs.withColumn("h", mixing.id_hash()).withColumn("s", F.substring("h", 1, 3)), "op2")
    order = [F.col("h"), F.col("doc_id"), F.col("n_tokens"), F.col("piece")]
    out = packing.pack(seqs, ["s"], order, PACK_BUCKETS, PACK_BUDGET)
    return out.select("doc_id", F.col("piece").cast("long"), "n_tokens", F.col("bucket").cast("long"), "bucket_len", "batch", "slot", "n_pad")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"), "quality", ~held("doc_id", 5, 0))
    out = line_crf.score(docs, model)
    return out.select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held("doc_id", 3, 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK)
    return out.select("doc_id", "source", "mix_source", "share", "block", "release", "deadline", "slot", "slot_row")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op8_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(sharding.measured(table(spark, sf_dir, "documents")), "op10")
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    out = sharding.shard_documents(rows, groups)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_line_crf": op3_line_crf,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_site_style": op8_site_style,
    "op9_ann": op9_ann,
    "op10_sharding": op10_sharding,
}
