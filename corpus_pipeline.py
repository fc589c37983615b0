"""A corpus from raw documents to packed batches, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.  Each works on all that the one
before has kept.

1. quality: the line CRF, fitted on the labelled documents; those it rejects go.
2. near-dedup: one document of each component of near copies stays; near copies
   have five-word shingle sets of similarity 0.8 or more.
3. suffix-dedup: repeated strings of 200 bytes or more leave the texts.
4. mixing: the documents are put in the order of the Pfair mixture; the order is
   that of the written files.
5. packing: sequences fill length buckets' batches in the order of the files.

Nulls: a null text is an empty text; a null id passes through every stage.
Empty table: empty result.  Repeated rows: stage 2 keeps one.  Extra columns
are carried up to stage 4.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_crf, mixing, near_copies, packing, suffix_dedup
from weftline.llm._spark import held, materialise, table
from weftline.llm.queries import MIX_BLOCK, MIX_OTHER, MIX_WEIGHTS, PACK_BUCKETS, PACK_BUDGET, PACK_MAX

#: Score below which the classifier rejects a document.
QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = line_crf.train(docs, table(spark, sf_dir, "labels"), "quality", ~held("doc_id", 5, 0))
    return line_crf.keep_good(docs, model, QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at)
    except AnalysisException:  # rows that are in no file yet have no place: write them
        docs = materialise(docs, "pipeline-unplaced")
        at = docs.metadataColumn("_metadata")
    place = [at.getField("file_path").alias("s"), at.getField("row_index").alias("row")]
    seqs = packing.sequences(docs.select("doc_id", "text", *place), packing.word_count(), PACK_MAX).drop("text")
    seqs = materialise(seqs, "pipeline-pack")
    out = packing.pack(seqs, ["s"], [F.col("row"), F.col("piece")], PACK_BUCKETS, PACK_BUDGET)
    return out.select("doc_id", F.col("piece").cast("long"), "n_tokens", F.col("bucket").cast("long"), "bucket_len", "batch", "slot", "n_pad")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
