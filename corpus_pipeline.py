"""A training corpus from raw documents: stages run in order, each over all that its predecessor kept.

Defined results: null and empty texts fail the quality rules. Rows of one doc_id with different texts are
different documents: rules, Jaccard join and decontamination judge each by its own text. Rows with the same
words under one doc_id are a group, of which one row stays. An empty table gives an empty result. All stages but the last keep
every column of documents, extra ones of any name included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard_join, packing, quality_rules, substring_dedup
from gleaner.llm.reach import reachable
from gleaner.session import checkpoint_dir


# All stages follow each other on the same executors, beside the memory that earlier ones still hold: small Arrow
# batches, row groups and chunks in every stage.
BUFFERS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "parquet.block.size": str(16 << 20)}
CHUNK_BYTES = 10 << 20


def small_buffers(spark: SparkSession) -> SparkSession:
    """Session settings that a stage's job reads when it runs, so they stay set in the pipeline's session."""
    for key, value in BUFFERS.items():
        spark.conf.set(key, value)
    return reachable(spark)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    small_buffers(spark)
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id; a null doc_id is in no group."""
    small_buffers(spark)
    return jaccard_join.one_of_each_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows."""
    small_buffers(spark)
    return substring_dedup.cut_repeats(docs, chunk_bytes=CHUNK_BYTES).withColumn("n_chars", F.char_length("text").cast("bigint"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no passage with a benchmark item."""
    return decontaminate.decontaminate(docs, small_buffers(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with their ids."""
    small_buffers(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

# Tokenizing has no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
