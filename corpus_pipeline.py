"""Corpus pipeline: documents to token ids, one corpus operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``; the
last returns a row for each encoded document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordinal_spark.llm.attention_mil import THRESHOLD, quality_labels, quality_score
from ordinal_spark.llm.decontaminate import decontaminate
from ordinal_spark.llm.frames import bound_batches, documents, written
from ordinal_spark.llm.jaccard_join import one_of_each
from ordinal_spark.llm.mixing import mix_sources
from ordinal_spark.llm.simple8b import encode_documents
from ordinal_spark.llm.token_counts import word_bpe

# The workers of a pipeline come to its last stage with what four others left
# in them and in the executor, so they keep fewer words than operator 10 alone,
# and none after a task; Arrow batches are smaller on both sides.
TOGETHER, WORDS, BATCH = 1 << 20, 60_000, 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score below its threshold go. The first
    stage sets the size of Arrow batches for all."""
    bound_batches(spark, BATCH)
    return docs.filter(quality_score(docs, quality_labels(spark, sf_dir)) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each component stays."""
    return one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document once, and more blocks of smaller sources."""
    return mix_sources(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids written and read back."""
    return encode_documents(docs, word_bpe(), TOGETHER, WORDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("token_ids", token_ids)]

# A trained classifier and a tokenizer are not SQL; tests hold each stage
# against a direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
