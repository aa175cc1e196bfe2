"""Operator 5: token counts through a digest cache.

Texts are named by the SHA-256 of their normalised content, tokenizers by that
of their file. A cache table maps (tokenizer digest, content digest) to a
count. The documents' digests are joined to it, only distinct texts that it
lacks are encoded, and their counts are appended. Copies are merged before the
shuffle, so a text that a third of all rows hold is sent once by each task.

Normalising keeps counts: runs of blanks and line feeds fold for tokenizers
that drop white space, and nothing is changed for others.

Null texts count as empty; a null doc_id stays null; repeated rows are
answered row by row. Other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import documents, shared_folder, text_rows
from .text import chunks, flat
from .tokens import drops_space, encoder, load

LIMIT = 2048
COUNTED = "digest binary, n_tokens long"


def _counted(version: str, content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(version, content)
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                counts = own.counts([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts)], names=["digest", "n_tokens"])
    return run


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version in a cache folder, if there are any."""
    try:
        return spark.read.schema(COUNTED).parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``;
    counts missing from the folder ``cache`` are added to it."""
    import json

    spark = docs.sparkSession
    version, content = load(spark, tokenizer)
    docs = text_rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = F.trim(F.regexp_replace("text", "[ \n]+", " ")) if drops_space(json.loads(content.value)) else F.col("text")
    named = docs.select("doc_id", "text", F.unhex(F.sha2(same, 256)).alias("digest"))
    known = cached(spark, cache, version)
    misses = named.select("digest", "text").dropDuplicates(["digest"])
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    misses.mapInArrow(_counted(version, content), COUNTED).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    # two jobs that append at once may both have counted a text
    counts = cached(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return (named.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def word_bpe() -> str:
    """Place of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, empty at first, so that each run counts all texts."""
    return count_tokens(documents(spark, sf_dir), word_bpe(), f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}")


QUERIES = {"op5_digest_token_counts": op5_digest_token_counts}
