"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_dir

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
LOCAL_FALLBACK = "/tmp/ordinal-spark-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where
    that is unset and the session runs on one machine (tests)."""
    folder = checkpoint_dir(spark, LOCAL_FALLBACK if spark.sparkContext.master.startswith("local[") else None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to a new place in the shared folder and read it
    back: lineage ends there, and a lost executor costs nothing above it.
    ``file_rows``: the most rows of a file (0: any), for rows of many MB."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of a few MB: ten thousand long texts would be hundreds."""
    if int(spark.conf.get(BATCH_CONF).rstrip("b")) > size:
        spark.conf.set(BATCH_CONF, str(size))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that other columns can have any names."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: what tasks and buckets are sized by."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def buckets(spark: SparkSession, size: int, each: int = 8 << 20) -> int:
    """Buckets of about ``each`` bytes, and no fewer than shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): rows that repeat an id with another text get
    versions 0, 1, ... in the order of a text hash; repeated rows share one.
    A null id counts as the smallest long. Ids are normally unique, which one
    narrow aggregate finds out, and then no join is made."""
    low = F.lit(-(1 << 63)).cast("long")
    docs = docs.select(F.coalesce("doc_id", low).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    several = (docs.groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"))
               .filter("a != b").select("doc_id"))
    if several.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("version"), "text")
    ranks = (docs.join(several, "doc_id", "left_semi").select("doc_id", hashed.alias("h")).distinct()
             .withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")).cast("long") - 1))
    return (docs.withColumn("h", hashed).join(ranks, ["doc_id", "h"], "left")
            .select("doc_id", F.coalesce("version", F.lit(0).cast("long")).alias("version"), "text"))
