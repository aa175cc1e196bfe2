"""Session helpers: the configuration every job in this package assumes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "ordinal_spark",
                shuffle_partitions: int | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster leave ``master`` None so spark-submit decides; locally pass
    ``local[N]`` and a matching ``shuffle_partitions``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SHUFFLE_ROWS, SHUFFLE_BYTES = 500_000, 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def bound_shuffles(spark: SparkSession, rows: int) -> None:
    """Shuffle settings under which no task's memory grows with a table of
    ``rows`` rows: partitions of at most ``SHUFFLE_ROWS`` rows of it, which are
    put together up to ``SHUFFLE_BYTES`` only. Sorts and hash tables of a task
    take some thirteen times what it reads. Settings that are smaller (or, of
    partitions, more) already are left."""
    partitions, together = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = -(-rows // SHUFFLE_ROWS)
    for key in (partitions, first):
        held = spark.conf.get(key, None)
        if held is not None and int(held) < wanted:
            spark.conf.set(key, str(wanted))
    size = spark.conf.get(together).lower().removesuffix("b")
    unit = size[-1:] if size[-1:].isalpha() else ""
    if int(size.removesuffix(unit)) * _UNITS[unit] > SHUFFLE_BYTES:
        spark.conf.set(together, str(SHUFFLE_BYTES))


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    ``fallback`` is only used where the setting is unset (tests, local runs).
    Returns None when neither exists: callers then keep lineage instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no JVM context in this session type
        pass
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d and fallback:
        os.makedirs(fallback, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", fallback)
        d = fallback
    if d and sc is not None:
        sc.setCheckpointDir(d)
    return d


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, for written tables. Where none is set only a
    session on one machine gets a local one."""
    folder = checkpoint_dir(spark, "/tmp/ordinal-spark-checkpoints" if spark.sparkContext.master.startswith("local[") else None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared checkpoint folder, if one is set.

    Never a local checkpoint: executor loss must not lose the data.
    Without a checkpoint folder the frame is cached and its lineage kept,
    so a lost executor recomputes its partitions from the source.
    """
    spark = spark or df.sparkSession
    if checkpoint_dir(spark):
        # cache first, or the checkpoint write re-runs the whole plan
        df = df.persist()
        out = df.checkpoint(eager=True)
        df.unpersist()
        return out
    df = df.cache()
    df.count()
    return df


def pin_columns(df, name: str):
    """``df`` written as Parquet to the shared checkpoint folder and read back,
    for passes that each read a few narrow columns; without a folder it is
    pinned as by ``cut_lineage``."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not folder:
        return cut_lineage(df)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
