"""Class rebalancing: R1-R4 plans and exact-n undersampling (W4), J6.

The resampling plans are K-row tables (one row per class); windows over them
without a partition key are fine because K is a closed list.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col
from .ranking import hash_order, rank_within

# Oversampling targets of the original: share of the majority count for
# classes 1, 5 and 6 (fixed values).
DEFAULT_OVERSAMPLE = {1: 0.60, 5: 0.50, 6: 0.70}


def class_table(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label).alias("class")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def sampling_plan(df: DataFrame, label: str, ratio: float = 0.75,
                  oversample: Mapping[int, float] | None = None) -> DataFrame:
    """R1-R3 as one K-row table.

    * ``balanced_target`` (R1): max(n, floor(sqrt(max * min))) - computed,
      reported, and (as in the original) not used by the resampler.
    * ``under_target`` (R2): the majority class is cut to
      floor(second largest / ratio), never above its own size.
    * ``over_target`` (R3): listed classes grow to floor(share * majority
      after undersampling), never below their own size.
    """
    over = dict(DEFAULT_OVERSAMPLE if oversample is None else oversample)
    w = Window.partitionBy()  # K rows
    rk = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), F.asc("class")))
    t = class_table(df, label).withColumn("_rk", rk)
    second = F.max(F.when(F.col("_rk") == 2, F.col("n"))).over(w)
    t = (t.withColumn("balanced_target", F.greatest(
            F.col("n"), F.floor(F.sqrt(F.max("n").over(w) * F.min("n").over(w))).cast("bigint")))
         .withColumn("under_target", F.when(
             (F.col("_rk") == 1) & second.isNotNull(),
             F.least(F.col("n"), F.floor(second / F.lit(ratio)).cast("bigint"))).otherwise(F.col("n"))))
    frac = F.create_map(*[x for k, v in over.items() for x in (F.lit(k), F.lit(float(v)))]) \
        if over else None
    mx = F.max("under_target").over(w)
    f = F.try_element_at(frac, F.col("class")) if frac is not None else F.lit(None).cast("double")
    t = t.withColumn("over_target", F.when(
        f.isNotNull(), F.greatest(F.col("under_target"), F.floor(f * mx).cast("bigint")))
        .otherwise(F.col("under_target")))
    return t.drop("_rk")


def undersample(df: DataFrame, label: str, key: str, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Keep exactly ``under_target`` rows per class, chosen by the
    md5(seed|key) order (deterministic, same order as in SQL). The class rank
    is computed without one task per class (``rank_within``)."""
    r = rank_within(df, [label], [hash_order(seed, key), key], out="_rk")
    p = F.broadcast(plan.select(F.col("class").alias("_c"), "under_target"))
    return (r.join(p, r[label] == p["_c"])
            .where(F.col("_rk") <= F.col("under_target"))
            .drop("_rk", "_c", "under_target"))


def compare_distributions(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts before and after, full outer join, missing -> 0."""
    b = class_table(before, label).withColumnRenamed("n", "n_before")
    a = class_table(after, label).withColumnRenamed("n", "n_after")
    return (b.join(a, "class", "full")
            .select("class", F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"),
                    F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after")))
