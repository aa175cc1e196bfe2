"""Profile operators: A4-A7, A15, A17, A18 (the exploratory report)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col
from ..session import cut_lineage


def _is_missing(df: DataFrame, c: str):
    x = col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def missing_profile(df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """A4 (+F3): per column missing count and percentage (2 decimals).
    One aggregate over all columns, then a tiny unpivot."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    out = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").cast("bigint").alias("missing_count"),
                 F.round(F.try_divide(F.col(f"_m{i}") * 100.0, F.col("_n")), 2)
                 .alias("missing_percentage"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return out if keep_zero else out.where(F.col("missing_count") > 0)


def categorical_profile(df: DataFrame, cols: Sequence[str], top: int = 5) -> DataFrame:
    """A5 (+O2): per category column the number of distinct values, the mode
    (smallest value among the most frequent) and the top values by count.

    (column, value) counts are combined map-side; the rank filter lets Spark
    keep only ``top`` rows per column in each partition before the final
    shuffle (window group limit), so a column with many values stays cheap.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        for c in cols])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    # pinned: three parts of the result read it
    counts = cut_lineage(pairs.groupBy("column", "value").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("unique_values"))
    mode = ranked.where(F.col("rank") == 1).select("column", F.col("value").alias("mode"))
    return (ranked.join(uniq, "column").join(mode, "column")
            .select("column", "unique_values", "mode", F.col("rank").cast("int").alias("rank"),
                    "value", "n"))


def numeric_profile(df: DataFrame, cols: Sequence[str], exact: bool = True,
                    accuracy: int = 10000) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles, max and distinct count
    per numeric column; text columns get only the distinct count.

    One aggregate over all columns, one distinct count of (column, value), and
    linear-interpolated quartiles by counting passes (``quantiles``): no buffer
    grows with the values. ``exact=False`` takes the quartiles from
    ``percentile_approx`` in the same aggregate.
    """
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    nul = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        if c not in numeric:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(None).cast("bigint").alias("count"),
                                 nul.alias("mean"), nul.alias("std"), nul.alias("min"), nul.alias("max"),
                                 F.lit(None).cast("array<double>").alias("_approx")))
            continue
        xd = col(c).cast("double")
        aggs += [F.count(col(c)).cast("bigint").alias(f"_c{i}"), F.avg(xd).alias(f"_m{i}"),
                 F.stddev_samp(xd).alias(f"_s{i}"), F.min(xd).alias(f"_lo{i}"), F.max(xd).alias(f"_hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(xd, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"_q{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("count"),
                             F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"),
                             F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"),
                             (F.lit(None).cast("array<double>") if exact else F.col(f"_q{i}")).alias("_approx")))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("_v")) for c in cols]))).where(F.col("_v").isNotNull())
    unique = pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("_u"))
    if exact and numeric:
        from .quantiles import quantiles
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), col(c).cast("double").alias("value")) for c in numeric])))
        cuts = quantiles(long, (0.25, 0.5, 0.75)).withColumnRenamed("key", "column")
    else:
        cuts = out.select("column", F.col("_approx").alias("values"))
    # tables of one row a column
    out = out.drop("_approx").join(F.broadcast(unique), "column", "left").join(F.broadcast(cuts), "column", "left")
    return out.select("column", "count", "mean", "std", "min", *[F.get("values", F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
                      "max", F.coalesce("_u", F.lit(0)).cast("bigint").alias("unique_values"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Class counts with the max/min imbalance ratio and its verdict
    (> 10 warning, > 3 info, else ok). The class table has K rows."""
    counts = df.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy()  # K rows only: the class set is a closed list
    ratio = F.max("n").over(w) / F.min("n").over(w)
    return (counts.withColumn("share", F.col("n") / F.sum("n").over(w))
            .withColumn("imbalance_ratio", ratio)
            .withColumn("verdict", F.when(F.col("imbalance_ratio") > 10, "warning")
                        .when(F.col("imbalance_ratio") > 3, "info").otherwise("ok")))


def null_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct null masks over the columns with their row counts (the
    data behind a missing-value heat map), at most 2^c rows."""
    cols = list(cols or df.columns)
    return (df.groupBy(*[_is_missing(df, c).alias(f"{c}_null") for c in cols])
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def in_order(table: DataFrame, within: Sequence[str], order: Sequence) -> DataFrame:
    """O1: a report table with each row's ``position`` (from 1) in report order
    within its group; report tables have a row for each level of a closed list."""
    return table.withColumn("position", F.row_number().over(Window.partitionBy(*[col(c) for c in within]).orderBy(*order)))


def key_uniqueness(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Rows and distinct keys (HyperLogLog++ when ``approximate``)."""
    d = F.approx_count_distinct(col(key)) if approximate else F.count_distinct(col(key))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                  d.cast("bigint").alias("distinct_keys"))


def score_stats(df: DataFrame, c: str) -> DataFrame:
    """Mean, std (ddof 1), min and max of a score column."""
    x = col(c)
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
