"""Data-quality operators V1-V5."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import col
from ..schema import SeveritySchema


def _stack(df: DataFrame, cols: Sequence[str], value_type: str = "string") -> DataFrame:
    """(column, value) pairs of the given columns, one row per cell."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast(value_type).alias("value"))
        for c in cols])).alias("_s")).select("_s.column", "_s.value")


def checked_domains(s: SeveritySchema) -> dict[str, tuple[str, ...]]:
    """V1 closed lists plus V2 ordinal mapping keys."""
    d = {c: tuple(v) for c, v in s.domains.items()}
    for c, spec in s.ordinals.items():
        d[c] = tuple(spec.levels)
    return d


def domain_table(spark: SparkSession, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(c, v) for c, vals in domains.items() for v in vals]
    return spark.createDataFrame(rows, "column string, value string")


def domain_inventory(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """V1+V2 in one pass: every distinct value of every checked column with
    its row count and whether it lies in the domain (null never does).

    (column, value) counts are combined map-side; the domain table is built
    from the schema (bounded by it), so broadcasting it is safe.
    """
    domains = checked_domains(s)
    counts = (_stack(df, list(domains)).groupBy("column", "value")
              .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))
    dom = F.broadcast(domain_table(df.sparkSession, domains)
                      .withColumn("_valid", F.lit(True)))
    return (counts.join(dom, ["column", "value"], "left")
            .select("column", "value", "n_rows",
                    F.coalesce(F.col("_valid"), F.lit(False)).alias("is_valid")))


def domain_violations(df: DataFrame, s: SeveritySchema) -> DataFrame:
    return domain_inventory(df, s).where(~F.col("is_valid")).drop("is_valid")


def describe_violations(inventory: DataFrame) -> list[str]:
    """One line for each column with values outside its domain: how many
    values and rows, and the first value. The full table is
    ``domain_violations``."""
    bad = (inventory.where(~F.col("is_valid")).groupBy("column")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"), F.min("value").alias("first")).orderBy("column"))
    return [f"Invalid values in {r['column']}: {r['n']} values in {r['rows']} rows, e.g. {r['first']!r}" for r in bad.collect()]


def fd_violations(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """V3: attributes holding more than one distinct non-null value for some
    key: (column, n_bad_keys, example_key). One hash aggregate with min/max of
    each attribute's 64-bit hash (more than one distinct value <=> min != max);
    no distinct aggregation, so hot keys are combined map-side."""
    aggs = []
    for i, a in enumerate(attributes):
        h = F.when(col(a).isNotNull(), F.xxhash64(col(a)))
        aggs += [F.min(h).alias(f"_mn{i}"), F.max(h).alias(f"_mx{i}")]
    per = df.where(col(key).isNotNull()).groupBy(col(key).alias("_k")).agg(*aggs)
    out = []
    for i, a in enumerate(attributes):
        bad = F.col(f"_mn{i}") != F.col(f"_mx{i}")
        out += [F.count_if(bad).cast("bigint").alias(f"_n{i}"),
                F.min(F.when(bad, F.col("_k"))).alias(f"_e{i}")]
    tot = per.agg(*out)
    stacked = tot.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("column"), F.col(f"_n{i}").alias("n_bad_keys"),
                 F.col(f"_e{i}").alias("example_key"))
        for i, a in enumerate(attributes)])).alias("s")).select("s.*")
    return stacked.where(F.col("n_bad_keys") > 0)


def new_levels(new: DataFrame, original: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) present in ``new`` but not in ``original``."""
    a = _stack(new, cols).distinct()
    b = _stack(original, cols).distinct()
    return a.join(b, [a.column == b.column, a.value.eqNullSafe(b.value)], "left_anti")


def feature_preservation(original: DataFrame, resampled: DataFrame,
                         dummy_cols: Sequence[str], other_cols: Sequence[str]) -> DataFrame:
    """V5: dummies that left {0,1}, other features that gained new values."""
    parts = []
    if dummy_cols:
        d = (_stack(resampled, dummy_cols, "double").distinct()
             .where(~F.col("value").isin(0.0, 1.0) | F.col("value").isNull())
             .withColumn("problem", F.lit("non_binary")))
        parts.append(d)
    if other_cols:
        n = (new_levels(resampled.select([col(c).cast("double").alias(c) for c in other_cols]),
                        original.select([col(c).cast("double").alias(c) for c in other_cols]),
                        other_cols)
             .select("column", F.col("value").cast("double").alias("value"))
             .withColumn("problem", F.lit("new_value")))
        parts.append(n)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
