"""Missing-data analysis: A8-A14, F4, F5 (P8 lives in ``encode``).

All per-column loops of the original become one unpivot + one group-by.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col


def contingency(df: DataFrame, cat_cols: Sequence[str], indicator: str) -> DataFrame:
    """(column, category, n_present, n_missing) for every category column
    against a 0/1 missing indicator (pivot with fixed values 0/1, so a column
    with nothing missing still gets a 0 count)."""
    ind = col(indicator)
    pairs = df.select(ind.alias("_ind"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("category"))
        for c in cat_cols])).alias("s")).select("s.column", "s.category", "_ind")
    return (pairs.where(F.col("category").isNotNull()).groupBy("column", "category")
            .agg(F.count_if(F.col("_ind") == 0).cast("bigint").alias("n_present"),
                 F.count_if(F.col("_ind") == 1).cast("bigint").alias("n_missing")))


def chi_square(table: DataFrame) -> DataFrame:
    """Pearson chi-square per column of a contingency table, with Yates'
    continuity correction when dof = 1 (SciPy's default), Cramer's V and its
    strength label. Only observed categories and non-empty indicator columns
    take part. The contingency table is small (bounded by the domains)."""
    w = Window.partitionBy("column")
    t = (table.withColumn("_r", F.col("n_present") + F.col("n_missing"))
         .withColumn("_c0", F.sum("n_present").over(w))
         .withColumn("_c1", F.sum("n_missing").over(w))
         .withColumn("_n", F.sum("_r").over(w))
         .withColumn("_rows", F.count(F.lit(1)).over(w)))
    ncols = (F.col("_c0") > 0).cast("int") + (F.col("_c1") > 0).cast("int")
    t = t.withColumn("_cols", ncols).withColumn("_dof", (F.col("_rows") - 1) * (F.col("_cols") - 1))

    def term(o, ctot):
        e = F.col("_r") * ctot / F.col("_n")
        diff = e - o
        corr = F.when(F.col("_dof") == 1, F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))) \
            .otherwise(F.lit(0.0))
        o2 = o + corr
        return F.when(ctot > 0, F.try_divide((o2 - e) * (o2 - e), e)).otherwise(F.lit(0.0))

    t = t.withColumn("_t", term(F.col("n_present"), F.col("_c0")) + term(F.col("n_missing"), F.col("_c1")))
    g = t.groupBy("column").agg(
        F.sum("_t").alias("chi2"), F.first("_dof").cast("int").alias("dof"),
        F.first("_n").cast("bigint").alias("n"),
        (F.least(F.first("_rows"), F.first("_cols")) - 1).alias("_md"))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.col("_md")))
    return (g.withColumn("cramers_v", v)
            .withColumn("strength", F.when(F.col("cramers_v") < 0.1, "weak")
                        .when(F.col("cramers_v") < 0.3, "moderate").otherwise("strong"))
            .drop("_md"))


def _erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: below 2 one minus the series of
    positive terms, from 2 on the continued fraction; 60 steps of either reach
    double precision."""
    steps = F.sequence(F.lit(1), F.lit(60))
    start = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(steps, start, lambda acc, n: F.struct((acc["term"] * 2 * z * z / (2 * n + 1)).alias("term"),
                                                               (acc["sum"] + acc["term"] * 2 * z * z / (2 * n + 1)).alias("sum")), lambda acc: acc["sum"])
    below = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * series
    safe = F.greatest(z, F.lit(2.0))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda acc, k: F.lit(1.0) + k / (2 * safe * safe) / acc)
    beyond = F.exp(-z * z) / (safe * F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(z < 2, below).otherwise(beyond)


def chi2_pvalue(x: str, k: str) -> Column:
    """Upper tail of the chi-square distribution with whole degrees of freedom,
    Q(k/2, x/2), as a column: a finite sum for even ones, erfc and a finite sum
    for odd ones. Null for null input or no degrees of freedom."""
    h, dof = F.col(x).cast("double") / 2, F.col(k).cast("int")
    odd = dof % 2 == 1
    first = F.when(odd, F.exp(-h) * F.sqrt(h) * F.lit(2 / math.sqrt(math.pi))).otherwise(F.exp(-h))
    more = F.floor((dof - 1) / 2).cast("int") - F.when(odd, F.lit(1)).otherwise(F.lit(0))  # terms after the first
    a = F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("sum"))
    total = F.aggregate(F.when(more >= 1, F.sequence(F.lit(0), more - 1)).otherwise(F.array().cast("array<int>")), start,
                        lambda acc, i: F.struct((acc["term"] * h / (a + i)).alias("term"), (acc["sum"] + acc["term"] * h / (a + i)).alias("sum")),
                        lambda acc: acc["sum"])
    tail = F.when(odd, _erfc(F.sqrt(h)) + F.when(dof > 1, total).otherwise(F.lit(0.0))).otherwise(total)
    return F.when(F.col(x).isNull() | (dof < 1), F.lit(None).cast("double")).when(h <= 0, F.lit(1.0)).otherwise(tail)


def missing_by_category(table: DataFrame) -> DataFrame:
    """A10 + F4: missing % per category, and whether it is above the mean of
    its column's categories."""
    pct = F.col("n_missing") * 100.0 / (F.col("n_present") + F.col("n_missing"))
    w = Window.partitionBy("column")
    return (table.select("column", "category", pct.alias("missing_pct"))
            .withColumn("above_average", F.col("missing_pct") > F.avg("missing_pct").over(w)))


def missing_by_group(df: DataFrame, group: str, c: str) -> DataFrame:
    """Share of nulls (in %) of ``c`` per value of ``group``."""
    return df.groupBy(col(group)).agg((F.avg(col(c).isNull().cast("double")) * 100.0)
                                      .alias("missing_pct"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns (one row)."""
    return df.agg(F.corr(col(a).cast("double"), col(b).cast("double")).alias("r"))


def point_biserial(df: DataFrame, features: Sequence[str], indicator: str,
                   strong: float = 0.1) -> DataFrame:
    """A13 + F5: correlation of every feature with a 0/1 indicator (the
    point-biserial r is Pearson's r), one aggregate for all features; the
    strong ones (|r| > ``strong``) flagged with r rounded to 3 digits."""
    ind = col(indicator).cast("double")
    a = df.agg(*[F.corr(col(f).cast("double"), ind).alias(f"_r{i}") for i, f in enumerate(features)])
    out = a.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_r{i}").alias("r"))
        for i, f in enumerate(features)])).alias("s")).select("s.*")
    return (out.withColumn("strong", F.abs("r") > strong)
            .withColumn("r_rounded", F.when(F.col("strong"), F.round("r", 3))))


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Min, quartiles (linear interpolation) and max of ``value`` per
    value of ``by`` (a closed list) - the table behind a box plot."""
    from .quantiles import quantiles
    x = col(value).cast("double")
    ends = df.groupBy(col(by)).agg(F.min(x).alias("min"), F.max(x).alias("max"))
    cuts = quantiles(df.select(col(by).alias("key"), x.alias("value")), (0.25, 0.5, 0.75))
    cuts = cuts.select(F.col("key").alias("_key"), F.col("values")[0].alias("q25"), F.col("values")[1].alias("median"), F.col("values")[2].alias("q75"))
    return (ends.join(F.broadcast(cuts), col(by).eqNullSafe(F.col("_key")), "left")  # a row for each value of ``by``
            .select(col(by), "min", "q25", "median", "q75", "max"))
