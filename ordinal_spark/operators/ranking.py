"""Distributed row numbering inside groups, without one task per group.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task. With few groups (ordinal classes) each task holds a large share
of the table. The orders used here begin with an md5 text, which is uniform: its
first three hex digits cut every group into 4,096 parts of about one size. Part
sizes are counted (pre-aggregated), summed in order, and only a part is
numbered in one task:

    rank = rows of g in earlier parts + row number inside the part

Nothing depends on how rows lie in partitions, so a recomputed partition gets
the same numbers.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_DIGITS = 3


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Exact 1-based row number of each row inside its group.

    ``order`` begins with an md5 text (``hash_order``) and must be a total
    order within a group (end it with a unique key). The table of part sizes
    has 4,096 rows a group.
    """
    if out in ("_part", "_before") or out.startswith("_o"):
        raise ValueError(f"output name {out!r} is reserved")
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"_o{i}" for i in range(len(order_cols))]
    base = df.withColumns({n: c for n, c in zip(names, order_cols)}).withColumn("_part", F.substring("_o0", 1, PART_DIGITS))
    sizes = base.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*names))
    same = [base[g].eqNullSafe(sizes[f"_g{i}"]) for i, g in enumerate(groups)] + [base["_part"] == sizes["_p"]]
    joined = base.withColumn(out, inside).join(sizes, same)
    return (joined.withColumn(out, (F.col(out) + F.col("_before")).cast("long"))
            .drop("_part", "_p", "_before", *names, *[f"_g{i}" for i in range(len(groups))]))


def hash_order(seed: int | str, key: str) -> Column:
    """Deterministic shuffle order: md5 of '<seed>|<key>' (same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                 out: str = "fold") -> DataFrame:
    """Stratified k-fold assignment. Inside each class rows are shuffled
    by md5(seed|key) and dealt round-robin, so class proportions are kept and
    fold sizes per class differ by at most one."""
    r = rank_within(df, [label], [hash_order(seed, key), key], out="_rk")
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")
