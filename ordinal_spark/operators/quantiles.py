"""Exact quantiles by counting passes, without a buffer of values.

Order statistics are found by refinement: a pass counts the values of a range
in equal buckets and keeps the least and largest of each; the bucket that holds
a wanted rank is the next range, until its least and largest are the same value.
Two or three passes do for most columns. A pass is one aggregate whose size is
the buckets of the open ranges, whatever the rows; the driver gets the buckets
that hold wanted ranks only. Nothing is sorted.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _order_statistics(rows: DataFrame, wanted: dict) -> dict:
    """(key, rank) -> value for ``wanted``: key -> (n, least, largest, ranks)."""
    out: dict = {}
    open_ = []  # (key, least, largest, ranks below the range, wanted ranks)
    for key, (_, lo, hi, ranks) in wanted.items():
        open_.append((key, lo, hi, 0, sorted(set(ranks))))
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    while open_:
        left = []
        for key, lo, hi, below, ranks in open_:
            if lo == hi:
                out.update({(key, r): lo for r in ranks})
            else:
                left.append((key, lo, hi, below, ranks))
        if not left:
            break
        ranges = spark.createDataFrame([(i, key, lo, hi, below, ranks) for i, (key, lo, hi, below, ranks) in enumerate(left)],
                                       f"_range int, key {kind}, _lo double, _hi double, _below long, _ranks array<long>")
        inside = rows.join(F.broadcast(ranges), rows["key"].eqNullSafe(ranges["key"]) & F.col("value").between(F.col("_lo"), F.col("_hi")))
        # the difference of two large doubles may overflow, half of the smallest is 0
        large = F.greatest(F.abs("_lo"), F.abs("_hi")) > 1e300
        scale = F.when(large, F.lit(0.5)).otherwise(F.lit(1.0))
        share = (F.col("value") * scale - F.col("_lo") * scale) / (F.col("_hi") * scale - F.col("_lo") * scale)
        bucket = F.when(F.col("value") == F.col("_hi"), F.lit(BUCKETS - 1)).otherwise(F.least(F.floor(share * (BUCKETS - 1)), F.lit(BUCKETS - 2)).cast("int"))
        counts = (inside.groupBy("_range", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
                                                                       F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks")))
        before = F.sum("_n").over(Window.partitionBy("_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_below", F.col("_below") + F.coalesce(before, F.lit(0)))
        held = counts.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n")))).where(F.size("_ranks") > 0)
        open_ = [(left[r["_range"]][0], r["_lo"], r["_hi"], r["_below"], list(r["_ranks"])) for r in held.collect()]  # wanted ranks only
    return out


def quantiles(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(key, values): the quantiles of ``value`` (double) for each ``key`` (a
    closed list), linearly interpolated between order statistics. Null, NaN and
    infinite values take no part; a key without values has no row."""
    finite = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    # -0.0 and 0.0 are one value
    finite = finite.select("key", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")).alias("value"))
    ends = finite.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()  # one row a key
    wanted = {}
    for r in ends:
        places = [(r["n"] - 1) * p for p in probabilities]
        wanted[r["key"]] = (r["n"], r["lo"], r["hi"], [f(x) for x in places for f in (math.floor, math.ceil)])
    found = _order_statistics(finite, wanted)
    out = []
    for key, (n, _, _, _) in wanted.items():
        values = []
        for p in probabilities:
            x = (n - 1) * p
            a, b = found[key, math.floor(x)], found[key, math.ceil(x)]
            values.append(a + (b - a) * (x - math.floor(x)))
        out.append((key, values))
    return rows.sparkSession.createDataFrame(out, f"key {rows.schema['key'].dataType.simpleString()}, values array<double>")
