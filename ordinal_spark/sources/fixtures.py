"""Report-table fixture built from the TPC-H-like test tables.

The original analysis reads one CSV of incident reports; the test driver only
ships TPC-H-like parquet tables, so this module derives a report table of the
same shape (FIXTURES.md section 2): one report per line item, the reference is
the customer, period from the order date, subject/data type from the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_shuffles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report rows (several per ``bi_reference``).

    Join order: orders with customer (orders is 4x smaller than lineitem) and
    line items with part, then both by order key, so that the reports of an
    order lie together when they are grouped. Only the columns used are read
    (parquet column pruning). All four tables grow with the scale factor, so
    none is broadcast: the planner goes by the size of the files, and 9 MB of
    orders are 900,000 rows in the driver's memory. AQE splits skewed keys (a
    customer or part holding a large share of rows). The count of line items
    (of the files' footers) sets how many partitions the shuffles have.
    """
    bound_shuffles(spark, table(spark, sf_dir, "lineitem").count())
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")

    oc = o.join(c.hint("merge"), o.o_custkey == c.c_custkey)
    lp = li.join(p.hint("merge"), li.l_partkey == p.p_partkey)
    rows = lp.join(oc.hint("merge"), lp.l_orderkey == oc.o_orderkey)

    price = F.col("o_totalprice")
    okey = F.col("o_orderkey")
    ckey = F.col("o_custkey")
    affected = (F.when(okey % 7 == 0, "Unknown")
                .when(price < 25000, "1 to 9")
                .when(price < 100000, "10 to 99")
                .when(price < 250000, "100 to 1k")
                .when(price < 400000, "1k to 10k")
                .when(price < 480000, "10k to 100k")
                .otherwise("100k and above"))
    sector = (F.when(ckey % 97 == 0, "Unassigned")
              .when(ckey % 89 == 0, "Unknown")
              .otherwise(F.col("c_mktsegment")))
    report = (F.when(okey % 10 < 3, "Less than 24 hours")
              .when(okey % 10 < 7, "24 hours to 72 hours")
              .when(okey % 10 < 9, "72 hours to 1 week")
              .otherwise("More than 1 week"))
    return rows.select(
        F.concat(F.lit("C"), ckey.cast("string")).alias("bi_reference"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.concat(F.lit("Qtr "), F.quarter("o_orderdate").cast("string")).alias("quarter"),
        F.col("p_brand").alias("data_subject_type"),
        F.col("p_type").alias("data_type"),
        F.col("o_orderstatus").alias("decision_taken"),
        F.col("o_orderpriority").alias("incident_type"),
        affected.alias("no_affected"),
        sector.alias("sector"),
        report.alias("time_to_report"),
    )


# The same table as SQL text, for the DuckDB oracle (runs unchanged in Spark).
INCIDENTS_SQL = """
SELECT
  concat('C', CAST(o.o_custkey AS VARCHAR(20)))              AS bi_reference,
  CAST(year(o.o_orderdate) AS INT)                           AS year,
  concat('Qtr ', CAST(quarter(o.o_orderdate) AS VARCHAR(2))) AS quarter,
  p.p_brand                                                  AS data_subject_type,
  p.p_type                                                   AS data_type,
  o.o_orderstatus                                            AS decision_taken,
  o.o_orderpriority                                          AS incident_type,
  CASE WHEN o.o_orderkey % 7 = 0       THEN 'Unknown'
       WHEN o.o_totalprice <  25000    THEN '1 to 9'
       WHEN o.o_totalprice < 100000    THEN '10 to 99'
       WHEN o.o_totalprice < 250000    THEN '100 to 1k'
       WHEN o.o_totalprice < 400000    THEN '1k to 10k'
       WHEN o.o_totalprice < 480000    THEN '10k to 100k'
       ELSE '100k and above' END                             AS no_affected,
  CASE WHEN o.o_custkey % 97 = 0 THEN 'Unassigned'
       WHEN o.o_custkey % 89 = 0 THEN 'Unknown'
       ELSE c.c_mktsegment END                               AS sector,
  CASE WHEN o.o_orderkey % 10 < 3 THEN 'Less than 24 hours'
       WHEN o.o_orderkey % 10 < 7 THEN '24 hours to 72 hours'
       WHEN o.o_orderkey % 10 < 9 THEN '72 hours to 1 week'
       ELSE 'More than 1 week' END                           AS time_to_report
FROM lineitem l
JOIN orders   o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey  = c.c_custkey
JOIN part     p ON l.l_partkey  = p.p_partkey
"""
