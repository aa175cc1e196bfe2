"""X3 and X4 as wholes: every table of a report in one long table of
(report, item, metric, value), from one evaluation of its input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pipelines as P
from . import q_analysis, q_profile  # noqa: F401 - their SQL is registered first
from .registry import ORACLE, register

S = C.S
CATS = [c for c in S.incident_categories if c != S.target]
IND = f"{S.target}_missing"

# report: (registered SQL of its table, key columns, metrics)
X4_TABLES = {
    "key_uniqueness": ("key_uniqueness", [], ["rows", "distinct_keys"]),
    "records_per_key": ("records_per_key", [], ["total_incidents", "incidents_with_multiple_records", "max_records_per_incident", "avg_records_per_incident"]),
    "varying_attributes": ("varying_attributes", ["column"], ["n_incidents"]),
    "categorical_profile": ("categorical_profile", ["column", "value"], ["rank", "n", "unique_values"]),
    "numeric_profile": ("numeric_profile", ["column"], ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "unique_values"]),
}
X3_TABLES = {
    "missing_by_year": ("missing_by_year", [S.years_col], ["missing_pct"]),
    "year_correlation": ("year_missing_correlation", [], ["r"]),
    "year_by_missingness": ("year_by_missingness", [IND], ["min", "q25", "median", "q75", "max"]),
    "contingency": ("contingency", ["column", "category"], ["n_present", "n_missing"]),
    "chi_square": ("chi_square", ["column", "strength"], ["chi2", "dof", "n", "cramers_v"]),
    "p_values": ("chi_square_pvalues", ["column"], ["p_value"]),
    "missing_by_category": ("missing_by_category", ["column", "category"], ["missing_pct", "position"]),
    "point_biserial": ("point_biserial", ["feature"], ["r"]),
}


def melt(report: str, table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(report, item, metric, value) of a table; nulls are left out."""
    item = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys]) if keys else F.lit("")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics]
    return (table.select(F.lit(report).alias("report"), item.alias("item"), F.explode(F.array(*cells)).alias("c"))
            .select("report", "item", "c.metric", F.round("c.value", 6).alias("value")).where(F.col("value").isNotNull()))


def _sql(tables: dict) -> str:
    parts = []
    for report, (name, keys, metrics) in tables.items():
        item = "concat_ws('|', " + ", ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) + ")" if keys else "''"
        source = ORACLE[name]
        if "position" in metrics:  # O1: largest first within a column
            source = f'SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY missing_pct DESC, category) AS position FROM ({source})'
        for m in metrics:
            parts.append(f"""SELECT '{report}' AS report, {item} AS item, '{m}' AS metric, round(CAST("{m}" AS DOUBLE), 6) AS value
FROM ({source}) WHERE "{m}" IS NOT NULL""")
    return "\nUNION ALL\n".join(parts)


def _long(tables: dict, found: dict) -> DataFrame:
    return reduce(DataFrame.unionByName, [melt(r, found[r], keys, metrics) for r, (_, keys, metrics) in tables.items()])


@register("profile_report", _sql(X4_TABLES))
def q_profile_report(spark, sf):
    """All tables of the exploratory report."""
    return _long(X4_TABLES, P.profile_report(C.reports(spark, sf), S))


@register("missing_report", _sql(X3_TABLES))
def q_missing_report(spark, sf):
    """All tables of the missing-data report, categories in report order."""
    found = P.missing_report(C.reports(spark, sf), S)
    return _long(X3_TABLES, found | {"p_values": found["chi_square"]})
