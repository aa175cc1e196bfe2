"""Fixture queries: entity resolution, validation, profile, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import composite_key, score_lookup
from ..operators import encode as enc
from ..operators import entity, profile, quality
from . import common as C
from . import oracle_sql as O
from .registry import register

S = C.S

CLASS_SQL = O.with_(O.BASE, f"""codes AS (SELECT CAST({O.AFFECTED_CODE} AS INT) AS class FROM cons0),
cc AS (SELECT class, count(*) AS n FROM codes GROUP BY class)""") + """
SELECT class, CAST(n AS BIGINT) AS n,
       round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share,
       round(CAST(max(n) OVER () AS DOUBLE) / min(n) OVER (), 6) AS imbalance_ratio,
       CASE WHEN CAST(max(n) OVER () AS DOUBLE) / min(n) OVER () > 10 THEN 'warning'
            WHEN CAST(max(n) OVER () AS DOUBLE) / min(n) OVER () > 3 THEN 'info'
            ELSE 'ok' END AS verdict
FROM cc"""


@register("incident_class_distribution", CLASS_SQL)
def incident_class_distribution(spark, sf):
    """Flagship: W1 -> A1 -> P2 -> A7 (class distribution of incidents)."""
    # class counts need no standardised score: skip the pin + statistics job
    cons = enc.ordinal_encode(entity.consolidate(C.reports(spark, sf), S, standardise=False), S)
    return C.round_doubles(profile.class_counts(cons, S.target))


@register("split_references", O.with_(O.INCIDENTS, O.RANKED, O.SPLIT) + """
SELECT ref, year, quarter, data_subject_type, data_type, decision_taken, incident_type,
       no_affected, sector, time_to_report FROM split""")
def q_split_references(spark, sf):
    return C.split(spark, sf)


@register("split_statistics", O.with_(O.INCIDENTS, O.RANKED, O.SPLIT, """units AS (
  SELECT bi_reference, year, quarter, rk, count(*) AS n_rows FROM split
  GROUP BY bi_reference, year, quarter, rk, decision_taken, incident_type, no_affected, sector,
           time_to_report),
up AS (SELECT *, count(*) OVER (PARTITION BY bi_reference, year, quarter) AS per_period FROM units)""") + """
SELECT CAST(coalesce(sum(CASE WHEN rk > 1 THEN n_rows END), 0) AS BIGINT) AS rows_modified,
       CAST(count(*) FILTER (WHERE rk > 1 AND per_period = 1) AS BIGINT) AS period_splits,
       CAST(count(*) FILTER (WHERE rk > 1 AND per_period > 1) AS BIGINT) AS field_splits,
       CAST(count(*) AS BIGINT) AS incidents
FROM up""")
def q_split_statistics(spark, sf):
    return entity.split_statistics(C.reports(spark, sf), S)


@register("consolidated", O.with_(O.BASE) + """
SELECT ref, raw_score, round(data_type_score, 6) AS data_type_score, subject_type_count, year,
       quarter, decision_taken, incident_type, no_affected, sector, time_to_report
FROM consolidated""")
def q_consolidated(spark, sf):
    return C.round_doubles(C.consolidated(spark, sf))


@register("id_collisions", O.with_(O.COLLIDING, O.RANKED, O.SPLIT, """u AS (
  SELECT DISTINCT ref, bi_reference, year, quarter, decision_taken, incident_type, no_affected,
         sector, time_to_report FROM split)""") + """
SELECT ref, CAST(count(*) AS BIGINT) AS units FROM u GROUP BY ref HAVING count(*) > 1""")
def q_id_collisions(spark, sf):
    """Q1 on reports whose references collide with split-off ids."""
    return entity.id_collisions(C.reports_with_collisions(spark, sf), S)


def _inventory_sql() -> str:
    doms = {c: list(v) for c, v in S.domains.items()}
    for c, spec in S.ordinals.items():
        doms[c] = list(spec.levels)
    stacks = " UNION ALL ".join(
        f"SELECT '{c}' AS column, {c} AS value FROM incidents" for c in doms)
    dom_rows = " UNION ALL ".join(f"SELECT '{c}' AS column, '{v}' AS value"
                                  for c, vals in doms.items() for v in vals)
    return O.with_(O.INCIDENTS, f"st AS ({stacks})", f"dom AS ({dom_rows})") + """
SELECT s.column, s.value, CAST(count(*) AS BIGINT) AS n_rows,
       bool_or(d.value IS NOT NULL) AS is_valid
FROM st s LEFT JOIN dom d ON s.column = d.column AND s.value = d.value
GROUP BY s.column, s.value"""


@register("domain_inventory", _inventory_sql())
def q_domain_inventory(spark, sf):
    """V1 + V2: checked columns, every value with validity."""
    return quality.domain_inventory(C.reports(spark, sf), S)


def _fd_sql(chain: tuple = (O.INCIDENTS,), table: str = "incidents", key: str = "bi_reference") -> str:
    attrs = S.attributes
    per = ", ".join(f"min({a}) <> max({a}) AS b{i}" for i, a in enumerate(attrs))
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS column, CAST(count(*) FILTER (WHERE b{i}) AS BIGINT) AS n_bad_keys, "
        f"min(CASE WHEN b{i} THEN k END) AS example_key FROM per" for i, a in enumerate(attrs))
    return O.with_(*chain, f"per AS (SELECT {key} AS k, {per} FROM {table} "
                   f"GROUP BY {key})", f"r AS ({rows})") + \
        "\nSELECT * FROM r WHERE n_bad_keys > 0"


@register("fd_violations", _fd_sql())
def q_fd_violations(spark, sf):
    """V3 on the raw reports keyed by the original reference (before W1 this
    dependency is violated; that is why references are split)."""
    return quality.fd_violations(C.reports(spark, sf), S.key, S.attributes)


@register("fd_violations_after_split", _fd_sql((O.COLLIDING, O.RANKED, O.SPLIT), "split", "ref"))
def q_fd_after_split(spark, sf):
    """V3 after W1, on reports whose references collide with split-off ids
    (without such collisions it is empty by construction)."""
    split = entity.split_references(C.reports_with_collisions(spark, sf), S)
    return quality.fd_violations(split, S.ref, S.attributes)


MULTI_SQL = O.with_(O.INCIDENTS, O.RANKED, O.SPLIT,
                    "k AS (SELECT ref FROM split GROUP BY ref HAVING count(*) > 1)")


@register("records_per_key", MULTI_SQL + """,
per AS (SELECT ref, count(*) AS n FROM split GROUP BY ref)
SELECT CAST(count(*) AS BIGINT) AS total_incidents,
       CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS incidents_with_multiple_records,
       CAST(max(n) AS BIGINT) AS max_records_per_incident,
       round(avg(n), 6) AS avg_records_per_incident
FROM per""")
def q_records_per_key(spark, sf):
    """A2 on the split report rows."""
    return C.round_doubles(entity.records_per_key(C.split(spark, sf), S.ref))


def _varying_sql() -> str:
    cols = ["ref", "year", "quarter", "data_subject_type", "data_type", *S.split_fields]
    per = ", ".join(f"(min({c}) <> max({c}) OR (count({c}) > 0 AND count({c}) < count(*))) AS v{i}"
                    for i, c in enumerate(cols))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE v{i}) AS BIGINT)"
                              f" AS n_incidents FROM per" for i, c in enumerate(cols))
    return O.with_(O.INCIDENTS, O.RANKED, O.SPLIT,
                   f"per AS (SELECT ref, {per} FROM split GROUP BY ref HAVING count(*) > 1)",
                   f"r AS ({rows})") + "\nSELECT * FROM r WHERE n_incidents > 0"


@register("varying_attributes", _varying_sql())
def q_varying_attributes(spark, sf):
    """A3 on the split report rows: which columns still vary per incident."""
    return entity.varying_attributes(C.split(spark, sf), S.ref)


@register("multi_record_rows", MULTI_SQL + """
SELECT s.ref, s.year, s.quarter, s.data_subject_type, s.data_type, s.decision_taken,
       s.incident_type, s.no_affected, s.sector, s.time_to_report
FROM split s SEMI JOIN k ON s.ref = k.ref""")
def q_multi_record_rows(spark, sf):
    """Report rows of incidents with more than one record (semi join)."""
    sp = C.split(spark, sf)
    multi = sp.groupBy(S.ref).count().where(F.col("count") > 1).select(S.ref)
    return sp.join(multi, S.ref, "left_semi")


@register("key_uniqueness", O.with_(O.INCIDENTS, O.RANKED, O.SPLIT) + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT ref) AS BIGINT) AS distinct_keys
FROM split""")
def q_key_uniqueness(spark, sf):
    """A17 on the split report rows."""
    return profile.key_uniqueness(C.split(spark, sf), S.ref)


def _catprof_sql() -> str:
    cols = list(S.categories)
    stacks = " UNION ALL ".join(f"SELECT '{c}' AS cname, {c} AS value FROM split" for c in cols)
    return O.with_(O.INCIDENTS, O.RANKED, O.SPLIT, f"st AS ({stacks})", """cnt AS (
  SELECT cname, value, count(*) AS n FROM st WHERE value IS NOT NULL GROUP BY cname, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY cname ORDER BY n DESC, value ASC) AS rank,
              count(*) OVER (PARTITION BY cname) AS unique_values FROM cnt)""") + """
SELECT r.cname AS "column", CAST(r.unique_values AS BIGINT) AS unique_values, m.value AS mode,
       CAST(r.rank AS INT) AS rank, r.value, CAST(r.n AS BIGINT) AS n
FROM rk r JOIN rk m ON r.cname = m.cname AND m.rank = 1
WHERE r.rank <= 5"""


@register("categorical_profile", _catprof_sql())
def q_categorical_profile(spark, sf):
    """A5/O2 on the split report rows (category columns)."""
    return profile.categorical_profile(C.split(spark, sf), list(S.categories))


@register("numeric_profile", O.with_(O.INCIDENTS, O.RANKED, O.SPLIT) + """
SELECT 'year' AS column, CAST(count(year) AS BIGINT) AS count, round(avg(year), 6) AS mean,
       round(stddev_samp(year), 6) AS std, CAST(min(year) AS DOUBLE) AS min,
       round(quantile_cont(year, 0.25), 6) AS q25, round(quantile_cont(year, 0.5), 6) AS q50,
       round(quantile_cont(year, 0.75), 6) AS q75, CAST(max(year) AS DOUBLE) AS max,
       CAST(count(DISTINCT year) AS BIGINT) AS unique_values
FROM split
UNION ALL
SELECT 'ref', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CAST(count(DISTINCT ref) AS BIGINT) FROM split
UNION ALL
SELECT 'quarter', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CAST(count(DISTINCT quarter) AS BIGINT) FROM split""")
def q_numeric_profile(spark, sf):
    """A6 on the split report rows (non-category columns)."""
    return C.round_doubles(profile.numeric_profile(C.split(spark, sf), [S.ref, S.year, S.period]))


@register("score_stats", O.with_(O.BASE) + """
SELECT round(avg(data_type_score), 6) AS mean, round(stddev_samp(data_type_score), 6) AS std,
       round(min(data_type_score), 6) AS min, round(max(data_type_score), 6) AS max
FROM consolidated""")
def q_score_stats(spark, sf):
    """Range of the standardised score."""
    return C.round_doubles(profile.score_stats(C.consolidated(spark, sf), S.score_col))


@register("score_lookup", O.with_(O.INCIDENTS) + f"""
SELECT data_type, CAST({O.SCORE} AS INT) AS score, CAST(count(*) AS BIGINT) AS n_rows
FROM incidents GROUP BY data_type""")
def q_score_lookup(spark, sf):
    """Score of every data type seen (unknown types score 0)."""
    r = C.reports(spark, sf)
    return (r.groupBy(S.data_type).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            .withColumn("score", score_lookup(F.col(S.data_type), S.scores).cast("int")))


@register("composite_keys", O.with_(O.INCIDENTS) + """
SELECT concat(bi_reference, '_', CAST(year AS VARCHAR(4)), '_', quarter) AS temp_key,
       CAST(count(*) AS BIGINT) AS n_rows
FROM incidents GROUP BY 1""")
def q_composite_keys(spark, sf):
    """The reference/period composite key with its row count."""
    r = C.reports(spark, sf)
    k = composite_key([F.col(S.key), F.col(S.year), F.col(S.period)])
    return r.groupBy(k.alias("temp_key")).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("ordinal_codes", O.with_(O.BASE) + f"""
SELECT ref, CAST({O.AFFECTED_CODE} AS INT) AS no_affected, CAST({O.TIME_CODE} AS INT) AS time_to_report
FROM consolidated""")
def q_ordinal_codes(spark, sf):
    """Ordinal codes of the two ordered columns per incident."""
    return enc.ordinal_encode(C.consolidated(spark, sf), S).select(S.ref, *S.ordinals)


def _f1_sql() -> str:
    sel = " UNION ALL ".join(
        f"SELECT {i} AS step, '{c}' AS column, round(sh, 6) AS share, "
        f"(sh > 0 AND sh < 0.05) AS dropped, (SELECT CAST(count(*) AS BIGINT) FROM c{i}) AS rows_after "
        f"FROM sh{i}" for i, c in enumerate(S.incident_categories, start=1))
    return O.with_(O.CLEAN_BASE) + "\n" + sel


@register("unknown_filter_steps", _f1_sql())
def q_unknown_filter_steps(spark, sf):
    """per category column (in order) the unknown share seen at that
    step, whether its unknown rows were dropped and the rows left."""
    plan = C.clean(spark, sf).unknown_steps
    rows = [(d.step, d.column, round(d.share, 6), d.dropped, d.rows_after) for d in plan]
    return spark.createDataFrame(
        rows, "step int, column string, share double, dropped boolean, rows_after bigint")


def _enc_cols_sql() -> str:
    dums = [f'"{c}_{v}"' for c, lv in O.DUMMY_LEVELS.items() for v in lv]
    return ", ".join(["ref", "round(data_type_score, 6) AS data_type_score", "subject_type_count",
                      "no_affected", "time_to_report", "years_since_start", *dums])


@register("encoded_incidents", O.with_(O.ENC_BASE) + f"\nSELECT {_enc_cols_sql()} FROM encoded")
def q_encoded(spark, sf):
    """X1 without imputation: W1, A1, P5, F1, P6, P3, P2."""
    return C.round_doubles(C.encoded(spark, sf).data)


@register("dummy_roundtrip", O.with_(O.CLEAN_BASE) + """
SELECT ref, quarter, decision_taken, incident_type, sector FROM clean""")
def q_dummy_roundtrip(spark, sf):
    """Decoding the dummies restores the original level columns."""
    prep = C.encoded(spark, sf)
    dec = enc.dummy_decode_all(prep.data, prep.dummies)
    return dec.select(S.ref, *S.dummies)
