"""DuckDB-runnable SQL for the fixture queries (the correctness oracle).

The fragments mirror FIXTURES.md: ``incidents`` (raw reports), ``ranked`` /
``split`` (W1), ``cons0`` / ``consolidated`` (A1 + z-score), ``clean`` (F1),
``encoded`` (P2/P3/P6). Each query text is a WITH chain over these.
"""

from __future__ import annotations

from ..schema import FIXTURE_SCHEMA, REFERENCE_AFFECTED_LEVELS, REFERENCE_TIME_LEVELS
from ..sources.fixtures import INCIDENTS_SQL

S = FIXTURE_SCHEMA


def _case_map(column: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


AFFECTED_CODE = _case_map("no_affected", {lvl: i for i, lvl in enumerate(REFERENCE_AFFECTED_LEVELS)})
TIME_CODE = _case_map("time_to_report", {lvl: i for i, lvl in enumerate(REFERENCE_TIME_LEVELS)})
SCORE = _case_map("data_type", dict(S.scores), "0")
UNK = "('Unknown', 'Unassigned')"

INCIDENTS = f"incidents AS ({INCIDENTS_SQL})"
COLLIDING = f"""incidents AS (SELECT * REPLACE (CASE WHEN CAST(substr(bi_reference, 2) AS BIGINT) % 10 = 1
    THEN concat('C', CAST(substr(bi_reference, 2) AS BIGINT) - 1, 'A1') ELSE bi_reference END AS bi_reference)
  FROM ({INCIDENTS_SQL}))"""
FIELDKEY = "concat(decision_taken,'_',incident_type,'_',no_affected,'_',sector,'_',time_to_report)"
RANKED = f"""ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY bi_reference
      ORDER BY CAST(year AS VARCHAR(4)), quarter, {FIELDKEY}) AS rk
  FROM incidents)"""
SPLIT = """split AS (
  SELECT CASE WHEN rk = 1 THEN bi_reference
              ELSE concat(bi_reference, 'A', CAST(rk - 1 AS VARCHAR(9))) END AS ref,
         bi_reference, rk, year, quarter, data_subject_type, data_type, decision_taken,
         incident_type, no_affected, sector, time_to_report
  FROM ranked)"""
CONS0 = f"""types AS (
  SELECT ref, sum({SCORE}) AS raw_score FROM (SELECT DISTINCT ref, data_type FROM split) d GROUP BY ref),
cons0 AS (
  SELECT f.ref, CAST(min(t.raw_score) AS BIGINT) AS raw_score,
         CAST(count(DISTINCT f.data_subject_type) AS BIGINT) AS subject_type_count,
         CAST(min(f.year) AS INT) AS year, min(f.quarter) AS quarter,
         min(f.decision_taken) AS decision_taken, min(f.incident_type) AS incident_type,
         min(f.no_affected) AS no_affected, min(f.sector) AS sector,
         min(f.time_to_report) AS time_to_report
  FROM split f JOIN types t ON f.ref = t.ref
  GROUP BY f.ref)"""
CONS = """consolidated AS (
  SELECT ref, raw_score,
         (raw_score - avg(raw_score) OVER ()) / stddev_samp(raw_score) OVER () AS data_type_score,
         subject_type_count, year, quarter, decision_taken, incident_type, no_affected, sector,
         time_to_report
  FROM cons0)"""


def _clean_chain() -> str:
    parts = []
    prev = "consolidated"
    for i, c in enumerate(S.incident_categories, start=1):
        u = f"coalesce({c} IN {UNK}, false)"
        parts.append(f"""sh{i} AS (SELECT avg(CASE WHEN {u} THEN CAST(1 AS DOUBLE)
                                          ELSE CAST(0 AS DOUBLE) END) AS sh,
                                 count(*) AS n_before FROM {prev}),
c{i} AS (SELECT p.* FROM {prev} p CROSS JOIN sh{i}
        WHERE NOT (sh{i}.sh > 0 AND sh{i}.sh < 0.05 AND coalesce(p.{c} IN {UNK}, false)))""")
        prev = f"c{i}"
    parts.append(f"clean AS (SELECT * FROM {prev})")
    return ",\n".join(parts)


CLEAN = _clean_chain()

# Fixture dummy levels: categories at load, sorted, first dropped, zero
# columns (sector Unknown/Unassigned after F1) removed.
DUMMY_LEVELS = {
    "quarter": ["Qtr 2", "Qtr 3", "Qtr 4"],
    "decision_taken": ["O", "P"],
    "incident_type": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "sector": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def _dummy_sql() -> str:
    cols = []
    for c, lv in DUMMY_LEVELS.items():
        for v in lv:
            cols.append(f"CASE WHEN {c} = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
                        f"AS \"{c}_{v}\"")
    return ",\n         ".join(cols)


ENCODED = f"""encoded AS (
  SELECT ref, data_type_score, subject_type_count,
         CAST({AFFECTED_CODE} AS INT) AS no_affected,
         CAST({TIME_CODE} AS INT) AS time_to_report,
         CAST(year - min(year) OVER () AS INT) AS years_since_start,
         {_dummy_sql()}
  FROM clean)"""

BASE = ",\n".join([INCIDENTS, RANKED, SPLIT, CONS0, CONS])
CLEAN_BASE = ",\n".join([BASE, CLEAN])
ENC_BASE = ",\n".join([CLEAN_BASE, ENCODED])


def with_(base: str, *extra: str) -> str:
    return "WITH " + ",\n".join([base, *extra])
