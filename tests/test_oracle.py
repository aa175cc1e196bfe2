"""Every query with an oracle SQL equals DuckDB on the same tables (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.oracle_check import digest

# the corpus operators' queries are checked in tests/llm
from ordinal_spark.plans import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(ORACLE) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["class", "n", "share", "imbalance_ratio", "verdict"]
