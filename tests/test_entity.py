"""W1/A1 on rows worked out by hand from the splitting rules, and invariants."""

from __future__ import annotations

from collections import defaultdict

import pytest

from conftest import SF_SMALL
from ordinal_spark.operators import entity, quality
from ordinal_spark.plans import pipelines as P
from ordinal_spark.schema import FIXTURE_SCHEMA as S
from ordinal_spark.sources.fixtures import incident_reports


URGENT = ("F", "1-URGENT", "1 to 9", "BUILDING", "Less than 24 hours")
OTHER = ("F", "2-HIGH", "1 to 9", "BUILDING", "Less than 24 hours")


def report(key, year, quarter, fields, subject="s", data="d"):
    return (key, year, quarter, subject, data, *fields)


# (report, incident id): units of one reference are numbered by year as text,
# then quarter, then field values; the first keeps the id. Equal units share it.
SPLIT_CASES = [
    (report("A", 2020, "Qtr 1", URGENT), "AA1"),
    (report("A", 2020, "Qtr 1", URGENT, data="e"), "AA1"),
    (report("A", 2020, "Qtr 1", OTHER), "AA2"),
    (report("A", 2019, "Qtr 4", OTHER), "A"),
    (report("A", 2020, "Qtr 2", URGENT), "AA3"),
    (report("B", 2021, "Qtr 3", URGENT), "B"),
    (report("C", 2021, "Qtr 3", URGENT), "C"),
    (report("C", 2021, "Qtr 3", URGENT, subject="t"), "C"),
    (report("D", None, "Qtr 1", URGENT), "DA2"),
    (report("D", 2021, None, URGENT), "DA1"),
    (report("D", 2021, "Qtr 2", URGENT), "D"),
]


def test_split_by_hand(spark):
    df = spark.createDataFrame([r for r, _ in SPLIT_CASES], S.struct_type())
    got = sorted(map(str, (tuple(r) for r in entity.split_references(df, S).collect())))
    assert got == sorted(str((ref, *r[1:])) for r, ref in SPLIT_CASES)


def test_every_unit_becomes_one_incident(spark):
    """A null year or period does not lose an incident."""
    df = spark.createDataFrame([r for r, _ in SPLIT_CASES], S.struct_type())
    refs = sorted(r["ref"] for r in entity.consolidate(df, S, standardise=False).collect())
    assert refs == sorted({ref for _, ref in SPLIT_CASES})


def test_split_ids_on_the_fixture(spark):
    raw = incident_reports(spark, SF_SMALL)
    split = entity.split_references(raw, S)
    assert split.count() == raw.count()
    units = raw.select(S.key, S.year, S.period, *S.split_fields).distinct()
    per = {r[0]: r[1] for r in units.groupBy(S.key).count().collect()}
    assert max(per.values()) > 1
    assert sorted(r[0] for r in split.select("ref").distinct().collect()) == sorted(
        k if i == 0 else f"{k}A{i}" for k, n in per.items() for i in range(n))


def test_consolidate_counts_and_scores(spark):
    raw = incident_reports(spark, SF_SMALL)
    cons = entity.consolidate(raw, S).collect()
    split = entity.split_references(raw, S).collect()
    per = defaultdict(lambda: (set(), set()))
    for r in split:
        per[r["ref"]][0].add(r["data_type"])
        per[r["ref"]][1].add(r["data_subject_type"])
    assert len(cons) == len(per)
    for r in cons:
        types, subj = per[r["ref"]]
        assert r["raw_score"] == sum(S.scores.get(t, 0) for t in types)
        assert r["subject_type_count"] == len(subj)
    mean = sum(r["data_type_score"] for r in cons) / len(cons)
    assert abs(mean) < 1e-9


def test_single_row_and_null_keys_untouched(spark):
    rows = [("A", 2020, "Qtr 1", "s", "LARGE", "F", "1-URGENT", "1 to 9", "BUILDING",
             "Less than 24 hours"),
            (None, 2020, "Qtr 1", "s", "LARGE", "F", "1-URGENT", "1 to 9", "BUILDING",
             "Less than 24 hours"),
            ("B", 2020, "Qtr 1", "s", "LARGE", "F", "1-URGENT", "1 to 9", "BUILDING",
             "Less than 24 hours"),
            ("B", 2021, "Qtr 1", "s", "LARGE", "F", "1-URGENT", "1 to 9", "BUILDING",
             "Less than 24 hours")]
    df = spark.createDataFrame(rows, S.struct_type())
    got = sorted((r["ref"] or "", r["year"]) for r in entity.split_references(df, S).collect())
    assert got == [("", 2020), ("A", 2020), ("B", 2020), ("BA1", 2021)]


def test_fd_violations_detect_and_clear(spark):
    raw = incident_reports(spark, SF_SMALL)
    before = quality.fd_violations(raw, S.key, S.attributes).collect()
    assert before and all(r["n_bad_keys"] > 0 for r in before)
    after = quality.fd_violations(entity.split_references(raw, S), S.ref, S.attributes)
    assert after.count() == 0


def test_collision_report(spark):
    base = ("F", "1-URGENT", "1 to 9", "BUILDING", "Less than 24 hours")
    rows = [("X", 2020, "Qtr 1", "s", "LARGE", *base),
            ("X", 2021, "Qtr 1", "s", "LARGE", *base),
            ("XA1", 2020, "Qtr 1", "s", "LARGE", *base)]
    df = spark.createDataFrame(rows, S.struct_type())
    got = [(r["ref"], r["units"]) for r in entity.id_collisions(df, S).collect()]
    assert got == [("XA1", 2)]


def test_preprocess_raises_on_collision(spark):
    rows = [report("X", 2020, "Qtr 1", URGENT), report("X", 2021, "Qtr 1", URGENT), report("XA1", 2020, "Qtr 1", URGENT)]
    df = spark.createDataFrame([(*r[:3], "Brand#11", "STANDARD ANODIZED TIN", *r[5:]) for r in rows], S.struct_type())
    with pytest.raises(ValueError, match="1 incident ids stand for several incidents, e.g. 'XA1'.*year"):
        P.preprocess(df, S, encode=False, impute_missing=False)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_broadcast_no_table(spark):
    """Orders, customers and parts grow with the line items: none goes
    through the driver, however small its file is."""
    assert "Broadcast" not in _plan(incident_reports(spark, SF_SMALL))


def test_units_are_grouped_by_codes(spark):
    raw = incident_reports(spark, SF_SMALL)
    keys = [line.split("keys=[")[1].split("], functions")[0] for line in _plan(entity.incident_units(raw, S, True)).splitlines() if "keys=[" in line]
    assert keys and not any(f"{f}#" in k for k in keys for f in S.split_fields)


def test_units_of_unlisted_levels_and_nulls(spark):
    """Codes keep nulls, unlisted levels and listed ones apart."""
    values = [None, "", "Unlisted", "other", "F", "O"]
    rows = [report("A", 2020, p, (a, "2-HIGH", b, "BUILDING", c), subject=x)
            for p in ("Qtr 1", "Qtr 9", None) for a in values for b in (None, "1 to 9", "many") for c in (None, "More than 1 week") for x in ("s", "t", None)]
    df = spark.createDataFrame(rows * 2, S.struct_type())
    got = entity.incident_units(df, S, True)
    fields = ["_key", "_year", "_period", *S.split_fields]
    assert sorted(map(str, (tuple(r) for r in got.select(*fields, "_rows", S.subject_count_col).collect()))) == sorted(
        str((*k, 6, 3)) for k in {(r[0], r[1], r[2], *r[5:]) for r in rows})
    assert got.select(S.ref).distinct().count() == got.count()


def test_shuffles_are_bounded_by_the_rows(spark):
    """No partition of the reports' joins and groups grows with the tables."""
    from ordinal_spark.session import SHUFFLE_BYTES, SHUFFLE_ROWS, bound_shuffles
    from ordinal_spark.sources.fixtures import incident_reports
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    held = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[1], "64m")
        incident_reports(spark, SF_SMALL)
        assert spark.conf.get(keys[1]) == str(SHUFFLE_BYTES) and spark.conf.get(keys[0]) == held[keys[0]]
        bound_shuffles(spark, 300 * SHUFFLE_ROWS - 1)
        assert spark.conf.get(keys[0]) == "300"
        spark.conf.set(keys[1], "512kb")
        bound_shuffles(spark, 10)  # neither fewer partitions nor larger ones
        assert spark.conf.get(keys[0]) == "300" and spark.conf.get(keys[1]) == "512kb"
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
