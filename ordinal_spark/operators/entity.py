"""Entity resolution: split re-used references (W1/W2), consolidate reports
into incidents (A1), records-per-key summaries (A2/A3).

Scale design. An *incident unit* is one distinct (reference, year, period,
five split fields). Every operator here first reduces report rows to units
with a map-side partial aggregate, so a reference that holds a third of all
rows is collapsed before any shuffle. The only window (dense rank of units per
reference) runs on the unit table; after domain validation (V1/V2) the split
fields are closed lists, so the number of units per reference is bounded by
periods x product of the domain sizes, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, map_literal, null_text, score_lookup
from ..schema import SeveritySchema
from ..session import cut_lineage

_K, _Y, _P = "_key", "_year", "_period"


def _packed_units(df: DataFrame, s: SeveritySchema) -> tuple[list, list]:
    """(grouping columns, output columns) of the units, for small group keys.

    The listed levels of the text fields become codes in one long, ``_codes``;
    code 0 (a null or a level that is not listed) has its value in the struct
    ``_other``, which is null when all levels are listed. Fields without a list
    are grouped as they are.
    """
    names = {s.period: _P, **{f: f for f in s.split_fields}}
    codes, other, plain, back, place = F.lit(0).cast("long"), [], [], {}, 0
    for f, name in names.items():
        levels = list(dict.fromkeys(s.ordinals[f].levels if f in s.ordinals else s.domains.get(f, ())))
        width = len(levels).bit_length()
        if not levels or place + width > 62 or not isinstance(df.schema[f].dataType, T.StringType):
            plain.append(col(f).alias(name))
            back[name] = col(name)
            continue
        code = F.coalesce(F.try_element_at(map_literal({v: i for i, v in enumerate(levels, 1)}), col(f)), F.lit(0))
        codes = codes + F.shiftleft(code.cast("long"), place)
        other.append((name, code, col(f)))
        held = F.shiftright("_codes", place).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        back[name] = F.when(held > 0, F.get(F.array(*[F.lit(v) for v in levels]), held - 1)).otherwise(F.col("_other")[name])
        place += width
    grouped = [col(s.key).alias(_K), col(s.year).alias(_Y), *plain]
    if other:
        unlisted = F.lit(False)
        for _, code, _ in other:
            unlisted = unlisted | (code == 0)
        grouped += [codes.alias("_codes"), F.when(unlisted, F.struct(*[F.when(code == 0, v).alias(n) for n, code, v in other])).alias("_other")]
    return grouped, [F.col(_K), F.col(_Y), *[back[n].alias(n) for n in names.values()]]


def _rank_units(units: DataFrame, s: SeveritySchema) -> DataFrame:
    """Dense rank of units inside each reference, in the original's order:
    year as text, period, then the '_'-joined field values ('nan' for null)."""
    fields = F.concat_ws("_", *[null_text(col(f)) for f in s.split_fields])
    w = Window.partitionBy(_K).orderBy(null_text(F.col(_Y).cast("string")), null_text(F.col(_P)), fields)
    rk = F.dense_rank().over(w)
    new_id = F.when(rk == 1, F.col(_K)).otherwise(
        F.concat(F.col(_K), F.lit("A"), (rk - 1).cast("string")))
    return units.withColumn("_rk", rk).withColumn(s.ref, new_id)


def incident_units(df: DataFrame, s: SeveritySchema, with_aggregates: bool = False) -> DataFrame:
    """One row per incident unit with its rank ``_rk`` and new id ``ref``.

    Rows whose key is null are never split (the original's group-by drops
    them) and are left out here; a null year or period is a value like any
    other and sorts as 'nan'.
    """
    base = df.where(col(s.key).isNotNull())
    grouped, unit = _packed_units(base, s)
    g = base.groupBy(*grouped)
    if with_aggregates:
        dt = col(s.data_type)
        small = len(s.scores) <= 62  # a long holds them: the aggregate stays hash-based
        bits = map_literal({t: 1 << i for i, t in enumerate(sorted(s.scores))}) if small else None
        scored = F.when(score_lookup(dt, s.scores) > 0, dt)
        st = col(s.subject_type)
        units = g.agg(
            F.count(F.lit(1)).alias("_rows"),
            # one bit for each scored type
            F.bit_or(F.coalesce(F.try_element_at(bits, dt), F.lit(0).cast("long"))).alias("_types") if small else
            F.collect_set(scored).alias("_types"),
            (F.count_distinct(st) + F.max(st.isNull().cast("int"))).cast("bigint")
            .alias(s.subject_count_col),
        ).select(*unit, "_rows", "_types", s.subject_count_col)
    else:
        units = g.agg(F.count(F.lit(1)).alias("_rows")).select(*unit, "_rows")
    return _rank_units(units, s)


def split_references(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """Report rows with the incident id ``ref`` in place of the key.

    The first unit of a reference keeps the id, the n-th later unit becomes
    ``<id>A<n>``. Rows are matched to their unit by a null-safe equi-join on
    the unit columns; AQE broadcasts the unit table when its measured size is
    small and splits skewed units otherwise.
    """
    units = incident_units(df, s).select(_K, _Y, _P, *[col(f) for f in s.split_fields], s.ref)
    u = units.alias("u")
    r = df.alias("r")
    cond = [F.col(f"r.`{s.key}`").eqNullSafe(F.col(f"u.{_K}")),
            F.col(f"r.`{s.year}`").eqNullSafe(F.col(f"u.{_Y}")),
            F.col(f"r.`{s.period}`").eqNullSafe(F.col(f"u.{_P}"))]
    cond += [F.col(f"r.`{f}`").eqNullSafe(F.col(f"u.`{f}`")) for f in s.split_fields]
    joined = r.join(u, cond, "left")
    out = [F.coalesce(F.col(f"u.{s.ref}"), F.col(f"r.`{s.key}`")).alias(s.ref)]
    out += [F.col(f"r.`{c}`").alias(c) for c in s.raw_columns if c != s.key]
    return joined.select(out)


def split_statistics(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """Rows re-labelled, and how many units were split off because of a
    different period versus different field values within the same period."""
    units = incident_units(df, s)
    per_period = Window.partitionBy(_K, _Y, _P)
    u = units.withColumn("_units_in_period", F.count(F.lit(1)).over(per_period))
    later = F.col("_rk") > 1
    return u.agg(
        F.coalesce(F.sum(F.when(later, F.col("_rows"))), F.lit(0)).cast("bigint").alias("rows_modified"),
        F.count_if(later & (F.col("_units_in_period") == 1)).cast("bigint").alias("period_splits"),
        F.count_if(later & (F.col("_units_in_period") > 1)).cast("bigint").alias("field_splits"),
        F.count(F.lit(1)).cast("bigint").alias("incidents"),
    )


def id_collisions(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """New ids produced by more than one unit (e.g. 'X' unit 2 -> 'XA1' while
    a reference 'XA1' also exists). The original silently merges these."""
    units = incident_units(df, s)
    return (units.groupBy(s.ref).agg(F.count(F.lit(1)).cast("bigint").alias("units"))
            .where(F.col("units") > 1))


def zscore(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """P5: (x - mean) / std with ddof=1 over all rows; one-row statistics are
    attached by a broadcast cross join (size 1 by construction)."""
    out = out or c
    stats = df.agg(F.avg(col(c)).alias("_mu"), F.stddev_samp(col(c)).alias("_sd"))
    z = F.try_divide(col(c) - F.col("_mu"), F.col("_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z).drop("_mu", "_sd")


def consolidate(df: DataFrame, s: SeveritySchema, standardise: bool = True,
                pin: bool = True) -> DataFrame:
    """A1 (after W1): one row per incident.

    Per incident: sum of the scores of its distinct data types, number of
    distinct subject types (null counts as one), and its period and field
    values. The unit columns are exactly the attributes the original keeps with
    ``first`` (and proves unique per id), so no second pass is needed. One
    grouped aggregate with map-side combine, one rank window on units.
    """
    units = incident_units(df, s, with_aggregates=True)
    if len(s.scores) <= 62:
        raw = sum(((F.shiftright("_types", i).bitwiseAND(F.lit(1).cast("long")) * F.lit(int(s.scores[t])))
                   for i, t in enumerate(sorted(s.scores))), F.lit(0).cast("bigint")).cast("bigint")
    else:
        score_map = map_literal(dict(s.scores))
        raw = F.aggregate(F.col("_types"), F.lit(0).cast("bigint"),
                          lambda acc, t: acc + F.try_element_at(score_map, t).cast("bigint"))
    out = units.select(
        F.col(s.ref),
        raw.alias("raw_score"),
        F.col(s.subject_count_col),
        F.col(_Y).alias(s.year),
        F.col(_P).alias(s.period),
        *[col(f) for f in s.split_fields],
    )
    if standardise:
        # pinned once: the one-row mean/std and every later consumer read the
        # incident table instead of re-running scan + joins + aggregation
        out = cut_lineage(out) if pin else out
        out = zscore(out.withColumn(s.score_col, F.col("raw_score").cast("double")), s.score_col)
        out = out.select(s.ref, "raw_score", s.score_col, s.subject_count_col, s.year, s.period,
                         *s.split_fields)
    return out


def records_per_key(df: DataFrame, key: str) -> DataFrame:
    """A2: number of keys, keys with more than one record, max and mean."""
    per = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_incidents"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("incidents_with_multiple_records"),
        F.max("n").cast("bigint").alias("max_records_per_incident"),
        F.avg("n").alias("avg_records_per_incident"),
    )


def varying_attributes(df: DataFrame, key: str) -> DataFrame:
    """A3: per column, how many multi-record keys hold more than one distinct
    value (null is a value). Columns that never vary are absent.

    "More than one distinct value" is ``min != max`` of the values' 64-bit
    hashes or (a null and a non-null), so this is one hash aggregate (no
    distinct aggregation, no row expansion) with map-side combine.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = F.when(col(c).isNotNull(), F.xxhash64(col(c)))
        aggs += [F.min(x).alias(f"_mn{i}"), F.max(x).alias(f"_mx{i}"),
                 F.count(x).alias(f"_nn{i}")]
    per = df.groupBy(col(key).alias("_key_")).agg(*aggs).where(F.col("_n") > 1)
    flags = []
    for i, c in enumerate(cols):
        varies = ((F.col(f"_mn{i}") != F.col(f"_mx{i}"))
                  | ((F.col(f"_nn{i}") > 0) & (F.col(f"_nn{i}") < F.col("_n"))))
        flags.append(F.count_if(F.coalesce(varies, F.lit(False))).cast("bigint").alias(f"_v{i}"))
    counts = per.agg(*flags)
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("n_incidents"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return stacked.where(F.col("n_incidents") > 0)
