"""Encoding and cleaning: P2/P3/P4 encoders, P6 years since start, P8
unknown -> null indicator, F1 sequential low-share-unknown filter."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, dummy_decode, dummy_exprs, is_unknown, ordinal_code
from ..schema import SeveritySchema


@dataclass(frozen=True)
class DummySpec:
    """Level metadata of one dummy-encoded column (never guessed back)."""

    column: str
    levels: tuple[str, ...]      # sorted levels known when encoding
    dropped: str                 # first level, dropped (drop_first)
    kept: tuple[str, ...]        # levels that got a column (non-zero ones)

    @property
    def columns(self) -> list[str]:
        return [f"{self.column}_{lvl}" for lvl in self.kept]


def observed_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column (one small job; callers use
    it on validated columns, so the result is bounded by the domains)."""
    if not cols:
        return {}
    pairs = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in cols]))
        .alias("s")).select("s.*").where(F.col("v").isNotNull()).distinct().collect())
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in pairs:
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def ordinal_encode(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """Every ordinal column replaced by its code (unmapped -> null)."""
    return df.withColumns({c: ordinal_code(col(c), spec.mapping) for c, spec in s.ordinals.items()})


def plan_dummies(df: DataFrame, s: SeveritySchema,
                 load_levels: Mapping[str, Sequence[str]] | None = None) -> list[DummySpec]:
    """Decide the dummy columns (P3): levels sorted, first dropped, columns
    whose level no longer occurs removed. Category columns take their level
    list from load time (``load_levels``), plain text columns from the data
    now. One small job: which levels are present."""
    load_levels = load_levels or {}
    current = observed_levels(df, list(s.dummies))
    specs = []
    for c in s.dummies:
        levels = sorted(load_levels.get(c) or current[c])
        if not levels:
            continue
        present = set(current[c])
        kept = tuple(lvl for lvl in levels[1:] if lvl in present)
        specs.append(DummySpec(c, tuple(levels), levels[0], kept))
    return specs


def dummy_encode(df: DataFrame, specs: Sequence[DummySpec]) -> DataFrame:
    """P3 as a projection: source columns replaced by 0/1 doubles, appended
    at the end in the original's order."""
    src = {sp.column for sp in specs}
    keep = [col(c) for c in df.columns if c not in src]
    dums = []
    for sp in specs:
        dums += dummy_exprs(sp.column, [sp.dropped, *sp.kept], sp.dropped)
    return df.select(*keep, *dums)


def dummy_decode_all(df: DataFrame, specs: Sequence[DummySpec]) -> DataFrame:
    """Dummy columns back to one level column each (stored metadata)."""
    drop = [c for sp in specs for c in sp.columns]
    decoded = [dummy_decode(sp.column, sp.kept, sp.dropped) if sp.kept
               else F.lit(sp.dropped).alias(sp.column) for sp in specs]
    return df.select(*[col(c) for c in df.columns if c not in drop], *decoded)


def years_since_start(df: DataFrame, s: SeveritySchema) -> DataFrame:
    """Year - min(year) as ``years_since_start``; the year is dropped.
    The one-row minimum is attached by a broadcast cross join."""
    m = df.agg(F.min(col(s.year)).alias("_y0"))
    out = df.crossJoin(F.broadcast(m)).withColumn(s.years_col, (col(s.year) - F.col("_y0")).cast("int"))
    return out.drop("_y0", s.year)


def unknown_indicator(df: DataFrame, column: str, sentinels: Sequence[str] = ("Unknown",)
                      ) -> DataFrame:
    """Sentinel labels -> null, plus a 0/1 ``<column>_missing`` column."""
    c = col(column)
    nulled = F.when(~is_unknown(c, sentinels), c)
    return (df.withColumn(column, nulled)
            .withColumn(f"{column}_missing", col(column).isNull().cast("int")))


@dataclass(frozen=True)
class UnknownDecision:
    step: int
    column: str
    share: float
    dropped: bool
    rows_after: int


def low_share_unknown_plan(df: DataFrame, cols: Sequence[str],
                           labels: Sequence[str] = ("Unknown", "Unassigned"),
                           threshold: float = 0.05) -> list[UnknownDecision]:
    """F1 decisions. Shares depend on earlier removals, but the joint counts
    of the unknown masks (at most 2^len(cols) rows, one job) hold all the
    information the sequence needs; the walk itself is over that tiny table."""
    masks = df.groupBy(*[is_unknown(col(c), labels).alias(f"_u{i}") for i, c in enumerate(cols)]
                       ).agg(F.count(F.lit(1)).alias("n")).collect()
    alive = [(tuple(bool(r[f"_u{i}"]) for i in range(len(cols))), int(r["n"])) for r in masks]
    out = []
    for i, c in enumerate(cols):
        total = sum(n for _, n in alive)
        unk = sum(n for m, n in alive if m[i])
        share = unk / total if total else 0.0
        drop = 0 < share < threshold
        if drop:
            alive = [(m, n) for m, n in alive if not m[i]]
        out.append(UnknownDecision(i + 1, c, share, drop, sum(n for _, n in alive)))
    return out


def drop_low_share_unknowns(df: DataFrame, cols: Sequence[str],
                            labels: Sequence[str] = ("Unknown", "Unassigned"),
                            threshold: float = 0.05
                            ) -> tuple[DataFrame, list[UnknownDecision]]:
    """remove the unknown rows of every column whose unknown share is
    strictly between 0 and ``threshold`` (sequentially, in column order).
    The result is ONE plain filter on the input (pushed down by Catalyst)."""
    plan = low_share_unknown_plan(df, cols, labels, threshold)
    dropped = [d.column for d in plan if d.dropped]
    if not dropped:
        return df, plan
    cond = F.lit(False)
    for c in dropped:
        cond = cond | is_unknown(col(c), labels)
    return df.where(~cond), plan


def encode(df: DataFrame, s: SeveritySchema,
           load_levels: Mapping[str, Sequence[str]] | None = None
           ) -> tuple[DataFrame, list[DummySpec]]:
    """Dummy + ordinal encoding of the cleaned incident table."""
    specs = plan_dummies(df, s, load_levels)
    return ordinal_encode(dummy_encode(df, specs), s), specs


def class_index(label: Column, classes: Sequence[int]) -> Column:
    """P10: the place (from 0) of a class label in the ordered ``classes``;
    null for labels that are not among them."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), label.cast("int"))
    return F.when(at > 0, at - 1).cast("int")


def class_label(index: Column, classes: Sequence[int]) -> Column:
    """P10: the class label at a place; inverse of ``class_index``."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index).cast("int")
