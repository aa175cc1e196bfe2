"""Column-expression helpers (all JVM-side, no Python on the data path)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by name, safe for names with spaces or dots."""
    return F.col(f"`{name}`")


def map_literal(mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def score_lookup(c: Column, scores: Mapping[str, int]) -> Column:
    """Level -> severity score; unknown level or null -> 0."""
    return F.coalesce(F.try_element_at(map_literal(scores), c), F.lit(0))


def ordinal_code(c: Column, mapping: Mapping[str, int]) -> Column:
    """Level -> ordinal code; unmapped level -> null."""
    return F.try_element_at(map_literal(mapping), c).cast("int")


def null_text(c: Column) -> Column:
    """Text of a value as the original joined it: a null is the text 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def composite_key(cols: Sequence[Column], sep: str = "_") -> Column:
    """Separator-joined key; null propagates (the pandas '+' behaviour)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(c.cast("string"))
    return F.concat(*parts)


def is_unknown(c: Column, labels: Sequence[str]) -> Column:
    """True when the value is one of the sentinel labels (null -> False)."""
    return F.coalesce(c.isin(*labels), F.lit(False))


def dummy_exprs(name: str, levels: Sequence[str], dropped: str | None) -> list[Column]:
    """One 0/1 double column ``<name>_<level>`` per kept level; null -> 0."""
    c = col(name)
    return [F.when(c == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{name}_{lvl}")
            for lvl in levels if lvl != dropped]


def dummy_decode(name: str, levels: Sequence[str], dropped: str) -> Column:
    """Inverse of ``dummy_exprs``; all zeros -> the dropped level, else the
    first level holding the row maximum (dummies are 0/1, so the first 1)."""
    kept = [lvl for lvl in levels if lvl != dropped]
    if not kept:
        return F.lit(dropped).alias(name)
    dcols = [col(f"{name}_{lvl}") for lvl in kept]
    mx = F.greatest(*dcols) if len(dcols) > 1 else dcols[0]
    first_max = F.coalesce(*[F.when(d == mx, F.lit(lvl)) for d, lvl in zip(dcols, kept)])
    return F.when(mx <= 0, F.lit(dropped)).otherwise(first_max).alias(name)


def clamp_round(c: Column, low: float = 1.0, high: float | None = None) -> Column:
    """Clamp, then round half to even (numpy rounding), as int."""
    x = F.greatest(c, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return F.bround(x, 0).cast("int")
