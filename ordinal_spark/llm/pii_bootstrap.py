"""Operator 4: personal data by bootstrapped contextual extraction.

Four base kinds are found by pattern in every whole text. They seed a
bootstrap for identifiers that no base pattern describes:

* Every identifier-like token (six or more characters with a digit or at sign)
  is an occurrence, as is every base span. Its lexical patterns are the last
  two and the last three words or marks before it.
* Patterns and distinct identifiers form a bipartite graph. Seeds score 1.
  A pattern's confidence in a kind is the score of that kind among its
  identifiers over their number plus one; it is trusted from ``CONFIDENCE``
  and ``SUPPORT`` distinct identifiers up. An identifier's score is the
  noisy-or of its trusted patterns; from ``ACCEPT`` up it counts as found and
  strengthens patterns in the next of ``ROUNDS`` rounds.
* Occurrences behind a trusted pattern whose identifier was found are added
  with the pattern's kind. Base spans stay as they are.

The graph is joined and aggregated by Spark; a common pattern is pre-aggregated
before its shuffle, and repeated identifiers count once. Nulls are empty texts.
Repeated rows are answered row by row. Matching one text is linear in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import documents, text_rows, written
from .text import flat

KINDS = ["email", "ip", "card", "phone"]
CONFIDENCE, SUPPORT, ACCEPT, ROUNDS = 0.8, 4, 0.8, 3

# the kinds' patterns; a look-behind and possessive runs only save retries that cannot succeed
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+@-]*+")
UNIT = re.compile(r"[^\W\d_]+|[^\w\s]")
LOOK_BACK = 80

SPANS = "array<struct<k:int,s:int,e:int>>"
FOUND = f"doc_id long, h long, base {SPANS}, seen array<struct<k:int,s:int,e:int,value:long,p2:long,p3:long>>"
_BASE = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
_SEEN = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.int64()), ("p2", pa.int64()), ("p3", pa.int64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from at sign to at sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)  # an address cannot begin before this sign any more
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind or -1, start, end, value, pattern of 2, pattern of 3) of the base
    spans and of identifier-like tokens apart from them."""
    taken = sorted((a, b) for _, a, b in base)
    found, i = [(k, a, b) for k, a, b in base], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in "._%+@-":
            b -= 1
        if b - a < 6 or not any("0" <= c <= "9" or c == "@" for c in text[a:b]):
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if any(x < b and a < y for x, y in taken[i:i + 8]):
            continue
        found.append((-1, a, b))
    out = []
    for k, a, b in found:
        units = [u.lower() for u in UNIT.findall(text[max(0, a - LOOK_BACK):a])]
        if len(units) < 2:
            continue
        name = lambda n: xxhash.xxh64_intdigest("\0".join([str(n), *units[-n:]])) - (1 << 63)
        out.append((k, a, b, xxhash.xxh64_intdigest(text[a:b]) - (1 << 63), name(2), name(3) if len(units) > 2 else None))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sign = np.zeros(256, bool)
    sign[48:58] = sign[ord("@")] = True
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        marks = np.flatnonzero(sign[data[offsets[0]:offsets[-1]]]) + offsets[0]
        some = np.searchsorted(marks, offsets[1:]) > np.searchsorted(marks, offsets[:-1])
        bases, seens = [], []
        for i, hit in enumerate(some):
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode() if hit else ""
            base = base_spans(text) if hit else []
            bases.append([dict(zip("kse", x)) for x in base])
            seens.append([dict(zip(("k", "s", "e", "value", "p2", "p3"), x)) for x in occurrences(text, base)] if hit else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(bases, _BASE), pa.array(seens, _SEEN)],
                                         names=["doc_id", "h", "base", "seen"])


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns: pattern, kind, confidence; found identifiers: value,
    kind, score) from edges (pattern, value, kind or -1 for unknown)."""
    seeds = edges.filter("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    found = seeds
    for _ in range(rounds):
        scored = edges.select("pattern", "value").join(found, "value", "left")
        each = scored.groupBy("pattern", "kind").agg(F.count("*").alias("m"), F.sum("score").alias("s"))
        kinds = each.groupBy("pattern").agg(F.sum("m").alias("n"), F.max(F.when(F.col("kind") >= 0, F.struct("s", (-F.col("kind")).alias("k"), "m"))).alias("best"))
        trusted = written(kinds.select("pattern", (-F.col("best.k")).alias("kind"), (F.col("best.s") / (F.col("n") + 1)).alias("confidence"), F.col("best.m").alias("m"))
                          .filter((F.col("confidence") >= CONFIDENCE) & (F.col("m") >= SUPPORT)).select("pattern", "kind", "confidence"), "patterns")
        belief = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        drawn = (edges.filter("kind < 0").select("pattern", "value").join(trusted, "pattern").groupBy("value", "kind").agg(belief.alias("score"))
                 .groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
                 .select("value", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")).filter(F.col("score") >= ACCEPT))
        found = written(seeds.unionByName(drawn.join(seeds.select("value"), "value", "left_anti")), "identifiers")
    return trusted, found


def _edges(seen: DataFrame) -> DataFrame:
    each = seen.select("k", "value", F.explode(F.array("p2", "p3")).alias("pattern")).filter("pattern is not null")
    return each.groupBy("pattern", "value").agg(F.max("k").alias("kind"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ``base`` and
    ``added`` spans (struct of kind number, start, end; in code points)."""
    rows = text_rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = written(rows.mapInArrow(_found, FOUND), "personal")
    seen = found.filter(F.size("seen") > 0).select("doc_id", "h", F.explode("seen").alias("x")).select("doc_id", "h", "x.*")
    edges = written(_edges(seen), "edges")
    trusted, values = bootstrap(edges)
    behind = (seen.filter("k < 0").withColumn("pattern", F.explode(F.array("p2", "p3"))).drop("k").join(trusted, "pattern")
              .join(values.select("value"), "value", "left_semi"))
    added = behind.groupBy("doc_id", "h", "s", "e").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    added = added.groupBy("doc_id", "h").agg(F.collect_list(F.struct((-F.col("b.k")).alias("k"), "s", "e")).alias("added"))
    added = added.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "added")
    none = F.array().cast(SPANS)
    return (found.select("doc_id", "h", "base").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
            .select("doc_id", "base", F.coalesce(F.col("added").cast(SPANS), none).alias("added")))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
                      F.sha2(_text(F.array_sort("base")), 256).alias("base_sha256"),
                      _text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op4_bootstrapped_pii": op4_bootstrapped_pii}
