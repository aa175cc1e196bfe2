"""Operator 7: mixing sources to target weights. Expressions, joins and windows
only; no Python runs on the rows.

A source with a share p of all tokens (words) gets the weight p ** a / sum.
Smaller exponents flatten the mixture. Bisection finds the largest exponent
whose mixture has at least ``entropy`` of the largest possible entropy, and the
smallest whose most repeated source is repeated at most ``repeats`` times as
often as the least; the larger of the two is taken, rounded to six digits.

The weights are realised as blocks. A budget of B tokens gives a source B * w:
so many whole permutations of its documents as fit (one block each, in an
order of its own, by md5 of seed, block and doc_id), and a last block that ends
before the document that would exceed the rest. Without a budget, B is the
smallest that shows every document once, so nothing is left out.

The end of a last block is found without ordering a source in one task: token
sums by source and the first three digits of the order (pre-aggregated) find
the one part of 4,096 in which the block ends, and only that is ordered. Each
document is then kept or not by comparing its order with its source's end.
Tables of one row a source are broadcast up to ``MAX_SOURCES`` rows.

Null sources count as the source ''. Null texts have 0 tokens; a source
without tokens, and a row whose id is null, is shown once. Rows with one doc_id
share their place in a block's order and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import documents, written

ENTROPY, REPEATS, SEED, MAX_SOURCES = 0.95, 2.0, 17, 100_000
STEPS, PART = 50, 3


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, block: Column, seed: int) -> Column:
    """Hex digits that order the documents of a block."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), doc_id.cast("string"))), 1, 15)


def exponent(shares: DataFrame, entropy: float, repeats: float) -> DataFrame:
    """One row: the exponent for the shares ``p`` (a row a source)."""
    one = shares.agg(F.sort_array(F.collect_list("p")).alias("ps"))
    z = "aggregate(ps, 0D, (s, p) -> s + pow(p, (b.lo + b.hi) / 2))"
    h = f"(ln({z}) - (b.lo + b.hi) / 2 / {z} * aggregate(ps, 0D, (s, p) -> s + pow(p, (b.lo + b.hi) / 2) * ln(p)))"
    spread = "pow(array_max(ps) / array_min(ps), 1 - (b.lo + b.hi) / 2)"
    down = "IF({0}, named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi), named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2))"
    search = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> {down})"
    flat = search.format(f"{h} >= {entropy!r}D * ln(size(ps))")
    bound = search.format(f"{spread} > {float(repeats)!r}D")
    return one.select(F.expr(f"round(greatest(({flat}).lo, ({bound}).hi), 6)").alias("a"))


def plan(measured: DataFrame, entropy: float, repeats: float, budget: int | None, seed: int) -> DataFrame:
    """(src, weight, full, cutoff): whole blocks of each source, and up to which
    place its last block goes. ``measured``: (src, doc_id, n)."""
    totals = measured.groupBy("src").agg(F.sum("n").alias("t")).filter("t > 0")
    totals = written(totals.crossJoin(totals.agg(F.sum("t").alias("all"))).select("src", "t", "all", (F.col("t") / F.col("all")).alias("p")), "sources")
    a = exponent(totals, entropy, repeats).first()["a"]  # one number
    powered = totals.withColumn("v", F.pow("p", F.lit(1.0 if a is None else a)))
    norm = powered.agg(F.sum("v").alias("z"))
    weighted = powered.crossJoin(norm).withColumn("weight", F.col("v") / F.col("z"))
    need = weighted.agg(F.max(F.col("t") / F.col("weight")).alias("b"))
    weighted = weighted.crossJoin(need if budget is None else need.select(F.lit(float(budget)).alias("b")))
    # a hair above, so that the source that sets the budget gets all of it
    goal = F.floor(F.col("b") * F.col("weight") * F.lit(1 + 1e-12)).cast("long")
    goals = written(weighted.withColumn("goal", goal).select("src", "t", "weight", "goal", F.expr("goal div t").alias("full"), F.expr("goal % t").alias("rest")), "goals")
    small = F.broadcast(goals) if goals.count() <= MAX_SOURCES else goals
    placed = measured.join(small, "src").select("src", "rest", "full", "n", place(F.col("doc_id"), F.col("full"), seed).alias("place"))
    placed = written(placed.withColumn("part", F.substring("place", 1, PART)), "places")
    parts = placed.groupBy("src", "rest", "part").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy("src").orderBy("part"))
    ends = (parts.withColumn("upto", run).filter("upto > rest").groupBy("src").agg(F.min(F.struct("part", "upto", "n")).alias("x"))
            .select("src", F.col("x.part").alias("part"), (F.col("x.upto") - F.col("x.n")).alias("before")))
    ends = written(ends, "ends")
    inner = placed.join(F.broadcast(ends) if ends.count() <= MAX_SOURCES else ends, ["src", "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("src", "part").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inner.withColumn("upto", upto).filter("upto <= rest").groupBy("src").agg(F.max("place").alias("last"))
    # no place of the last part fits: all before it do
    cut = ends.join(last, "src", "left").select("src", F.coalesce("last", "part").alias("cutoff"))
    return goals.join(cut, "src", "left").select("src", "weight", "full", "cutoff")


def mix_sources(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with all its columns, a row for each block that shows it, and
    _block, _place (its order in the block), _tokens and _weight."""
    src, tokens = F.coalesce(F.col("source").cast("string"), F.lit("")), n_tokens(F.col("text").cast("string"))
    measured = written(docs.select(src.alias("src"), F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n")).filter("doc_id is not null"), "measured")
    goals = written(plan(measured, entropy, repeats, budget, seed).select(*[F.col(c).alias(f"_{c}") for c in ("src", "weight", "full", "cutoff")]), "plan")
    small = F.broadcast(goals) if goals.count() <= MAX_SOURCES else goals
    rows = docs.withColumn("_s", src).join(small, F.col("_s") == F.col("_src"), "left")
    once = F.col("_src").isNull() | F.col("doc_id").isNull()
    here = place(F.col("doc_id").cast("long"), F.col("_full"), seed)
    # a cutoff of three digits stands for the begin of its part
    last = F.col("_cutoff").isNotNull() & F.when(F.length("_cutoff") == PART, F.substring(here, 1, PART) < F.col("_cutoff")).otherwise(here <= F.col("_cutoff"))
    n_blocks = F.when(once, F.lit(1).cast("long")).otherwise(F.col("_full") + last.cast("long"))
    rows = rows.withColumn("_n", n_blocks).filter("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return rows.select(*docs.columns, "_block", place(F.col("doc_id").cast("long"), F.col("_block"), seed).alias("_place"), tokens.alias("_tokens"), "_weight")


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_block").alias("block"), F.col("_place").alias("place"),
                      F.round("_weight", 9).alias("weight"))


QUERIES = {"op7_temperature_mixing": op7_temperature_mixing}
ORACLE = {"op7_temperature_mixing": rf"""
WITH RECURSIVE m AS (SELECT doc_id, source, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
t AS (SELECT src, sum(n)::BIGINT AS t FROM m WHERE doc_id IS NOT NULL GROUP BY src HAVING sum(n) > 0),
s AS (SELECT src, t, t / (SELECT sum(t) FROM t)::DOUBLE AS p FROM t),
flat AS (SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi UNION ALL
    SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
        SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid,
            ln(sum(pow(p, mid))) - sum(mid * pow(p, mid) * ln(p)) / sum(pow(p, mid)) >= {ENTROPY} * ln(count(*)) AS ok
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM flat WHERE i < {STEPS}), s GROUP BY i)),
bound AS (SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi UNION ALL
    SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
        SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, pow(max(p) / min(p), 1 - any_value(mid)) > {REPEATS} AS ok
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM bound WHERE i < {STEPS}), s GROUP BY i)),
a AS (SELECT round(greatest((SELECT lo FROM flat WHERE i = {STEPS}), (SELECT hi FROM bound WHERE i = {STEPS})), 6) AS a),
w AS (SELECT src, t, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM s, a),
g AS (SELECT *, floor(max(t / weight) OVER () * weight * (1 + 1e-12))::BIGINT AS goal FROM w),
g2 AS (SELECT src, weight, goal // t AS whole, goal % t AS rest FROM g),
placed AS (SELECT m.*, weight, whole, rest, substr(md5('{SEED}:' || whole || ':' || doc_id), 1, 15) AS place FROM m LEFT JOIN g2 USING (src)),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY src, doc_id IS NULL ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest AS more FROM placed),
shown AS (SELECT *, unnest(range(CASE WHEN weight IS NULL OR doc_id IS NULL THEN 1 ELSE whole + more::INT END)) AS block FROM ranked)
SELECT doc_id, source, n AS n_tokens, block::BIGINT AS block,
    substr(md5('{SEED}:' || block || CASE WHEN doc_id IS NULL THEN '' ELSE ':' || doc_id END), 1, 15) AS place, round(weight, 9) AS weight
FROM shown"""}
