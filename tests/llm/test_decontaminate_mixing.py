"""Operators 3 and 7: DuckDB SQL, brute force, edges."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from ordinal_spark.llm import decontaminate as D, mixing as M

DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("h", T.StringType()), T.StructField("n_words", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize("module", [D, M])
def test_sql(spark, module):
    (name, query), = module.QUERIES.items()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = query(spark, DIR)
    want = con.sql(module.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.select(", ".join(got.columns)).fetchall()
    assert rows and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))


def grams(words, n):
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]


def brute(docs, items):
    """All windows of an item's size, not only those at shared shingles."""
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for k, x in items:
            v = (x or "").lower().split()
            if not v or not w:
                continue
            n = min(5, len(v))
            b = grams(v, n)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = grams(w[s:s + len(v)], n)
                c = sum(min(a.count(g), b.count(g)) for g in set(a))
                if a and c / (len(a) + len(b) - c) >= 0.75:
                    out.add((d, k))
    return out


def test_near_and_exact_leaks(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 9, 30, 50, 60])))) for i in range(30)] + [(90, None), (91, "  "), (None, "some other item of words")]
    docs = []
    for d in range(150):
        w = [rnd.choice(words) for _ in range(rnd.randrange(0, 90))]
        if rnd.random() < 0.6:
            leak = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.randrange(0, 3)):
                leak[rnd.randrange(len(leak))] = rnd.choice(words)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = leak
        docs.append((d, (" " if d % 2 else "\n").join(w)))
    docs += [(500, None), (501, ""), (None, items[5][1]), (502, items[4][1].upper()), (502, items[4][1].upper())]
    df = spark.createDataFrame([(d, t, "s", "h", "n") for d, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 60
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    hit = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in hit)
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def test_insertions_and_reorderings(spark):
    rnd = random.Random(17)
    fill = lambda k: [f"f{rnd.randrange(10**6)}" for _ in range(k)]
    items = [(i, " ".join(f"i{i}w{rnd.randrange(60)}" for _ in range(n))) for i, n in enumerate([100, 60, 60, 40, 25, 12, 100])]
    a, b = items[0][1].split(), items[1][1].split()
    docs = [(0, fill(30) + fill(4) + a[4:50] + fill(8) + a[50:96] + fill(4) + fill(30)), (1, fill(30) + b[30:] + b[:30] + fill(30)), (2, b[30:] + b[:30])]
    for d in range(3, 150):
        leak = rnd.choice(items)[1].split()
        at, size = rnd.randrange(len(leak)), rnd.randrange(1, 9)
        kind = d % 4
        if kind == 0:
            leak[at:at] = fill(size)
        elif kind == 1:
            leak = leak[at:] + leak[:at]
        elif kind == 2:
            del leak[at:at + size]
        else:
            leak = leak[:at] + leak[at // 2:]
        docs.append((d, fill(rnd.choice([0, 0, 3, 40])) + leak + fill(rnd.choice([0, 0, 3, 40]))))
    docs = [(d, " ".join(w)) for d, w in docs]
    df = spark.createDataFrame([(d, t, "s", "h", "n") for d, t in docs], DOCS).repartition(3)
    found = D.contaminated(df, spark.createDataFrame(items, ITEMS)).collect()
    want = brute(docs, items)
    assert {(0, 0), (1, 1), (2, 1)} < want and {(r["doc_id"], r["item_id"]) for r in found} == want
    best = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 3)) for r in found}
    assert best[0, 0] == (34, 0.778) and best[1, 1][1] == 0.867


def test_blocks_find_every_pair_within_the_radius(spark):
    rnd = np.random.default_rng(3)
    pairs = []
    for bits in list(range(0, D.RADIUS + 1)) * 4:
        a = int(rnd.integers(0, 2**63))
        b = a
        for p in rnd.choice(64, bits, replace=False):
            b ^= 1 << int(p)
        pairs.append((a - 2**63, (b % 2**64) - 2**63))
    df = spark.createDataFrame(pairs, "a long, b long")
    cut = lambda c: df.select("a", "b", F.col(c).alias("simhash")).select("a", "b", F.explode(D.blocks(D.RADIUS)).alias("x"))
    shared = cut("a").join(cut("b"), ["a", "b", "x"]).select("a", "b").distinct().count()
    assert shared == len(set(pairs))


def solve(tokens, entropy, repeats):
    p = np.array(list(tokens.values()), float) / sum(tokens.values())
    h = lambda a: -sum(x * math.log(x) for x in p**a / (p**a).sum())
    grid = np.linspace(0, 1, 20001)
    a1 = max((a for a in grid if h(a) >= entropy * math.log(len(p))), default=0)
    a2 = min(a for a in grid if (p.max() / p.min()) ** (1 - a) <= repeats)
    return max(a1, a2)


@pytest.mark.parametrize("entropy,repeats", [(0.95, 2.0), (0.9, 50.0), (1.0, 1.0)])
def test_exponent(spark, entropy, repeats):
    tokens = {"a": 900, "b": 200, "c": 90, "d": 30}
    shares = spark.createDataFrame([(v / 1220,) for v in tokens.values()], "p double")
    assert abs(M.exponent(shares, entropy, repeats).first()["a"] - solve(tokens, entropy, repeats)) < 1e-4


def corpus():
    rnd = random.Random(9)
    return [(i, " ".join(["w"] * rnd.randrange(0, 30)), ["hot", "hot", "mid", "rare", None][min(4, int(rnd.expovariate(0.7)))]) for i in range(1500)]


@pytest.mark.parametrize("budget", [None, 4000, 60000])
def test_blocks_fill_the_budget(spark, budget):
    rows = corpus() + [(None, "x y", "hot"), (9000, None, "mid"), (9001, "", "empty")]
    df = spark.createDataFrame([(*r, "h", "n") for r in rows], DOCS).repartition(5)
    out = M.mix_sources(df, budget=budget).collect()
    tokens = defaultdict(int)
    for d, t, s in rows:
        if d is not None:
            tokens[s or ""] += len((t or "").split())
    tokens.pop("empty")
    a = round(solve(tokens, M.ENTROPY, M.REPEATS), 4)
    z = sum((t / sum(tokens.values())) ** a for t in tokens.values())
    weight = {s: (t / sum(tokens.values())) ** a / z for s, t in tokens.items()}
    need = budget or max(t / weight[s] for s, t in tokens.items())
    shown = defaultdict(list)
    for r in out:
        if r["doc_id"] is not None and r["source"] != "empty":
            shown[r["source"] or "", r["_block"]].append(r)
    for s, t in tokens.items():
        goal = need * weight[s]
        used = sum(r["_tokens"] for (x, _), rs in shown.items() if x == s for r in rs)
        assert goal - 31 - 0.002 * goal <= used <= goal + 0.002 * goal  # up to one document
        mine = {d for d, _, x in rows if (x or "") == s and d is not None}
        blocks = sorted(b for x, b in shown if x == s)
        assert blocks == list(range(len(blocks)))
        for b in blocks[:-1]:
            assert {r["doc_id"] for r in shown[s, b]} == mine and len(shown[s, b]) == len(mine)
        last = {r["doc_id"]: r["_place"] for r in shown[s, blocks[-1]]}
        assert len(last) == len(shown[s, blocks[-1]])
        if budget is None:
            assert set().union(*({r["doc_id"] for r in shown[s, b]} for b in blocks)) == mine
    assert sum(r["doc_id"] is None for r in out) == 1 and sum(r["source"] == "empty" for r in out) == 1
    assert M.mix_sources(df.limit(0)).count() == 0
