"""Operator 2 against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import types as T

from ordinal_spark.llm.jaccard_join import band, jaccard_components, op2_partenum_jaccard, spoiled

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("key", T.StringType())])


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        for j in {j for x in a for j in holders[x] if j > i}:
            b = sets[j]
            if 100 * len(a & b) >= 75 * len(a | b):
                root[top(j)] = top(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(seed, groups, most):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 36, 40, 45, 60, 90, 130, 200, 400]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.randrange(1, most)):
            t = list(base)
            for _ in range(rnd.randrange(0, 1 + len(t) // 25)):
                i = rnd.randrange(len(t))
                rnd.choice([lambda: t.__setitem__(i, rnd.choice(words)), lambda: t.insert(i, rnd.choice(words)), lambda: t.pop(i) if len(t) > 1 else None])()
            rows.append((0, " ".join(t) if rnd.random() < 0.5 else "\n".join(t).upper()))
    rnd.shuffle(rows)
    return [(3 * i + 1, t) for i, (_, t) in enumerate(rows)]


def test_random_groups(spark):
    rows = corpus(1, 70, 9) + [(0, ""), (2, None), (None, "w1 w2"), (5, "w1\tW2"), (10**12, " \n ")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], SCHEMA).repartition(6)
    assert got(jaccard_components(df)) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for d in range(400):
        t = list(base)
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((d, " ".join(t)))
    rows += [(1000 + d, " ".join(base[:50] + [f"y{rnd.randrange(10**6)}" for _ in range(60)])) for d in range(80)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], SCHEMA).repartition(3)
    assert got(jaccard_components(df)) == brute(rows)


def test_small_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert got(op2_partenum_jaccard(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_empty_and_repeated(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(4, "a b c d e f")] * 3 + [(4, "other words")]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)
    assert got(jaccard_components(df)) == [(4, 1, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4)]


def test_bounds_hold_for_all_small_sizes():
    for a in range(1, 200):
        for b in range(a, a * 100 // 75 + 1):
            differ = (a + b) * 25 // 175
            assert differ <= min(spoiled(np.array([a, b]), 75, 100))
            bands = {int(band(np.array([x]))[0]) for x in (a, a * 100 // 75)}
            assert int(band(np.array([b]))[0]) in bands


def test_tiles_of_a_group(spark, monkeypatch):
    from ordinal_spark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rows = corpus(4, 25, 40)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], SCHEMA).repartition(3)
    assert got(jaccard_components(df)) == brute(rows)
