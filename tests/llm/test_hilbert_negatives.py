"""Operator 13 against all inner products."""

import math

import numpy as np
from pyspark.sql import functions as F, types as T

from ordinal_spark.llm import hilbert_negatives as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("score", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("block", T.StringType())])


def brute(rows, anchors, positives=5, negatives=10):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        own[i] = min(own.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1]))
    out = []
    for a in filter(anchors, own):
        others = [b for b in own if b != a and len(own[b][1]) == len(own[a][1])]
        order = sorted(others, key=lambda b: (-score(a, b), b))
        for p in [b for b in order if own[b][0] == own[a][0]][:positives]:
            ps = score(a, p)
            fit = [b for b in order if own[b][0] != own[a][0] and 30 * ps <= 100 * score(a, b) <= 90 * ps]
            out += [(a, p, r + 1, b, ps, score(a, b)) for r, b in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)


def run(df):
    return sorted(map(tuple, H.hard_negatives(df, F.col("id") % 20 == 0).collect()))


def test_edges_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "ASKS", 3)
    monkeypatch.setattr(H, "ZONES", 2)
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(4, 6))
    vec = lambda i, d=6: (centre[i % 4][:d] + 0.5 * rnd.normal(size=d)).astype(np.float32).tolist()
    rows = [(i, vec(i), 0 if i % 3 == 0 else i % 4) for i in range(300)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(60)]  # one vector, many rows: ties
    rows += [(2000, None, 1), (2020, vec(1), None), (2040, [1.0, None] + [0.0] * 4, 1), (2060, [float("nan")] * 6, 1), (2080, [float("inf")] + [0.0] * 5, 2),
             (None, vec(2), 1), (2100, [], 1), (2120, vec(3, 3), 1), (2140, vec(2, 3), 2), (20, rows[40][1], 3), rows[7], rows[7], (2160, [0.0] * 6, 2)]
    df = frame(spark, rows)
    want = brute(rows, lambda i: i % 20 == 0)
    assert run(df) == want and len(want) > 200
    assert run(df.limit(0)) == []


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=4) * 3e6).astype(np.float32).tolist(), i % 2) for i in range(0, 200, 4)]
    assert run(frame(spark, rows)) == brute(rows, lambda i: i % 20 == 0)


def test_zone_maps_bound_and_prune():
    rnd = np.random.default_rng(6)
    a, b = rnd.integers(-90, 90, (30, 8)), rnd.integers(0, 60, (100, 8))
    low, high = H.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    true = a @ b.T
    assert (low[:, 0] <= true.min(axis=1)).all() and (true.max(axis=1) <= high[:, 0]).all()
    far = [np.arange(30), np.zeros(30, int), np.zeros(30, int), np.zeros(30, int), high[:, 0] + 1, np.full(30, 1 << 60), np.full(30, -1), a]
    zone = [np.array([7]), np.array([1]), np.array([2]), np.concatenate([b.min(axis=0), b.max(axis=0)])[None]]
    assert not H.possible(far, zone)[0].any()
    far[4] = high[:, 0]
    assert H.possible(far, zone)[0].all()


def test_neighbours_on_the_curve_are_neighbours_in_space():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = sorted(zip(H.hilbert_key(cells, 2), map(tuple, cells)))
    assert len({k for k, _ in order}) == 64
    steps = [sum(abs(x - y) for x, y in zip(p, q)) for (_, p), (_, q) in zip(order, order[1:])]
    assert set(steps) == {1}
