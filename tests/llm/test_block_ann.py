"""Operator 1 against all cosines in double precision."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F, types as T

from ordinal_spark.llm import block_ann
from ordinal_spark.llm.block_ann import Heaps, Quantised, _block, nearest, op1_block_matrix_ann, tile

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType()), T.StructField("dim", T.StringType())])


def brute(rows, ask, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = []
    for q, a in ok:
        if not ask(q):
            continue
        s = sorted(((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), c) for c, b in ok if c != q and len(a) == len(b)))
        s = sorted((round(x, 12), c) for x, c in s)[:k]
        out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def same(df, want):
    got = sorted(map(tuple, df.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12, rtol=0)


def test_small_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    same(op1_block_matrix_ann(spark, "/root/testdata/sf0.01"), brute(rows, lambda q: q % 50 == 0))


def test_edges_and_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(block_ann, "ROWS", 60)
    monkeypatch.setattr(block_ann, "QUERY_ROWS", 7)
    monkeypatch.setattr(block_ann, "TILES", 2)
    rnd = np.random.default_rng(4)
    vec = lambda d=8: rnd.normal(size=d).astype(np.float32).tolist()
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(300)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8),
             (None, vec()), (1250, []), (1300, vec(3)), (1350, vec(3)), (1400, vec(2)), (0, hot), (50, rows[50][1]),
             (1450, [1e-30] * 8), (1500, [3e38] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    same(nearest(df, F.col("id") % 50 == 0), brute(rows, lambda q: q % 50 == 0))
    assert nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=(40, 64)), rnd.normal(size=(3000, 64))
    q, c = Quantised(_block(a, np.arange(40))), Quantised(_block(b, np.arange(3000)))
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    estimate = (q.product @ c.product.T) * q.scale[:, None] * c.scale
    assert (np.abs(true - estimate) <= q.coarse[:, None] * c.rest + q.rest[:, None] + 1e-6).all()
    heaps = Heaps(q.ids, 6)
    assert tile(q, c, heaps) < 40 * 3000 * 0.02  # few pairs are recomputed
    assert [sorted(-x for _, x in h) for h in heaps.heaps] == [sorted(np.argsort(-r)[:6].tolist()) for r in true]


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """One large block holds all queries: what is sent of it is many times what
    a size estimate of its rows says."""
    monkeypatch.setattr(block_ann, "ROWS", 16)
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    out = nearest(df, F.col("id") % 50 == 0)
    same(out, brute(rows, lambda q: q % 50 == 0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    above = final[:final.index("FlatMapGroupsInArrow")].splitlines()
    tiles = next(i for i, line in enumerate(above) if "MapInArrow" in line)
    assert not any("Join" in line for line in above[tiles:]), "\n".join(above[tiles:])


def test_components_that_are_no_floats_stay_exact():
    v = np.array([[0.1, 1e300], [1.0, 2.0]])
    assert np.array_equal(block_ann._unblock(_block(v, np.arange(2)))[1], v)
    assert np.array_equal(block_ann._unblock(_block(v[1:], np.arange(1)))[1], v[1:])
