"""Operator 6 against a direct pass over all windows."""

import hashlib
import random

import pytest
from pyspark.sql import types as T

from ordinal_spark.llm.suffix_dedup import Levels, op6_suffix_array_dedup, remove_repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("bucket", T.StringType())])


def brute(rows, length):
    """rows: (doc_id, text) with unique ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_planted_repeats(spark):
    rnd = random.Random(3)
    prose = lambda n: "".join(rnd.choice("abcdé fghij klmno") for _ in range(n))
    shared = [prose(n) for n in (99, 100, 101, 250, 400, 900)]
    rows = []
    for d in range(60):
        t = prose(rnd.randrange(0, 400))
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, max(1, len(s) - 100))
            t += s[a:] + prose(rnd.randrange(0, 60)) if rnd.random() < 0.5 else s
        rows.append((d * 7 % 61, t))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, ""), (103, None), (104, shared[5]), (105, shared[5]), (106, "x" * 99)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(5)
    assert got(remove_repeats(df)) == brute(rows, 100)


def test_small_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    want = brute(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()), 100)
    df = op6_suffix_array_dedup(spark, "/root/testdata/sf0.001")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want


def test_edges(spark):
    t = "repeated text, long enough to count: " * 6
    rows = [(None, t, "a"), (1, t, "b"), (1, t, "b"), (2, t[3:], "c"), (2, "short", "c")]
    out = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    once = brute([(0, t)], 100)[0][1]
    assert out == [(-1, 222, once), (1, 222, 222), (1, 222, 222), (2, 5, 0), (2, 219, 219)]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sizes", [[5] * 40, [1, 30, 2, 2, 2, 64, 1]])
def test_levels_grow_geometrically(sizes):
    import numpy as np

    from ordinal_spark.llm.suffix_dedup import ENTRY

    family, at = Levels(), 0
    for n in sizes:
        e = np.zeros(n, ENTRY)
        e["code"], e["doc"] = np.arange(at, at + n), at
        at += n
        assert not len(family.add(e))
        lens = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(lens, lens[1:]))
    assert len(family.all()) == at
    again = np.zeros(3, ENTRY)
    again["code"], again["doc"] = [0, 1, at - 1], 10**6
    assert len(family.add(again)) == 3


def test_hot_line_with_different_neighbours(spark):
    rnd = random.Random(8)
    line = "All of this may be used by anybody who reads it and who passes it on to others, without any fee at all."
    rows = [(d, "".join(rnd.choice("abcdefg hij") for _ in range(rnd.randrange(150))) + line + "".join(rnd.choice("abcdefg hij") for _ in range(rnd.randrange(150)))) for d in range(500)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    assert got(remove_repeats(df)) == brute(rows, 100)


def test_unique_contexts_of_one_line_stay():
    import numpy as np
    import pyarrow as pa

    from ordinal_spark.llm import suffix_dedup as S

    n = 300_000  # 32 bits of a context's fingerprint agree for some of them
    rnd = np.random.default_rng(5)
    line = "All of this may be used by anybody who reads it and who passes it on, without any fee at all.."[:90]
    ends = rnd.integers(97, 123, (n, 10), np.uint8)
    texts = list({f"{b[:5].decode()}{line}{b[5:].decode()}" for b in map(bytes, ends)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "version", "text"])
    e = np.concatenate([x[0].copy() for x in S._scan(batch, 100, 24, 8)])
    assert len(e) == len(texts) and (np.unique(e["code"] & S.HIGH, return_counts=True)[1].max() > n // 2)
    first, again = S._split(e)
    assert len(first) == len(texts) and not len(again)
    family = Levels()
    for part in np.array_split(e, 7):
        assert not len(family.add(S._order(part)))
    kept = family.all()
    assert len(kept) == len(texts)
    again = e[::1000].copy()
    again["doc"] += 10**9
    later = family.add(S._order(again))
    assert sorted(later["doc"]) == sorted(again["doc"])
    same = np.flatnonzero(kept["code"][1:] == kept["code"][:-1])
    twins = kept[np.union1d(same, same + 1)].copy()  # contexts that share a code
    twins["doc"] += 10**9
    assert len(twins) and len(family.add(S._order(twins))) == len(twins)
