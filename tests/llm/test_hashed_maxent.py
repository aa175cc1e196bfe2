"""Operator 12: exact counts, normalised probabilities, a checked gradient and
held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ordinal_spark.llm import hashed_maxent as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOW)), None]


def teaches(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def brute(rows):
    c = Counter()
    for i, t in rows:
        if teaches(i):
            c.update(tokens(t))
    n, v = c.total(), len(c)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, i is not None and not teaches(i), len(own), sum(c[w] > 0 for w in own), n, base))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, row string, score double").repartition(parts)


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], r[5])


def same(got, want):
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert all(r[6] <= 1e-6 for r in got)
    return got


def corpus(n=400, seed=2):
    """Every word follows from the last, but for some noise."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w, text = int(rnd.integers(50)), []
        for _ in range(int(rnd.integers(5, 60))):
            w = (w * 7 + 3) % 50 if rnd.random() < 0.9 else int(rnd.integers(50))
            text.append(f"Word{w}")
        out.append((i, " ".join(text)))
    return out


def test_counts_base_and_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT", 20)  # most words go by the join
    monkeypatch.setattr(M, "FLUSH", 15)
    long = "x" * 3000
    rows = corpus(60) + [(1000, None), (1001, ""), (1002, " \t\n"), (None, "word1 word2"), (1003, "never_seen " + long), (1004, long + "\x0bword1 " + long), (1005, "é É ß   word1")]
    rows += [rows[3], rows[3], (1006, "word1 " * 3000)]
    got = same(M.score_texts(frame(spark, rows)).collect(), brute(rows))
    again = same(M.score_texts(frame(spark, rows, 7)).collect(), brute(rows))
    assert np.allclose([r[6] for r in got], [r[6] for r in again], rtol=1e-6)  # rows may lie anywhere


def test_empty_and_nothing_to_learn_from(spark):
    assert M.score_texts(frame(spark, [(1, "a")]).limit(0)).count() == 0
    held = next(i for i in range(100) if not teaches(i))
    r = M.score_texts(frame(spark, [(held, "a b"), (None, None)])).orderBy("n_tokens").collect()
    assert [tuple(x) for x in r] == [(None, False, 1, 0, 0, 0.0, 0.0), (held, True, 3, 0, 0, 0.0, 0.0)]


def test_held_out_texts_score_better_than_base(spark):
    rows = M.score_texts(frame(spark, corpus())).where("held_out").collect()
    assert len(rows) > 20
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / n > 0.3


@pytest.fixture
def model():
    rnd = np.random.default_rng(3)
    counts = sorted(rnd.integers(1, 500, 2500).tolist(), reverse=True)
    voc = M.Vocabulary([f"w{i}".encode() for i in range(2499)] + [M.END], counts, sum(counts) + 70, 2600)
    m = M.Model(voc)
    m.classes[:], m.words[:] = rnd.normal(0, 0.3, m.classes.shape), rnd.normal(0, 0.3, m.words.shape)
    return m


def test_probabilities_sum_to_one(model):
    voc = model.voc
    for history in ([5, 9], [2400, -1 - M.LISTED]):
        every = np.array([[*history, w] for w in [*range(voc.listed), voc.listed]])
        begin = np.zeros(every.shape, bool)
        begin[:, 0] = True
        p = 10 ** model.log10(every.ravel(), begin.ravel()).reshape(every.shape)[:, -1]
        assert abs(p.sum() - 1) < 1e-4
    plain = M.Model(voc)
    codes = np.arange(voc.listed)
    assert np.allclose(plain.log10(codes, np.ones(len(codes), bool)), voc.base[:voc.listed], atol=1e-4)


def test_gradient_by_differences(model):
    rnd = np.random.default_rng(5)
    logits, at = rnd.normal(size=(6, 9)), rnd.integers(0, 9, 6)
    like = lambda x: M._taken(x.copy(), at).sum()
    g = M.gradient(logits.copy(), at)
    for i, j in [(0, 1), (3, int(at[3])), (5, 8)]:
        more, less = logits.copy(), logits.copy()
        more[i, j] += 1e-4
        less[i, j] -= 1e-4
        assert abs((like(more) - like(less)) / 2e-4 - g[i, j]) < 1e-3


def test_changes_travel_and_average():
    n = np.array([1, 0, 2], np.int32)
    body = np.arange(8, dtype="<f2").reshape(2, 4)
    own, total = M._sums(n.tobytes(), body.tobytes())
    assert own.tolist() == [1, 0, 2] and total.tolist() == [[0, 1, 2, 3], [0, 0, 0, 0], [8, 10, 12, 14]]
