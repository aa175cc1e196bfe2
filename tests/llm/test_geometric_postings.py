"""Operator 11 against a plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np

from ordinal_spark.llm import geometric_postings as G

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(LOW))


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def run(spark, docs, items, top=10):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rank string")
    return sorted(map(tuple, G.ranked(d, q, top).collect()), key=repr)


def corpus(n, seed=1):
    rnd = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)] + ["Été", "naïve", "λόγος"])
    share = 1 / np.arange(1, 64)
    return [(i, " ".join(rnd.choice(words, rnd.integers(1, 80), p=share / share.sum()))) for i in range(n)]


def test_edges_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(G, "SHARD_DOCUMENTS", 50)
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "SHORT", 3)
    monkeypatch.setattr(G, "BATCH_TERMS", 5)  # several indexes
    docs = corpus(400)
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # copies
    docs += [(2000, None), (2001, ""), (2002, " .,! "), (None, docs[4][1]), (2003, "W1-w2_W1"), docs[5], docs[5], (2004, "w7 " * 50_000 + "rareword")]
    items = [(1, "W1 w7, été rareword"), (2, docs[3][1]), (3, None), (4, "?!"), (5, "unseen"), (6, "w0"), (6, "w59"), (7, docs[5][1]), (None, "λόγος naïve"), (8, "w1 w1 w1")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) >= 60
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == []


def test_more_than_one_batch_of_words_equals_one(spark):
    docs = corpus(120, 2)
    items = [(i, docs[i][1]) for i in range(0, 120, 7)]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_text_pieces_end_at_terms(monkeypatch):
    monkeypatch.setattr(G, "PIECE", 7)
    text = "alpha beta,gamma--delta éé " * 9 + "x" * 40
    assert [w.decode() for some in G.terms_of(text) for w in some] == terms(text)


def test_summaries_bound_and_blocks_are_skipped():
    rnd = np.random.default_rng(4)
    n, width = 600, 80
    sizes = rnd.integers(1, 20, n)
    rows = [np.sort(rnd.choice(width, s, replace=False)) for s in sizes]
    flat, parts = np.concatenate(rows), rnd.integers(1, 1_000_000, sizes.sum())
    weights = rnd.integers(1, 9000, width)
    shard = G.Shard.from_bytes(G.build_shard(np.arange(n), sizes, flat, parts, weights).to_bytes())
    queries = [np.sort(rnd.choice(width, 6, replace=False)) for _ in range(40)]
    found, read = G.search_shard(shard, weights, queries, np.zeros(40, np.int64), 10)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), sizes), flat] = parts
    total = 0
    for q, ids, score in found:
        own = dense[:, queries[q]] @ weights[queries[q]]
        order = np.lexsort((np.arange(n), -own))[:10]
        assert ids.tolist() == order[own[order] > 0].tolist() and score.tolist() == own[ids].tolist()
        total += int(np.isin(shard.block_term, queries[q]).sum())
    assert read < total
