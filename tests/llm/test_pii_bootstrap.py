"""Operator 4: base spans against the plain patterns, and the bootstrap
against a direct computation."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from ordinal_spark.llm import pii_bootstrap as P

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h", T.StringType()),
                       T.StructField("base", T.StringType())])


def plain(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.1+ -(éZ_5", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_base_spans_of_common_forms():
    t = "é a.b+c@d-e.org, 10.0.0.255 256.1.1.1 0010.2.3.4 x 4539 1488 0343 6467 y 4539148803436468 +1 (555) 010-9999 +12 a@b@c.de x@y"
    assert P.base_spans(t) == plain(t) and {k for k, *_ in P.base_spans(t)} == {0, 1, 2, 3}
    assert P.base_spans("9" * 100_000 + "a" * 200_000 + "@") == []


def direct(texts):
    """Added spans by the documented scores."""
    seen = {i: P.occurrences(t, plain(t)) for i, t in enumerate(texts)}
    edges = defaultdict(lambda: -1)
    for occ in seen.values():
        for k, _, _, v, *ps in occ:
            for p in ps:
                if p is not None:
                    edges[p, v] = max(edges[p, v], k)
    seeds = {}
    for (_, v), k in edges.items():
        if k >= 0:
            seeds[v] = min(seeds.get(v, (9,))[0], k), 1.0
    found = dict(seeds)
    for _ in range(P.ROUNDS):
        by = defaultdict(list)
        for p, v in edges:
            by[p].append(found.get(v, (-1, 0.0)))
        trusted = {}
        for p, xs in by.items():
            kinds = {k for k, _ in xs if k >= 0}
            best = max(((sum(s for k2, s in xs if k2 == k), -k, sum(k2 == k for k2, _ in xs)) for k in kinds), default=None)
            if best and best[0] / (len(xs) + 1) >= P.CONFIDENCE and best[2] >= P.SUPPORT:
                trusted[p] = -best[1], best[0] / (len(xs) + 1)
        doubt = defaultdict(float)
        for (p, v), k in edges.items():
            if k < 0 and p in trusted:
                doubt[v, trusted[p][0]] += math.log(1 - trusted[p][1])
        drawn = {}
        for (v, k), x in doubt.items():
            drawn[v] = max(drawn.get(v, (-1.0, 0)), (1 - math.exp(x), -k))
        found = {v: (-k, s) for v, (s, k) in drawn.items() if s >= P.ACCEPT and v not in seeds} | seeds
    out = {}
    for i, occ in seen.items():
        for k, a, b, v, *ps in occ:
            hits = [(trusted[p][1], -trusted[p][0]) for p in ps if p in trusted]
            if k < 0 and hits and v in found:
                out.setdefault(i, []).append((-max(hits)[1], a, b))
    return out


def corpus():
    rnd = random.Random(2)
    word = lambda: rnd.choice("alpha beta gamma delta omega kappa".split())
    lead = ["please write to me at", "server address is", "the phone number is"]
    made = [lambda: f"u{rnd.randrange(999)}@mail.example.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: f"+1 (555) {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}"]
    texts = []
    for i in range(300):
        k = rnd.randrange(3)
        value = made[k]()
        if rnd.random() < 0.06:
            value = ["user77-at-mail.example", "node-17.cluster", "5550108899x"][k] + str(rnd.randrange(9))
        texts.append(f"{word()} {word()} {lead[k]} {value} {word()} {word()} v{rnd.randrange(10**7)} {word()}")
    return texts


def test_bootstrap_equals_direct_scores(spark):
    texts = corpus()
    want = direct(texts)
    assert sum(map(len, want.values())) > 8
    df = spark.createDataFrame([(i, t, "h", "b") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in P.find_personal(df).collect() if r["added"]}
    assert got == want


def test_op4_small_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    want = {}
    for d, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        s = plain(text or "")
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in s)
        want[d] = (*(sum(k == i for k, *_ in s) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(","))))
    for r in P.op4_bootstrapped_pii(spark, "/root/testdata/sf0.001").collect():
        x = want.pop(r["doc_id"])
        assert tuple(r)[1:6] == x[:5]
        spans = r["spans"].split(",") if r["spans"] else []
        assert x[5] <= set(spans) and len(spans) == len(x[5]) + r["n_added"]
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert not want


def test_edges(spark):
    rows = [(None, "write a@b.de now", None, None), (None, "write a@b.de now", None, None), (1, None, "x", "x"), (2, "", "x", "x"), (2, "1.2.3.4", None, None)]
    got = P.find_personal(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), len(r["base"]), len(r["added"])) for r in got) == [("1", 0, 0), ("2", 0, 0), ("2", 1, 0), ("None", 1, 0), ("None", 1, 0)]
    assert P.find_personal(spark.createDataFrame([], SCHEMA)).count() == 0
