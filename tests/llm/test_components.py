"""Connected components against a direct search."""

import random

from ordinal_spark.llm.components import components


def direct(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for k in sorted(near):
        todo = [] if k in out else [k]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += near[x]
    return out


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(-900, 900), rnd.randrange(-900, 900)) for _ in range(800)]
    pairs = [(a, b) for a, b in pairs if a != b] + [(5000 - i, 5001 - i) for i in range(120)] + [(9000, 9000 + i) for i in range(1, 200)]
    got = {r["key"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == direct(pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
