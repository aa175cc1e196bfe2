"""Operator 9: held-out accuracy, exact counts of a small filter, edges."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import types as T

from ordinal_spark.llm.language_filters import decide, grams, identify, learn, op9_language_bitmask, slots

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("gram", T.StringType()), T.StructField("total", T.StringType())])


def test_held_out_accuracy(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])
    want = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist()))
    got = op9_language_bitmask(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in want if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_grams():
    code, each = grams(["Ab c!", "", "1 2", "É"])
    a, b, c, e = (ord(x) for x in "abcé")
    pack = lambda x, y, z: (x << 42) | (y << 21) | z
    assert code.tolist() == [pack(0, a, b), pack(a, b, 0), pack(0, c, 0), pack(0, e, 0)]
    assert each.tolist() == [3, 0, 0, 1]


def test_filter_has_every_gram_of_a_language(spark):
    rows = [("xx", "aba abba bab " * 5), ("yy", "cdc ddc cdcd " * 5), ("yy", "aba"), ("zz", None)]
    model = learn(spark.createDataFrame([r for r in rows if r[1]], "lang string, text string"))
    assert model["langs"] == ["xx", "yy"] or model["langs"] == ["yy", "xx"]
    for lang, text in rows[:2]:
        code, _ = grams([text])
        bit = model["langs"].index(lang)
        mask = np.bitwise_and.reduce([model["table"][s, 0] for s in slots(code, len(model["table"]))])
        assert (mask >> bit & 1).all()
    assert decide(["bab", "ccd", "123", ""], model)[0] == ["xx", "yy", "und", "und"]


def test_many_languages_and_edges(spark):
    words = {f"l{i:02d}": "".join(chr(0x4E00 + 40 * i + j) for j in range(40)) for i in range(70)}
    rows = [(7 * i + j, t, lang, "g", "t") for i, (lang, t) in enumerate(words.items()) for j in range(6)]
    rows += [(None, words["l03"], None, None, None), (10**6, None, "l01", None, None), (10**6 + 1, "?! 42", "l01", None, None), (3, words["l69"], None, None, None), (3, words["l69"], None, None, None)]
    got = identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["lang_pred"] == "l03" and by[10**6]["lang_pred"] == by[10**6 + 1]["lang_pred"] == "und"
    assert all(by[7 * i]["lang_pred"] == lang for i, lang in enumerate(words))
    nothing = identify(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_grams_beyond_the_table_are_joined(spark, monkeypatch):
    import random

    from ordinal_spark.llm import language_filters as L

    rnd = random.Random(4)
    text = lambda first, n: "".join(chr(first + rnd.randrange(200)) for _ in range(n))
    rows = [(i, text(0x4E00 if i % 2 else 0x5200, 3000), "ab"[i % 2], "g", "t") for i in range(40)] + [(100, None, "a", "g", "t"), (None, "?! 42", "b", "g", "t")]
    rows += [(200 + i, rows[i][1][:40], None, "g", "t") for i in range(12)] + [(200, rows[0][1][:40], None, "g", "t"), (300, "xyz", None, "g", "t")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(L, "LEAST", 1)
    want = {str(r[0]): (r[1], r[2]) for r in identify(df).collect()}
    monkeypatch.setattr(L, "MAX_SLOTS", 1 << 10)
    out = identify(df).collect()
    got = {str(r[0]): (r[1], r[2]) for r in out}
    assert len(out) == len(rows) and set(got) == set(want) and got["100"] == got["None"] == ("und", 0.0)
    for i in range(40):
        if zlib.crc32(str(i).encode()) % 3 != 1:  # learned: a full filter finds both languages in any text
            for d in [i, 200 + i][:1 + (i < 12)]:
                assert got[str(d)][0] == want[str(d)][0] == "ab"[i % 2] and got[str(d)][1] > 0.99 and abs(got[str(d)][1] - want[str(d)][1]) < 0.1


def test_language_of_one_short_text(spark):
    from ordinal_spark.llm import language_filters as L

    model = learn(spark.createDataFrame([("xx", "abcdefg"), ("yy", "cdc ddc cdcd " * 200)], "lang string, text string"))
    assert L.decide(["abcdefg"], model)[0] == ["xx"]
