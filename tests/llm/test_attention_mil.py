"""Operator 8: held-out accuracy, gradients, edges."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import types as T

from ordinal_spark.llm import attention_mil
from ordinal_spark.llm.attention_mil import encode_passages, fit, forward, op8_attention_mil_quality, score_documents

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType()),
                       T.StructField("score", T.StringType())])


def test_held_out_accuracy(spark):
    t = pq.read_table("/root/testdata/sf0.01/labels.parquet")
    want = dict(zip(t["doc_id"].to_pylist(), t["quality"].to_pylist()))
    got = op8_attention_mil_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id"]).num_rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) >= 0.93


def bags(texts):
    data = "".join(texts).encode()
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    return encode_passages(np.frombuffer(data, np.uint8), at)


def test_every_passage_of_a_text_counts():
    x, each = bags(["", "  \n", "one", "w " * 64, "w " * 65, "é ß " * 500, "\n\n lead"])
    assert each.tolist() == [1, 1, 1, 1, 2, 16, 1]
    alone = [bags([t])[0] for t in ["", "  \n", "one", "w " * 64, "w " * 65, "é ß " * 500, "\n\n lead"]]
    assert np.allclose(x, np.concatenate(alone))


def test_attention_finds_one_bad_passage():
    rnd = np.random.default_rng(1)
    good = lambda: " ".join("".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(64)) + "\n"
    bad = lambda: " ".join(["SPAM!!!"] * 64) + "\n"
    texts, label = [], []
    for i in range(240):
        parts = [good() for _ in range(rnd.integers(1, 12))]
        label.append(i % 2)
        if i % 2 == 0:
            parts[rnd.integers(len(parts))] = bad()
        texts.append("".join(parts))
    x, each = bags(texts)
    at = np.cumsum(each)
    m = fit(x[:at[159]], each[:160], np.array(label[:160], float), 30)
    score, (*_, w, _, _) = forward(m, x, each)
    assert ((score[160:] >= 0.5) == np.array(label[160:])).mean() >= 0.97
    sums = np.add.reduceat(w, np.cumsum(each) - each)
    assert np.allclose(sums, 1)


def test_edges(spark):
    docs = spark.createDataFrame([(i, ["plain prose of several words. ", "A!!# B!!# C!!# "][i % 2] * (1 + i % 40), "x", "y") for i in range(300)]
                                 + [(None, "no id", None, None), (1000, None, None, None), (1000, "", None, None), (1001, " ", None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, label int")
    got = score_documents(docs, labels, max_documents=200, epochs=15).collect()
    assert len(got) == 304 and all(0 <= r["_score"] <= 1 for r in got)
    assert np.mean([(r["_score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300]) > 0.97
    none = score_documents(docs, labels.limit(0)).collect()
    assert {r["_score"] for r in none} == {0.5}
    assert score_documents(docs.limit(0), labels, epochs=1).count() == 0
    assert attention_mil.train(docs.limit(0).select("doc_id", "text"), labels) is None
