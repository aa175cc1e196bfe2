"""Each stage of the pipeline against a direct computation on its own input."""

import zlib
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

import corpus_pipeline
from ordinal_spark.llm import simple8b, tokens
from ordinal_spark.llm.attention_mil import THRESHOLD
from tests.llm.test_decontaminate_mixing import brute as leaks
from tests.llm.test_jaccard_join import brute as components

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], DIR).persist())
        assert kept[-1].columns == columns, name
    before, good, single, clean, mixed = [[tuple(r) for r in d.collect()] for d in kept]
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality").collect()}
    assert set(good) <= set(before)
    gone = {r[0] for r in before} - {r[0] for r in good}
    assert sum(labels.get(d) == 1 for d in gone) <= 2 and sum(labels.get(r[0]) == 0 for r in good) <= 2
    want = {c for _, _, c in components([(r[0], r[1]) for r in good])}
    assert sorted(r[0] for r in single) == sorted(want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = {d for d, _ in leaks([(r[0], r[1]) for r in single], items)}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in single if r[0] not in dirty) and dirty
    assert set(mixed) == set(clean) and len(mixed) >= len(clean)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, ids = 0, []
    for d, text in sorted((r[0], r[1]) for r in mixed):
        x = t.encode(text, add_special_tokens=False).ids + [2]
        ids.append((d, at, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))))
        at += len(x)
    got = corpus_pipeline.STAGES[-1][1](spark, kept[-1], DIR).orderBy("start")
    assert [tuple(r) for r in got.collect()] == ids
    run = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, run.collect())) == sorted(ids)


def test_token_ids_with_a_small_memory(monkeypatch):
    """The last stage keeps fewer words in a worker than operator 10, and what
    an encoder forgets does not change its ids."""
    seen = {}
    monkeypatch.setattr(corpus_pipeline, "encode_documents", lambda docs, tokenizer, together, words: seen.update(together=together, words=words))
    corpus_pipeline.token_ids(None, None, DIR)
    assert seen["words"] <= tokens.WORDS_KEPT // 3 and seen["together"] <= simple8b.TOGETHER // 4
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        own = tokens.Encoder(f.read(), 200)
    t = Tokenizer.from_file(path)
    texts = [x or "" for x in pq.read_table(f"{DIR}/documents.parquet", columns=["text"])["text"].to_pylist()[:40]]
    for x in texts + texts:
        assert own.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids
        own.forget()
        assert len(own.word) <= 200 and len(own.piece) <= 100


def test_a_task_of_token_ids_leaves_no_encoder(monkeypatch):
    """Idle workers that kept theirs took the next run's first stage beyond an
    executor's memory; operator 10 alone keeps its own."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        content = SimpleNamespace(value=f.read())
    monkeypatch.setattr(simple8b, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokens, "_encoders", {})
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], names=["doc_id", "text"])
    rows = {}
    for words in (corpus_pipeline.WORDS, tokens.WORDS_KEPT):
        rows[words] = [b.to_pylist() for b in simple8b._packed("v", content, 2, corpus_pipeline.TOGETHER, words)(iter([batch]))]
        assert len(tokens._encoders) == (words == tokens.WORDS_KEPT)
    assert rows[corpus_pipeline.WORDS] == rows[tokens.WORDS_KEPT]


def test_quality_uses_its_threshold():
    assert THRESHOLD == 0.3


def test_near_duplicates_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_i", T.StringType()), T.StructField("h", T.StringType())])
    t = "one two three four five six seven"
    rows = [(5, t, "a", "x"), (5, t, "a", "x"), (3, t.upper(), "b", "x"), (None, t, "c", "x"), (7, "", None, None), (7, None, None, None), (8, "alone", None, None), (None, "no id here", None, None), (None, "no id here", None, None)]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], schema).withColumnRenamed("_i", "component")
    out = corpus_pipeline.near_duplicates(spark, df, DIR)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted([("3", t.upper()), ("7", ""), ("7", "None"), ("8", "alone"), ("None", "no id here")])
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), DIR).count() == 0
    assert out.filter(F.col("doc_id") == 5).count() == 0
