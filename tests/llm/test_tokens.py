"""Operators 5 and 10 against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ordinal_spark.llm import simple8b, token_counts
from ordinal_spark.llm.tokens import Encoder

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("shard", T.IntegerType())])
ODD = ["", None, " ", "\n\n", "don't  stop\tthe été ΣΣ x", "a<|endoftext|>b <|startoftext|> c", "́ ́a",
       "\x1c\x85  tail", "İstanbul ǅ 5,000.25 'S 'll ''t", "日本語 テスト\r\n🙂🙂", "x" * 70_000, "it 's it's"]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def table(sf="sf0.001"):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    own = Encoder(open(public_tokenizers.path(name), "rb").read())
    assert own.by_word == (name == "word_bpe_49k.json")
    t = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [x or "" for x in ODD] + [x for _, x in table()[:60]]
    ids, counts = own.encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in want] == own.counts(texts).tolist()
    assert ids.tolist() == [i for x in want for i in x]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_encoder_on_any_text(texts):
    global _own, _lib
    if "_own" not in globals():
        _own, _lib = Encoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()), library()
    assert _own.encode(texts)[0].tolist() == [i for x in texts for i in _lib(x)]


def test_counts_and_cache(spark, tmp_path):
    ids = library()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a  b"), (3, "a  b")]
    df = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], SCHEMA)
    key = lambda x: str(x)
    want = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows), key=key)
    cache = f"file://{tmp_path}/cache"
    path = token_counts.word_bpe()
    assert sorted(map(tuple, token_counts.count_tokens(df, path, cache).collect()), key=key) == want
    n = spark.read.parquet(cache).count()
    more = df.union(spark.createDataFrame([(99, "a new text", None, None)], SCHEMA))
    assert token_counts.count_tokens(more, path, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == n + 1  # only the new text was encoded
    assert token_counts.count_tokens(df.limit(0), path, cache).count() == 0


def test_op5_small_table(spark):
    ids = library()
    want = sorted((d, len(t.encode()), len(ids(t)), len(ids(t)) > 2048) for d, t in table())
    assert sorted(map(tuple, token_counts.op5_digest_token_counts(spark, "/root/testdata/sf0.001").collect())) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40) | st.just(0), max_size=1500))
def test_pack_round_trip(values):
    ids = np.array(values, np.uint64)
    words, runs, escapes = simple8b.pack(ids)
    assert simple8b.unpack(words, escapes).tolist() == values
    for k in range(len(runs)):  # a run decodes by itself
        end = runs[k + 1] if k + 1 < len(runs) else len(words)
        assert simple8b.unpack(words[runs[k]:end], escapes).tolist() == values[512 * k:512 * (k + 1)]


def test_selectors_are_the_published_ones():
    assert simple8b.COUNTS == [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
    words, _, _ = simple8b.pack(np.zeros(512, np.uint64))
    assert len(words) == 10  # 8 words of 60 zeros, then 30 and 2


def expected(rows, ids):
    at, out = 0, []
    for d, t in rows:
        x = ids(t) + [2]
        out.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


def test_op10_small_table(spark):
    got = simple8b.op10_simple8b_token_ids(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(sorted(table()), library())


def test_op10_edges(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "SHARD_BYTES", 2000)
    rows = [(None, "first")] + [(i, t) for i, t in enumerate(ODD[:10])] + [(50, "same"), (50, "same"), (10**12, "last")]
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    df = spark.createDataFrame([(i, t, "d", 7) for i, t in mixed], SCHEMA).repartition(3)
    got = simple8b.encode_documents(df, token_counts.word_bpe()).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, library())
    assert simple8b.encode_documents(df.limit(0), token_counts.word_bpe()).count() == 0
