"""Operator 10: token ids in a binary format of 64-bit words (Simple-8b).

A word has a 4-bit selector and 60 data bits that hold n ids of 60 // n bits;
ids of over 60 bits are escapes (selector 15, data: place in a side table).
A *block* holds whole documents (about 1 MB of text): document ids and id
counts, the word offset of every run of ``RUN`` ids so that runs decode
independently and at once, the words, and the escapes. Blocks are rows of
Parquet files, one file (*shard*) for a range of document ids; a block records
the ids before it in its shard, and the shards' totals give every document's
global start. Spark's writer commits whole shards, so a lost executor leaves
no half-written ones.

Null texts are empty: just the end id. Null document ids come first. Rows with
one id are ordered by a text hash. Memory follows the block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import documents, shared_folder, text_bytes, text_rows
from .text import chunks, flat
from .token_counts import word_bpe
from .tokens import WORDS_KEPT, drop_encoders, encoder, load

END = 2
RUN = 512
SHARD_BYTES = 16 << 20
TOGETHER = 4 << 20              # bytes of text that are encoded at once
# widest field for each possible number of ids in a word, most ids first
COUNTS = sorted({60 // w for w in range(1, 61)}, reverse=True)
N = np.array(COUNTS + [0] * (15 - len(COUNTS)) + [1], np.int64)
WIDTH = np.array([60 // n for n in COUNTS] + [0] * (16 - len(COUNTS)), np.int64)
ESCAPE = 15
BLOCKS = "shard int, block int, before long, n_docs int, n_ids long, body binary"
_U = np.uint64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each run, escapes) of uint64 ids."""
    total = len(ids)
    runs = -(-total // RUN)
    if not runs:
        return np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, _U)
    pad = COUNTS[0]
    value = np.zeros((runs, RUN + pad), _U)
    bits = np.full((runs, RUN + pad), 255, np.uint8)  # no word reaches beyond its run
    full = np.zeros(runs * RUN, _U)
    full[:total] = ids
    value[:, :RUN] = full.reshape(runs, RUN)
    size = np.zeros(runs * RUN, np.uint8)
    size[total:] = 255
    size[:total] = _bit_length(ids)
    bits[:, :RUN] = size.reshape(runs, RUN)
    # at each id the selector of a word that begins there
    selector = np.full((runs, RUN), ESCAPE, np.uint8)
    widest = {1: bits}
    for n in sorted(COUNTS):
        if n > 1:
            half = max(k for k in widest if k < n and 2 * k >= n)
            m = widest[half]
            widest[n] = np.maximum(m[:, :m.shape[1] - (n - half)], m[:, n - half:])
        fits = widest[n][:, :RUN] <= 60 // n
        selector[fits] = COUNTS.index(n)
    # follow the words of all runs at once
    length = np.minimum(RUN, total - np.arange(runs) * RUN)
    at, live, steps = np.zeros(runs, np.int64), np.arange(runs), []
    while len(live):
        s = selector[live, at[live]]
        steps.append((live, at[live].copy(), s))
        at[live] += N[s]
        live = live[at[live] < length[live]]
    run, place, chosen = (np.concatenate([x[i] for x in steps]) for i in range(3))
    by = np.lexsort((place, run))
    run, place, chosen = run[by], place[by], chosen[by].astype(np.int64)
    words = chosen.astype(_U) << _U(60)
    flat_at = run * (RUN + pad) + place
    cells = value.reshape(-1)
    escape = chosen == ESCAPE
    escapes = cells[flat_at[escape]]
    words[escape] |= np.arange(len(escapes), dtype=_U)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = words[mine]
            for j in range(COUNTS[s]):
                word |= cells[flat_at[mine] + j] << _U(j * WIDTH[s])
            words[mine] = word
    return words, np.searchsorted(run, np.arange(runs)).astype(np.uint32), escapes


_SHORT = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def _bit_length(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < len(_SHORT):
        return _SHORT[ids]
    out, rest = np.ones(len(ids), np.uint8), ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (_U(1) << _U(step))
        out[big] += step
        rest[big] >>= _U(step)
    return out


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any words that begin with a run's first."""
    s = (words >> _U(60)).astype(np.int64)
    out = np.empty(int(N[s].sum()), _U)
    begin = np.cumsum(N[s]) - N[s]
    for k in np.unique(s):
        mine = np.flatnonzero(s == k)
        data = words[mine] & _U((1 << 60) - 1)
        if k == ESCAPE:
            out[begin[mine]] = escapes[data.astype(np.int64)]
            continue
        mask = _U((1 << int(WIDTH[k])) - 1)
        for j in range(N[k]):
            out[begin[mine] + j] = (data >> _U(j * WIDTH[k])) & mask
    return out


def block(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, runs, escapes = pack(ids.astype(_U))
    head = np.array([len(doc_ids), len(ids), len(words), len(runs), len(escapes)], "<i8")
    return b"".join(x.tobytes() for x in (head, doc_ids.astype("<i8"), null.astype("<u1"), counts.astype("<i8"), runs.astype("<u4"),
                                          words.astype("<u8"), escapes.astype("<u8")))


def read_block(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, null flags, id counts, ids)."""
    docs, ids, words, runs, escapes = np.frombuffer(body, "<i8", 5)
    at, out = 40, []
    for kind, n in (("<i8", docs), ("<u1", docs), ("<i8", docs), ("<u4", runs), ("<u8", words), ("<u8", escapes)):
        out.append(np.frombuffer(body, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out[0], out[1] == 1, out[2], unpack(out[4], out[5])


def _packed(version: str, content, end: int, together: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(version, content, words), TaskContext.get().partitionId()
        before = number = 0
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets, together):  # a word that comes again is looked up once
                part = batch.slice(i, j - i)
                all_ids, all_counts = own.encode([x or "" for x in part.column("text").to_pylist()])
                all_ids = np.insert(all_ids, np.cumsum(all_counts), end)
                all_counts = all_counts + 1
                at = np.concatenate([[0], np.cumsum(all_counts)])
                key = part.column("doc_id")
                null, key = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
                for a, b in chunks(offsets[i:j + 1]):
                    ids = all_ids[at[a]:at[b]]
                    body = block(key[a:b], null[a:b], all_counts[a:b], ids)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (number, pa.int32()), (before, pa.int64()), (b - a, pa.int32()), (len(ids), pa.int64()), (body, pa.binary()))],
                                                     names=["shard", "block", "before", "n_docs", "n_ids", "body"])
                    before, number = before + len(ids), number + 1
        if words < WORDS_KEPT:
            del own
            drop_encoders()
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END, together: int = TOGETHER, words: int = WORDS_KEPT) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids in doc_id order.
    ``together`` (bytes of text encoded at once) and ``words`` (a worker's
    memory) trade memory for time; the ids do not depend on them. A memory of
    fewer words than ``WORDS_KEPT`` lasts for a task, as other stages are to
    have its room."""
    spark = docs.sparkSession
    docs = text_rows(docs)
    version, content = load(spark, tokenizer)
    shards = max(1, -(-text_bytes(docs) // SHARD_BYTES))
    order = ["doc_id", "h"]
    docs = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    docs.select("doc_id", "text").mapInArrow(_packed(version, content, end, together, words), BLOCKS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, before, body in zip(batch.column("shard"), batch.column("before"), batch.column("body")):
            docs, null, counts, ids = read_block(body.as_py())
            at = np.concatenate([[0], np.cumsum(counts)])
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), shard.as_py(), np.int32)), pa.array(docs, mask=null), pa.array(before.as_py() + at[:-1]), pa.array(counts), pa.array(crc, pa.int64())],
                                             names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in a folder of
    shards. Only the shards' totals (one row a file) are summed in order."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    docs = blocks.mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, together: int = TOGETHER, words: int = WORDS_KEPT) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, path, together=together, words=words)
    return read_documents(spark, path)


def op10_simple8b_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), word_bpe())


QUERIES = {"op10_simple8b_token_ids": op10_simple8b_token_ids}
