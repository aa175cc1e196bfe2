"""Operator 8: quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the
whole text is encoded (character-class transitions, word and repetition
statistics); only documents have labels. The model embeds a passage, weighs it
by gated attention (a tanh and a sigmoid branch multiplied), and classifies
the weighted mean:

    h = tanh(A x + a),  w = softmax_passages(r . (tanh(V h) * sigmoid(U h))),
    score = sigmoid(c . sum(w h) + d)

Attention lets one junk passage decide for a long document. The fit takes
labelled documents in the order of a hash of their ids, ``max_documents`` and
``max_passages`` at most (and one more document's), and runs on them in one
process, so the driver's memory is bounded and the model does not depend on how
rows lie. Scoring is one pass over all rows, with the weights as a broadcast of
a few kB; only texts go to Python and only scores come back.

Documents that train are those whose crc32(doc_id as text) mod ``folds`` is
not 0. Null labels are left out, and several labels of one id count as the
largest. Of several texts of one id the one with the smallest hash teaches;
repeated rows teach once. Null or blank texts are one empty passage. Without
labels every score is 0.5, and empty tables give no rows. Other columns keep
their names, ``score_col`` excepted. Source, language and id are no features. Memory follows the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import ArrowUDFType

from .frames import documents, text_rows, written
from .text import LOWER, Spans, chunks, flat, mix, word_spans

PASSAGE, FOLDS, THRESHOLD = 64, 5, 0.3
MAX_DOCUMENTS, MAX_PASSAGES, EPOCHS, BATCH, RATE, SEED = 8000, 200_000, 40, 64, 4e-3, 7
HIDDEN, GATE = 24, 12
# byte classes: blank, line feed, other control, a-z, A-Z, digit, sentence marks, other ASCII marks, beyond ASCII
CLASSES = 9
CLASS = np.full(256, 8, np.uint8)
CLASS[:128] = 7
CLASS[:32] = 2
CLASS[[0x20, 0x09]] = 0
CLASS[[0x0A, 0x0D]] = 1
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 3, 4, 5
CLASS[[ord(c) for c in ".,;:'-"]] = 6
FEATURES = CLASSES * CLASSES + 7


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each row); a row without words
    is one passage of zeros."""
    rows = len(offsets) - 1
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    n = np.bincount(row, minlength=rows)
    each = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(each) - each
    total = int(each.sum())
    x = np.zeros((total, FEATURES), np.float32)
    if not len(start):
        return x, each
    place = np.arange(len(start)) - (np.cumsum(n) - n)[row]
    passage = first[row] + place // PASSAGE
    # bytes belong to the passage of the word they are in or after
    byte_of = np.zeros(len(data), np.int64)
    own = np.flatnonzero(np.diff(offsets))
    heads = np.flatnonzero((place > 0) & (place % PASSAGE == 0))
    begins = np.concatenate([offsets[own], start[heads]])
    number = np.concatenate([first[own], passage[heads]])
    by = np.argsort(begins, kind="stable")
    byte_of[begins[by]] = np.diff(np.concatenate([[0], number[by]]))
    byte_of = np.cumsum(byte_of)
    kind = CLASS[data].astype(np.int64)
    inside = byte_of[1:] == byte_of[:-1]
    code = byte_of[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    pairs = np.bincount(code[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    x[:, :CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    words = np.bincount(passage, minlength=total)
    count = np.maximum(1, words).astype(np.float64)
    size = end - start
    word = Spans(low).of(start, end)
    share = lambda flag: np.bincount(passage, weights=flag, minlength=total) / count
    repeated = lambda key: _repeats(key, passage)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    triple = word.copy()
    if len(word) > 2:
        whole = row[2:] == row[:-2]
        triple[:-2][whole] = mix(word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[2:])[whole]
    extra = [np.log1p(share(size)), share(size >= 12), share(size <= 2), share(same), share(repeated(word)), share(_repeats(triple, row)), np.log1p(words) / 4]
    x[:, CLASSES * CLASSES:] = np.stack(extra, axis=1)
    x[first[n == 0]] = 0
    return x, each


def _repeats(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 for keys that came before in their group, else 0."""
    by = np.lexsort((key, group))
    out = np.zeros(len(key))
    again = np.zeros(len(key), bool)
    again[1:] = (key[by][1:] == key[by][:-1]) & (group[by][1:] == group[by][:-1])
    out[by] = again
    return out


def forward(m: dict, x: np.ndarray, each: np.ndarray) -> tuple:
    """(scores of bags, what the gradient needs); ``each``: passages a bag."""
    at = np.cumsum(each) - each
    h = np.tanh(((x - m["mean"]) / m["std"]) @ m["A"] + m["a"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["r"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), each))
    w = e / np.repeat(np.add.reduceat(e, at), each)
    z = np.add.reduceat(w[:, None] * h, at)
    score = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))
    return score, (h, t, g, w, z, at)


def fit(x: np.ndarray, each: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Weights by Adam on bags in batches; plain cross-entropy."""
    rnd = np.random.default_rng(SEED)
    draw = lambda *s: rnd.normal(0, 1 / np.sqrt(s[0]), s)
    m = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 0.05,
         "A": draw(x.shape[1], HIDDEN), "a": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
         "r": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    learned = ["A", "a", "V", "U", "r", "c", "d"]
    one, two, step = {k: np.zeros_like(m[k]) for k in learned}, {k: np.zeros_like(m[k]) for k in learned}, 0
    begin = np.cumsum(each) - each
    for epoch in range(epochs):
        order = rnd.permutation(len(label))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), BATCH):
            bags = order[i:i + BATCH]
            part = np.concatenate([np.arange(begin[b], begin[b] + each[b]) for b in bags])
            xb, n = x[part], each[bags]
            score, (h, t, g, w, z, at) = forward(m, xb, n)
            dy = (score - label[bags]) / len(bags)
            grad = {"c": z.T @ dy, "d": np.array([dy.sum()])}
            dz = np.repeat(dy, n)[:, None] * m["c"]
            dw = (dz * h).sum(axis=1)
            de = w * (dw - np.repeat(np.add.reduceat(w * dw, at), n))
            grad["r"] = (t * g).T @ de
            dt, dg = de[:, None] * m["r"] * g * (1 - t * t), de[:, None] * m["r"] * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (w[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
            grad["A"], grad["a"] = ((xb - m["mean"]) / m["std"]).T @ dh, dh.sum(axis=0)
            step += 1
            for k in learned:
                gk = grad[k] + 1e-4 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * gk
                two[k] = 0.999 * two[k] + 0.001 * gk * gk
                m[k] = m[k] - rate * one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in chunks(offsets):
            x, each = encode_passages(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            at = np.concatenate([[0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                                             names=["doc_id", "label", "passages"])


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, epochs: int = EPOCHS, max_passages: int = MAX_PASSAGES) -> dict | None:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    chosen = (labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents))
    own = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    bags = written(own.select("doc_id", "label", "t.text").mapInArrow(_bags, "doc_id long, label int, passages binary"), "bags")
    x, label, n = [], [], 0
    for r in bags.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if n >= max_passages:
            break
        x.append(np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES))
        label.append(r["label"])
        n += len(x[-1])
    if not x:
        return None
    return fit(np.concatenate(x), np.array([len(p) for p in x]), np.array(label, np.float64), epochs)


def _scored(weights):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = weights.value
        for column in texts:
            data, offsets = flat(column)
            scores = [np.zeros(0)]
            for a, b in chunks(offsets):
                part = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                scores.append(forward(m, *encode_passages(*part))[0] if m else np.full(b - a, 0.5))
            yield pa.array(np.concatenate(scores))
    return run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def quality_score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_documents: int = MAX_DOCUMENTS,
                  epochs: int = EPOCHS) -> Column:
    """The score of the column ``text``, as learned from ``docs`` (doc_id,
    text) and the labels of the documents outside fold 0."""
    labels = labels.filter(fold(F.col("doc_id"), folds) != 0)
    weights = docs.sparkSession.sparkContext.broadcast(train(text_rows(docs), labels, max_documents, epochs))
    return F.arrow_udf(_scored(weights), T.DoubleType(), ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_documents: int = MAX_DOCUMENTS,
                    epochs: int = EPOCHS, score_col: str = "_score") -> DataFrame:
    """``docs`` (doc_id, text and any others) with their scores."""
    return docs.withColumn(score_col, quality_score(docs, labels, folds, max_documents, epochs))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))


def op8_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(text_rows(documents(spark, sf_dir)), quality_labels(spark, sf_dir), score_col="score")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_attention_mil_quality": op8_attention_mil_quality}
