"""Operator 9: language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i of the table holds a bitmask
of the languages whose filter has bit i set, so the AND of an n-gram's slots
gives all languages that contain it at once. N-grams are runs of ``SIZE``
letters of the lower-cased text, with a blank for anything between words.

* Learning counts the n-grams of every document that may train, per language.
  An n-gram belongs to a language in which its rate is at least ``RATIO`` of
  its highest rate in any language, so that a few foreign or mislabelled texts
  do not put the n-grams of one language into another's filter.
* A text's n-grams are counted per language (popcounts of the bits over all its
  n-grams). A filter with a share f of its bits set answers wrongly with
  chance f ** HASHES; a count o of n is corrected to (o - n f') / (1 - f').
  The language with the largest corrected count wins; the score is its part of
  the sum of the corrected counts.

The table has at most ``MAX_SLOTS`` slots (a broadcast of a bounded size). If
a language's n-grams outgrow it (``SLOTS_EACH`` slots each), texts' n-grams are
joined to the learned ones instead and counted exactly; a common n-gram is left
to AQE's skew join. Any number of languages takes ceil(languages / 64) words a
slot. N-grams seen fewer than ``LEAST`` times do not count in a language of
``ENOUGH`` n-grams in all; a language taught by less keeps all of its own.

Training documents have a language and crc32(doc_id as text) mod ``folds``
other than 1; null ids do not train. Texts that are null or without letters
are `und` with score 0, as is every text if nothing was learned. Ties go to
the language learned from more n-grams, then by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .attention_mil import fold
from .frames import documents, written
from .text import chunks, flat, mix

SIZE, FOLDS, RATIO, LEAST = 3, 3, 0.1, 2
HASHES, SLOTS_EACH, MAX_SLOTS = 3, 16, 1 << 22
ENOUGH = 1000
FLUSH = 1 << 20
_U = np.uint64
_letter: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Unicode letters by code point, made once by a worker."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def grams(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts as 63-bit codes, n-grams of each text). A gram is
    the letters around a position that holds a letter; 0 is a gap."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([1] + [len(t) + 1 for t in low])
    letter = is_letter()[points]
    points = np.where(letter, points, 0).astype(_U)
    before, after = (size - 1) // 2, size // 2
    at = np.flatnonzero(letter)
    code = np.zeros(len(at), _U)
    gap = np.zeros(len(at), bool)
    parts = {}
    for step in (range(0, -before - 1, -1), range(0, after + 1)):  # a gap hides what lies beyond it
        gap[:] = False
        for j in step:
            c = points[np.clip(at + j, 0, len(points) - 1)]
            gap |= c == 0
            parts[j] = np.where(gap, _U(0), c)
    for j in range(-before, after + 1):
        code = (code << _U(21)) | parts[j]
    return code, np.diff(np.searchsorted(at, begin))


def slots(code: np.ndarray, n_slots: int) -> list[np.ndarray]:
    """The slots of each n-gram; ``n_slots`` is a power of two."""
    h = mix(code + _U(0x9E3779B97F4A7C15))
    return [((h >> _U(21 * i)) & _U(n_slots - 1)).astype(np.int64) for i in range(HASHES)]


def _counted(size: int):
    """(lang, gram, n) of each task's texts."""
    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            code, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b in chunks(offsets):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                code, each = grams(texts, size)
                owner = np.repeat(np.arange(b - a), each)
                for lang in dict.fromkeys(langs[a:b]):
                    held.setdefault(lang, []).append(np.unique(code[(langs[a:b] == lang)[owner]], return_counts=True))
                if sum(len(p[0]) for parts in held.values() for p in parts) > FLUSH:
                    held = {k: [_sum(parts)] for k, parts in held.items()}
                    if sum(len(parts[0][0]) for parts in held.values()) > FLUSH // 2:
                        yield from flush(held)
                        held = {}
        yield from flush(held)
    return run


def _sum(parts: list) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64)


def learn(docs: DataFrame, size: int = SIZE) -> dict:
    """The filter table from (lang, text) rows: languages, mask table, and the
    false-positive rate of each language's filter; or, in place of the table,
    ``held``: the (gram, number) rows that no table can hold."""
    spark = docs.sparkSession
    counts = (docs.mapInArrow(_counted(size), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()  # one row a language
    langs = [r["lang"] for r in totals]
    if not langs:
        return {"langs": [], "size": size}
    words = -(-len(langs) // 64)
    known = spark.createDataFrame([(r["lang"], i, r["total"]) for i, r in enumerate(totals)], "lang string, number int, total long")
    rated = counts.join(known, "lang").withColumn("rate", F.col("n") / F.col("total"))
    rated = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    held = written(rated.filter(((F.col("n") >= LEAST) | (F.col("total") < ENOUGH)) & (F.col("rate") >= RATIO * F.col("most"))).select("gram", "number"), "held")
    sizes = [r["count"] for r in held.groupBy("number").count().collect()]  # one row a language
    if SLOTS_EACH * max(sizes, default=0) > MAX_SLOTS:
        return {"langs": langs, "size": size, "held": held}
    n_slots = 1 << 10
    while n_slots < min(MAX_SLOTS, SLOTS_EACH * sum(sizes)):
        n_slots *= 2
    table = np.zeros((n_slots, words), _U)
    for r in (held.coalesce(64).mapInArrow(_marked(n_slots, words), "block int, body binary").groupBy("block")
              .applyInArrow(_merged, "block int, body binary").toLocalIterator()):
        table.reshape(-1, _block(n_slots, words))[r["block"]] = np.frombuffer(r["body"], _U)
    fill = [(table[:, i // 64] >> _U(i % 64) & _U(1)).mean() for i in range(len(langs))]
    if words == 1:  # as narrow as the languages allow
        table = table[:, 0].astype(np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else _U)[:, None]
    return {"langs": langs, "size": size, "table": table, "false": np.array(fill) ** HASHES}


def _block(n_slots: int, words: int) -> int:
    return min(n_slots, 1 << 13) * words


def _marked(n_slots: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((n_slots, words), _U)
        for batch in batches:
            code = batch.column("gram").to_numpy().astype(_U)
            number = batch.column("number").to_numpy().astype(np.int64)
            for s in slots(code, n_slots):
                np.bitwise_or.at(own, (s, number // 64), _U(1) << (number % 64).astype(_U))
        blocks = own.reshape(-1, _block(n_slots, words))
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "body"])
    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    body = np.bitwise_or.reduce([np.frombuffer(x.as_py(), _U) for x in table.column("body")])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["block", "body"])


def decide(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    code, each = grams(texts, model["size"])
    n_langs = len(model["langs"])
    if not n_langs or not len(code):
        return ["und"] * len(texts), np.zeros(len(texts))
    table = model["table"]
    mask = None
    for s in slots(code, len(table)):
        mask = table[s] if mask is None else mask & table[s]
    owner = np.repeat(np.arange(len(texts)), each)
    seen = np.stack([np.bincount(owner, weights=mask[:, i // 64] >> table.dtype.type(i % 64) & table.dtype.type(1), minlength=len(texts)) for i in range(n_langs)], axis=1)
    real = np.maximum(0, (seen - each[:, None] * model["false"]) / np.maximum(1e-9, 1 - model["false"]))
    best = real.argmax(axis=1)
    total = real.sum(axis=1)
    score = np.where(total > 0, real[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 1 / n_langs)
    return [model["langs"][b] if n else "und" for b, n in zip(best, each)], np.where(each > 0, score, 0.0)


def _decided(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                lang, score = decide([t or "" for t in part.column("text").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])
    return run


def _text_grams(size: int):
    """(a, b, gram, n) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                code, each = grams([t or "" for t in part.column("text").to_pylist()], size)
                owner = np.repeat(np.arange(j - i), each)
                by = np.lexsort((code, owner))
                code, owner = code[by], owner[by]
                at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])) if len(code) else np.zeros(0, np.int64)
                a, b = (part.column(c).to_numpy()[owner[at]] for c in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, code[at].astype(np.int64), np.diff(np.append(at, len(code))))], names=["a", "b", "gram", "n"])
    return run


def _joined(docs: DataFrame, model: dict) -> DataFrame:
    """What ``decide`` says with filters that never answer wrongly."""
    langs = model["langs"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), "text"))
    counted = rows.select("a", "b", "text").dropDuplicates(["a", "b"]).mapInArrow(_text_grams(model["size"]), "a long, b long, gram long, n long")
    seen = counted.join(model["held"], "gram", "left").groupBy("a", "b", "number").agg(F.sum("n").alias("n"))
    known = F.when(F.col("number").isNotNull(), F.col("n"))
    best = F.max(F.when(F.col("number").isNotNull(), F.struct("n", (-F.col("number")).alias("k")))).alias("best")
    of = seen.groupBy("a", "b").agg(best, F.sum(known).alias("total"))
    named = F.element_at(F.array(*map(F.lit, langs)), 1 - F.coalesce("best.k", F.lit(0)).cast("int"))
    of = written(of.select("a", "b", named.alias("lang_pred"), F.coalesce(F.col("best.n") / F.col("total"), F.lit(1 / len(langs))).alias("score")), "decided")
    return rows.join(of, ["a", "b"], "left").select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def identify(docs: DataFrame, folds: int = FOLDS, size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text,
    lang), learned from its rows outside fold 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != 1)).select("lang", "text")
    learned = learn(training, size)
    if "held" in learned:
        return _joined(docs.select("doc_id", "text"), learned)
    model = docs.sparkSession.sparkContext.broadcast(learned)
    return docs.select("doc_id", "text").mapInArrow(_decided(model), "doc_id long, lang_pred string, score double")


def op9_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 1, F.lit(False))
    return identify(documents(spark, sf_dir)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_bitmask": op9_language_bitmask}
