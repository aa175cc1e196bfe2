"""Operator 12: texts scored by a hashed maximum-entropy language model.

The outcomes are the most frequent words and a *tail* of all others; words of
similar rank share a class, and the softmax is factored by class:

    P(w | h) = P(class(w) | h) * P(w | class(w), h)        w in the list
    P(w | h) = P(tail | h) * (c(w) + a) / tail mass        all others

Both softmaxes add the rows that the features of the history hash to: for classes the
last word and the word before it (a skip feature), for the words of a class the
last word and both together. Biases are the logarithms of smoothed counts, so
a model without updates is the smoothed unigram model, and the tail goes by
counts of all training words.

Training is by distributed gradient updates. The training documents are dealt
into ``ROUNDS`` parts by a hash of id and text, and those to tasks in the order
of that hash, so the model does not depend on how rows lie. In a round every
task starts from the broadcast weights, makes AdaGrad steps over batches of its
tokens and sends what its rows changed; the changes of a row are averaged over
the tasks that touched it, 32 tasks at a time. Every training document is seen
once. Texts are scored in sparse batches: a token reads the rows of its
features only.

Counts are exact and cover all training texts: words are counted in the tasks
and summed by a shuffle. The ``HOT`` most frequent ones travel to the tasks (a
few MB); other words of a document are joined to the counts, once for each
document. A word that a third of all rows hold is hot and never shuffled.

Sizes that bound memory and are parameters of the model: ``HOT``, the list
(31 classes of 32 words), and the rows of the two tables (5 MB).

Null texts are empty: only the end. Rows without an id do not teach and are not
held out. Repeated rows are scored row by row, and repeated training rows teach
as often. Without training rows every token scores log10(0.1 / 0.1) = 0. Equal
counts rank by bytes. Long texts are split at blanks, a MB at a time. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import documents, text_bytes, text_rows, written
from .text import mix

FOLDS, ROUNDS, SEED = 10, 3, 12
ADD = 0.1                       # to every count
KINDS, WIDTH = 32, 32           # classes, and words of a class
TAIL = KINDS - 1                # the class of all words beyond the list
LISTED = TAIL * WIDTH
HOT = 1 << 17
CONTEXTS = 1 << 12              # codes of words in a history: the list, hashes of others, the start
START = CONTEXTS - 1
PAIRS = 1 << 14                 # hashed rows of two words (and of a word and a class)
BATCH, RATE, DECAY = 8192, 0.6, 1e-3
TASK_BYTES = 16 << 20           # of text that a training task takes in a round; at least TASKS take part
TASKS = 6
TOGETHER = 32                   # tasks whose changes are averaged at once
SPREAD = 256                    # rows of a table that travel together
FLUSH = 600_000                 # words that a task counts before it sends them
PIECE = 1 << 20
LONG = 24                       # bytes of a word that is named by its digest
END = b""                       # no word is empty
TABLE = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHANGED = "task int, rows int, n binary, body binary"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"
_U = np.uint64
_NEVER = np.float32(-1e9)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = (text or "").encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def key_of(word: bytes) -> bytes:
    """The word, or for long ones a digest behind a byte that no text has."""
    return word if len(word) <= LONG else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def send() -> pa.RecordBatch:
        for w in [w for w in seen if len(w) > LONG]:
            seen[key_of(w)] += seen.pop(w)
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["key", "c"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            for words in words_of(text.as_py()):
                seen.update(words)
                if len(seen) > FLUSH:
                    yield send()
            seen[END] += 1
    yield send()


class Vocabulary:
    """Hot words by rank with their counts; what a word is in a history."""

    def __init__(self, keys: list[bytes], counts: list[int], total: int, distinct: int) -> None:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] != END, -counts[i], keys[i]))
        self.rank = {keys[i]: r for r, i in enumerate(order)}
        self.counts = np.array([counts[i] for i in order], np.float64)
        self.total, self.distinct = total, distinct
        self.listed = min(LISTED, len(keys))
        self.mass = total + ADD * (distinct + 1)
        self.tail = float(total - self.counts[:self.listed].sum()) + ADD * (distinct - self.listed + 1)
        self.base = np.log10((self.counts + ADD) / self.mass)
        # biases of classes and of the words in them
        share = np.zeros(LISTED)
        share[:self.listed] = self.counts[:self.listed] + ADD
        share = share.reshape(TAIL, WIDTH)
        self.of_class = np.full(KINDS, _NEVER)
        self.of_word = np.full((KINDS, WIDTH), _NEVER)
        sums = np.append(share.sum(axis=1), self.tail)
        self.of_class[sums > 0] = np.log(sums[sums > 0] / sums.sum())
        for k in np.flatnonzero(sums[:TAIL] > 0):
            some = share[k] > 0
            self.of_word[k, some] = np.log(share[k, some] / sums[k])

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Ranks of hot words; for all others -1 - (a hash in the contexts)."""
        rank = self.rank
        out = np.fromiter(map(rank.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            long = rank.get(key_of(words[i]), -1) if len(words[i]) > LONG else -1
            out[i] = long if long >= 0 else -1 - (LISTED + zlib.crc32(words[i]) % (START - LISTED))
        return out

    def contexts(self, codes: np.ndarray) -> np.ndarray:
        beyond = codes >= self.listed
        out = np.where(codes < 0, -1 - codes, codes)
        out[beyond] = LISTED + (mix(codes[beyond].astype(_U)) % _U(START - LISTED)).astype(np.int64)
        return out


def features(codes: np.ndarray, begin: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word, word before, both) of each token; ``begin`` marks the first
    tokens of texts."""
    own = voc.contexts(codes)
    last, before = np.full(len(own), START), np.full(len(own), START)
    last[1:], before[2:] = own[:-1], own[:-2]
    last[begin], before[begin] = START, START
    second = np.zeros(len(own), bool)
    second[1:] = begin[:-1]
    before[second] = START
    return last, before, mix((last * CONTEXTS + before).astype(_U))


class Model:
    """Rows for classes: the last word, the skipped word; rows for words: the
    last word and the class, both words and the class (hashed)."""

    def __init__(self, voc: Vocabulary) -> None:
        self.voc = voc
        self.classes = np.zeros((2 * CONTEXTS, KINDS), np.float32)
        self.words = np.zeros((2 * PAIRS, WIDTH), np.float32)
        self.of_class, self.of_word = voc.of_class.astype(np.float32), voc.of_word.astype(np.float32)

    def class_rows(self, last: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        return [last, CONTEXTS + before]

    def word_rows(self, last: np.ndarray, both: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
        k = (kind + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
        return [(mix(last.astype(_U) ^ k) % _U(PAIRS)).astype(np.int64), PAIRS + (mix(both ^ k) % _U(PAIRS)).astype(np.int64)]

    def class_logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = self.classes[rows[0]]
        out += self.classes[rows[1]]
        out += self.of_class
        return out

    def word_logits(self, rows: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
        out = self.words[rows[0]]
        out += self.words[rows[1]]
        out += self.of_word[kind]
        return out

    def log10(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 of P(class) * P(word | class) of listed tokens, of P(tail) of
        all others."""
        last, before, both = features(codes, begin, self.voc)
        listed = (codes >= 0) & (codes < self.voc.listed)
        kind, word = np.where(listed, codes // WIDTH, TAIL), codes % WIDTH
        out = _taken(self.class_logits(self.class_rows(last, before)), kind)
        some = np.flatnonzero(listed)
        out[some] += _taken(self.word_logits(self.word_rows(last[some], both[some], kind[some]), kind[some]), word[some])
        return out / np.log(10)


def _taken(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at one place of each row (overwritten)."""
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at].astype(np.float64)
    return own - np.log((np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)).astype(np.float64))


def gradient(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the log-likelihood, by the logits (overwritten)."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= -1 / logits.sum(axis=1, keepdims=True)
    logits[np.arange(len(at)), at] += 1
    return logits


def _by_run(rows: np.ndarray, grad: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the gradients of each row, rows): fast where rows repeat. Summing
    along contiguous tokens is far faster than along rows."""
    by = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
    own = rows[by]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return np.add.reduceat(np.ascontiguousarray(grad[by].T), at, axis=1).T, own[at]


def _by_count(rows: np.ndarray, grad: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where few rows repeat."""
    held = np.zeros(n, bool)
    held[rows] = True
    own = np.flatnonzero(held)
    number, width = np.empty(n, np.int64), grad.shape[1]
    number[own] = np.arange(len(own)) * width
    cells = (number[rows][:, None] + np.arange(width)).ravel()
    return np.bincount(cells, grad.ravel(), len(own) * width).astype(np.float32).reshape(-1, width), own


class Trainer:
    """AdaGrad steps from given weights; one step size for a row."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.first = {"classes": model.classes.copy(), "words": model.words.copy()}
        self.squares = {k: np.full(len(v), DECAY, np.float32) for k, v in self.first.items()}

    def _climb(self, table: str, rows: list[np.ndarray], grad: np.ndarray) -> None:
        weights, squares = getattr(self.model, table), self.squares[table]
        for r in rows:
            total, own = (_by_run if table == "classes" else _by_count)(r, grad, len(weights))
            squares[own] += np.einsum("ij,ij->i", total, total)
            weights[own] += total * (RATE / np.sqrt(squares[own]))[:, None]

    def step(self, codes: np.ndarray, begin: np.ndarray) -> None:
        m = self.model
        last, before, both = features(codes, begin, m.voc)
        listed = (codes >= 0) & (codes < m.voc.listed)
        kind, word = np.where(listed, codes // WIDTH, TAIL), codes % WIDTH
        rows = m.class_rows(last, before)
        self._climb("classes", rows, gradient(m.class_logits(rows), kind))
        some = np.flatnonzero(listed)
        if len(some):
            rows = m.word_rows(last[some], both[some], kind[some])
            self._climb("words", rows, gradient(m.word_logits(rows, kind[some]), word[some]))

    def changes(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(first row, tasks that touched each row, changes) of both tables."""
        base = 0
        for table in ("classes", "words"):
            now, then, touched = getattr(self.model, table), self.first[table], self.squares[table] > DECAY
            for a in range(0, len(now), SPREAD):
                n = touched[a:a + SPREAD]
                if n.any():
                    yield base + a, n.astype("<i4").tobytes(), (now[a:a + SPREAD] - then[a:a + SPREAD])[n].astype("<f2").tobytes()
            base += len(now)


def token_batches(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, first tokens) of about BATCH tokens; histories do not reach
    across batches."""
    codes: list[np.ndarray] = []
    begin: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for text in batch.column("text"):
            parts = [*(voc.codes(words) for words in words_of(text.as_py())), np.array([voc.rank.get(END, -1)], np.int64)]
            own = np.concatenate(parts)
            first = np.zeros(len(own), bool)
            first[0] = True
            for a in range(0, len(own), BATCH):
                codes.append(own[a:a + BATCH])
                begin.append(first[a:a + BATCH])
                n += len(codes[-1])
                if n >= BATCH:
                    yield np.concatenate(codes), np.concatenate(begin)
                    codes, begin, n = [], [], 0
    if n:
        yield np.concatenate(codes), np.concatenate(begin)


_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _trained(sent, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(_model(sent, copy=True))
        for codes, begin in token_batches(batches, trainer.model.voc):
            trainer.step(codes, begin)
        task = TaskContext.get().partitionId() % tasks
        for change in trainer.changes():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((task, *change), _TYPES)], names=["task", "rows", "n", "body"])
    return run


def _sums(n: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, held = np.frombuffer(n, "<i4"), np.frombuffer(body, "<f2")
    some = np.count_nonzero(n)
    out = np.zeros((len(n), len(held) // some), np.float32)
    out[n > 0] = held.reshape(some, -1)
    return n, out * n[:, None]


def _averaged(key: tuple, table: pa.Table) -> pa.Table:
    """The changes of up to TOGETHER tasks as one, weighted by tasks."""
    n, total = 0, 0
    table = table.sort_by("task")  # sums of floats depend on their order
    for a, b in zip(table.column("n"), table.column("body")):
        one, changes = _sums(a.as_py(), b.as_py())
        n, total = n + one, total + changes
    mean = total[n > 0] / n[n > 0][:, None]
    row = (key[1].as_py(), key[0].as_py(), n.astype("<i4").tobytes(), mean.astype("<f2").tobytes())
    return pa.table([pa.array([x], t) for x, t in zip(row, _TYPES)], names=["task", "rows", "n", "body"])


def _model(sent, copy: bool = False) -> Model:
    """The broadcast model; ``copy`` where weights change."""
    model = sent.value
    if copy:
        own = Model(model.voc)
        own.classes[:], own.words[:] = model.classes, model.words
        return own
    return model


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = counts.orderBy(F.col("key") != END, F.desc("c"), "key").limit(HOT).toArrow()
    return Vocabulary(hot.column("key").to_pylist(), hot.column("c").to_pylist(), total, distinct)


def train(teaching: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model from all rows of ``teaching`` (doc_id, text)."""
    spark = teaching.sparkSession
    model = Model(voc)
    if not voc.listed:
        return model
    tasks = max(TASKS, -(-text_bytes(teaching) // (TASK_BYTES * rounds)))
    teaching = teaching.select("text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"))
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        # a session may deal keys to more partitions; each would send changes of its own
        part = teaching.filter(F.pmod("h", F.lit(rounds)) == i).repartition(tasks, "h").coalesce(tasks).sortWithinPartitions("h", "text")
        changes = part.select("text").mapInArrow(_trained(sent, tasks), CHANGED)
        left = tasks
        while left > 1:  # no group is larger than TOGETHER tasks
            changes = changes.groupBy("rows", F.floor(F.col("task") / TOGETHER).cast("int").alias("part")).applyInArrow(_averaged, CHANGED)
            left = -(-left // TOGETHER)
        new = Model(voc)
        new.classes[:], new.words[:] = model.classes, model.words
        size = len(new.classes)
        for r in changes.select("rows", "n", "body").toLocalIterator():  # the model's own size
            n = np.frombuffer(r["n"], "<i4")
            table, a = (new.classes, r["rows"]) if r["rows"] < size else (new.words, r["rows"] - size)
            table[a + np.flatnonzero(n)] += np.frombuffer(r["body"], "<f2").reshape(-1, table.shape[1])
        model = new
        sent.destroy()
    return model


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        voc = model.voc
        row = TaskContext.get().partitionId() << 33
        # log10 of (mass / tail mass): from a word's share of all to its share of the tail
        up = np.log10(voc.mass / voc.tail)
        missing = np.log10(ADD / voc.mass)
        for batch in batches:
            texts, ends = [], [0]
            out: dict[str, list] = {"n": [], "known": [], "base": [], "model": [], "words": [], "times": []}

            def flush() -> None:
                codes = np.concatenate(texts)
                begin = np.zeros(len(codes), bool)
                begin[ends[:-1]] = True
                value = np.zeros(len(codes))
                for a in range(0, len(codes), BATCH):
                    b = max(0, a - 2)  # the history of the slice
                    value[a:a + BATCH] = model.log10(codes[b:a + BATCH], begin[b:a + BATCH])[a - b:]
                hot, listed = codes >= 0, (codes >= 0) & (codes < voc.listed)
                base = np.zeros(len(codes))
                base[hot] = voc.base[codes[hot]]
                value += np.where(listed, 0, up + base)
                at = np.array(ends[:-1])
                for name, each in (("known", hot.astype(np.int64)), ("base", base), ("model", value)):
                    out[name].extend(np.add.reduceat(each, at).tolist())
                texts.clear()
                ends[:] = [0]

            for text in batch.column("text"):
                own, rare = [], Counter()
                for words in words_of(text.as_py()):
                    codes = voc.codes(words)
                    rare.update([key_of(words[i]) for i in np.flatnonzero(codes < 0).tolist()])
                    own.append(codes)
                end = voc.rank.get(END, -1)
                own.append(np.array([end], np.int64))
                texts.append(np.concatenate(own))
                ends.append(ends[-1] + len(texts[-1]))
                out["n"].append(len(texts[-1]))
                if end < 0:  # nothing teaches
                    rare[END] += 1
                out["words"].append(list(rare))
                out["times"].append(list(rare.values()))
                if ends[-1] >= 1 << 17:
                    flush()
            if texts:
                flush()
            n = batch.num_rows
            # unknown words count as unseen here; those that are only not hot are mended by the join
            unseen = np.array([sum(t) for t in out["times"]], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()),
                 pa.array(np.array(out["base"]) + unseen * missing), pa.array(np.array(out["model"]) + unseen * missing),
                 pa.array(out["words"], pa.list_(pa.binary())), pa.array(out["times"], pa.list_(pa.int64()))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "words", "times"])
            row += n
    return run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; null for rows without an id."""
    return F.crc32(doc_id.cast("string")) % folds


def score_texts(docs: DataFrame, folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = text_rows(docs)
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    teaching = docs.filter(fold(F.col("doc_id"), folds) != 0)
    counts = written(teaching.select("text").mapInArrow(_counted, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c")), "word-counts")
    voc = vocabulary(counts)
    sent = spark.sparkContext.broadcast(train(teaching, voc, rounds))
    rows = written(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_scored(sent), SCORED), "scored")
    # words that are not hot: their counts, once for each document
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    found = rare.join(counts, "key").select("row", "times", (F.col("times") * F.log10((F.col("c") + ADD) / ADD)).alias("more"))
    mended = found.groupBy("row").agg(F.sum("times").alias("known"), F.sum("more").alias("more"))
    out = rows.drop("words", "times").join(mended, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"))


def op12_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


QUERIES = {"op12_hashed_maxent": op12_hashed_maxent}
