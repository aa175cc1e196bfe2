"""Operator 6: exact removal of repeated byte strings with a logarithmic
family of sparse suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier (smaller doc_id, or the same document at an earlier byte).

* Suffixes are sampled by content: the smallest fingerprint of the q-grams in
  a window is the window's anchor, so equal windows have equal anchors. About
  one byte in forty is an anchor. The windows that share an anchor form one
  *context*: the bytes from the first of them to the end of the last.
* A suffix's sort key is (q-gram fingerprint, context fingerprint). A task
  sorts its batch by it (the batch's sparse suffix array) and settles repeats
  inside the batch; the rest goes to the bucket of its q-gram.
* A bucket keeps a logarithmic family of levels. Each arriving array is
  merge-scanned against all levels: a context found there is a long match, and
  the later of the two goes whole. What is new becomes a level, and levels of
  like size merge, so a suffix is merged log(n) times.
* Contexts that share only their q-gram may still agree in single windows.
  Only the first of each such context is looked at window by window: a second
  scan finds them by a bitmap of bounded size (its false positives add work,
  never results) and sends their bytes to the bucket of the q-gram.
* A q-gram with more than ``HOT`` contexts in a batch or bucket (the end of a
  line that a third of all documents hold) is hot: its suffixes go to the
  bucket of their context, and its windows each to a bucket of their own.

Fingerprints of contexts and windows have 64 bits, all of which are compared
(for contexts, 32 bits of their q-gram besides): two different ones are taken
as equal with a chance of about n * n / 2**65 over n compared ones.

Nulls count as empty texts; a null doc_id sorts first. Repeated rows are one
document and get the same answer; rows with one id and different texts are
documents of their own, in the order of a text hash. Memory follows the
chunk (1 MB of text, or one longer document) and the bucket (about 8 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitmap import bitmap, bits_for, contains
from .frames import buckets, documents, text_bytes, text_rows, versioned, written
from .text import Spans, chunks, flat, mix, ragged

LENGTH, QGRAM = 100, 24
HOT = 64
FLUSH = 1 << 19               # entries that a task holds before it sends them
SHIFT = 40                    # a place is version << 40 | byte
HIGH = np.uint64(0xFFFFFFFF00000000)
_U = np.uint64
MOVED = "kind byte, bucket int, body binary"
GONE, SUFFIX, FINE, BY_CONTEXT, FINE_HOT, CONTEXT, WINDOW = range(7)
# code: of a window, its fingerprint; of a context, 32 bits of its q-gram's and
# the upper half of its own, whose lower half is ``more``
# n: windows after the first (MARK: the q-gram is hot); slot: the q-gram's bucket
ENTRY = np.dtype([("code", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("at", "<i8"), ("n", "<u1"), ("slot", "<u4")])
MARK = 255


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """(row, first window, last window, code, more, q-gram, spans) of the anchors of
    a chunk; windows are byte positions in ``data``."""
    room = np.diff(offsets) - length + 1
    starts = offsets[:-1][room > 0]
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty, empty, empty, np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, _U), None
    spans = Spans(data)
    grams = spans.fixed(len(data) - q + 1, q)
    bits = int(len(data)).bit_length()
    low = _U((1 << bits) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=_U)
    span, width = length - q + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    windows = ragged(starts, room[room > 0])
    at = (least[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last, at = windows[new], windows[np.append(new[1:], len(at)) - 1], at[new]
    context = mix(spans.raw(first, last + length) + (at - first).astype(_U) * _U(0x9FB21C651E98DF25)
                  + (last - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    code = (grams[at] << _U(32)) | (context >> _U(32))
    return np.searchsorted(offsets, first, "right") - 1, first, last, code, context.astype(np.uint32), grams[at], spans


def _order(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["at"], e["doc"], e["more"], e["code"]))]


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted arrays in one, in the order of (code, more)."""
    e = np.concatenate(parts)
    e = e[np.argsort(e["code"], kind="stable")]
    if (e["code"][1:] == e["code"][:-1]).any():
        e = e[np.lexsort((e["more"], e["code"]))]
    return e


def _split(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of each (code, more), and the others."""
    e = _order(e)
    first = np.ones(len(e), bool)
    first[1:] = (e["code"][1:] != e["code"][:-1]) | (e["more"][1:] != e["more"][:-1])
    return e[first], e[~first]


def _joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed stretches (doc, begin, end), those that meet made one."""
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by], begin[by], end[by]
    if not len(doc):
        return doc, begin, end
    other = np.concatenate([[True], doc[1:] != doc[:-1]])
    far = _running_max(end, other)
    cut = np.flatnonzero(other | np.concatenate([[True], begin[1:] > far[:-1]]))
    return doc[cut], begin[cut], far[np.append(cut[1:], len(far)) - 1]


def _running_max(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running maximum that starts anew where ``new`` is set."""
    out = x.copy()
    at = np.flatnonzero(new)
    width, place = 1, np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    while width <= (place.max() if len(place) else 0):
        later = np.flatnonzero(place >= width)
        out[later] = np.maximum(out[later], out[later - width])
        width *= 2
    return out


def _gone(e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed stretches of entries whose windows all go."""
    return _joined(e["doc"], e["at"], e["at"] + e["n"] + length)


def _rows(gone: np.ndarray, length: int, n: int, *sent: tuple) -> pa.RecordBatch:
    """Removed stretches by document, and (kind, slots, entries[, bodies]) by slot."""
    rows, found = [], _gone(gone, length)
    slot = found[0] % n
    by = np.argsort(slot, kind="stable")
    slot, found = slot[by], [x[by] for x in found]
    at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
    for i, j in zip(at, np.append(at[1:], len(slot)) if len(slot) else []):
        rows.append((GONE, -1 - int(slot[i]), b"".join(x[i:j].tobytes() for x in found)))
    for kind, slot, e, *text in sent:
        by = np.argsort(slot, kind="stable")
        slot, e = slot[by], e[by]
        at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
        for i, j in zip(at, np.append(at[1:], len(slot)) if len(slot) else []):
            body = columns(e[i:j])
            if text:
                body = (j - i).tobytes() + body + b"".join(text[0][k] for k in by[i:j])
            rows.append((kind, int(slot[i]), body))
    kinds, slots, bodies = zip(*rows) if rows else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), pa.array(slots, pa.int32()), pa.array(bodies, pa.binary())],
                                      names=["kind", "bucket", "body"])


def _spread(e: np.ndarray, n: int) -> np.ndarray:
    """A slot by all of an entry's code."""
    return ((mix(e["code"]) >> _U(20)) % _U(n)).astype(np.int64)


def _runs(gram: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array, how many have its q-gram."""
    if not len(gram):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    each = np.diff(np.append(at, len(gram)))
    return np.repeat(each, each)


def columns(e: np.ndarray) -> bytes:
    """Entries column by column, which Spark's shuffle compresses well."""
    return b"".join(e[k].tobytes() for k in ENTRY.names)


def entries(body: bytes, n: int | None = None, at: int = 0) -> np.ndarray:
    n = len(body) // ENTRY.itemsize if n is None else n
    out = np.empty(n, ENTRY)
    for k in ENTRY.names:
        out[k] = np.frombuffer(body, ENTRY[k], n, at)
        at += n * ENTRY[k].itemsize
    return out


def _scan(batch: pa.RecordBatch, length: int, q: int, n: int):
    """(entries, bytes, chunk's spans, first windows) for each chunk of a batch."""
    data, offsets = flat(batch.column("text"))
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
    base = batch.column("version").to_numpy(zero_copy_only=False) << SHIFT
    for a, b in chunks(offsets):
        at = offsets[a:b + 1] - offsets[a]
        part = data[offsets[a]:offsets[b]]
        row, first, last, code, more, gram, spans = anchors(part, at, length, q)
        e = np.empty(len(row), ENTRY)
        e["code"], e["more"], e["doc"], e["n"], e["slot"] = code, more, docs[a:b][row], last - first, gram % _U(n)
        e["at"] = base[a:b][row] + first - at[row]
        yield e, part, spans, first


def batch_arrays(n: int, length: int, q: int):
    """Sorted sparse suffix arrays of each batch, cut by bucket."""
    def send(found: list[np.ndarray]) -> pa.RecordBatch:
        first, again = _split(np.concatenate(found))
        hot = _runs(first["code"] & HIGH) > HOT
        by_context, first = first[hot], first[~hot]
        marks = by_context[np.unique(by_context["code"] & HIGH, return_index=True)[1]].copy()
        marks["n"] = MARK
        first = np.concatenate([first, marks])
        return _rows(again, length, n, (SUFFIX, first["slot"], first), (BY_CONTEXT, _spread(by_context, n), by_context))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for e, *_ in _scan(batch, length, q, n):
                found.append(e)
                held += len(e)
                if held >= FLUSH:
                    yield send(found)
                    found, held = [], 0
        if held:
            yield send(found)
    return run


class Levels:
    """Logarithmic index family: sorted arrays of growing size."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, new: np.ndarray) -> np.ndarray:
        """Merge-scan ``new`` (sorted, each (code, more) once) against every level;
        returns the entries found to be later copies."""
        later = []
        for level in self.levels:
            at, codes, more = np.searchsorted(level["code"], new["code"]), level["code"], level["more"]
            at[at == len(level)] = 0
            hit = codes[at] == new["code"]
            on = np.flatnonzero(hit & (more[at] < new["more"]))
            while len(on):  # past other contexts of the same code
                at[on] += 1
                hit[on] = at[on] < len(level)
                at[on[~hit[on]]] = 0
                hit[on] &= codes[at[on]] == new["code"][on]
                on = on[hit[on] & (more[at[on]] < new["more"][on])]
            hit &= more[at] == new["more"]
            if hit.any():
                old, mine = level[at[hit]], new[hit]
                newer = (mine["doc"] > old["doc"]) | ((mine["doc"] == old["doc"]) & (mine["at"] > old["at"]))
                same = (mine["doc"] == old["doc"]) & (mine["at"] == old["at"])  # a repeated row
                later += [mine[newer], old[~newer & ~same]]
                level[at[hit][~newer]] = mine[~newer]
                new = new[~hit]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = _merged([self.levels.pop(), new])
        if len(new):
            self.levels.append(new)
        return np.concatenate(later) if later else np.empty(0, ENTRY)

    def all(self) -> np.ndarray:
        return _merged(self.levels or [np.empty(0, ENTRY)])


def _family(bodies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feed arriving arrays to a level family: (kept, later copies, hot grams)."""
    family, later, marks = Levels(), [np.empty(0, ENTRY)], [np.zeros(0, _U)]
    for body in bodies:
        new = _order(entries(body.as_py()))
        mark = new["n"] == MARK
        marks.append(new["code"][mark] & HIGH)
        later.append(family.add(new[~mark]))
    return family.all(), np.concatenate(later), np.unique(np.concatenate(marks))


def merge_bucket(length: int, n: int):
    """One bucket: its arrays join the level family one by one. Entries whose
    q-gram has other contexts are to be looked at window by window."""
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        of = lambda kind: table.filter(pa.array(kinds == kind))
        kept, later, marks = _family(of(SUFFIX).column("body"))
        gram = kept["code"] & HIGH
        runs = _runs(gram)
        hot = (runs > HOT) | np.isin(gram, marks)
        spread, more, _ = _family(of(BY_CONTEXT).column("body"))
        fine, hot = kept[(runs > 1) & ~hot], np.concatenate([kept[hot], spread])
        zero = lambda e: np.zeros(len(e), np.int64)
        out = pa.Table.from_batches([_rows(np.concatenate([later, more]), length, n, (FINE, zero(fine), fine), (FINE_HOT, zero(hot), hot))])
        return pa.concat_tables([of(GONE).cast(out.schema), out])
    return run


def merge_windows(length: int, n: int):
    """Windows of one bucket: all but the first of each content go."""
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        of = lambda kind: table.filter(pa.array(kinds == kind))
        _, later, _ = _family(of(WINDOW).column("body"))
        gone = [later]
        found, data, sizes = [np.empty(0, ENTRY)], [], []
        for body in of(CONTEXT).column("body"):
            body = body.as_py()
            m = int(np.frombuffer(body, np.int64, 1)[0])
            found.append(entries(body, m, 8))
            data.append(np.frombuffer(body, np.uint8, offset=8 + m * ENTRY.itemsize))
        e = np.concatenate(found)
        if len(e):
            data = np.concatenate(data)
            sizes = e["n"].astype(np.int64) + length
            starts = np.cumsum(sizes) - sizes
            by = np.argsort(e["code"], kind="stable")
            e, starts, sizes = e[by], starts[by], sizes[by]
            gram = e["code"] & HIGH
            cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            i = 0
            while i < len(cuts):  # whole q-grams, about 4,000 contexts at a time
                j = min(len(cuts), max(i + 1, int(np.searchsorted(cuts, cuts[i] + 4000))))
                a, b = cuts[i], cuts[j] if j < len(cuts) else len(e)
                gone.append(_split(_windows(e[a:b], data[ragged(starts[a:b], sizes[a:b])], None, length))[1])
                i = j
        out = pa.Table.from_batches([_rows(np.concatenate(gone), length, n)])
        return pa.concat_tables([of(GONE).cast(out.schema), out])
    return run


def _windows(e: np.ndarray, data: np.ndarray, first: np.ndarray | None, length: int, spans: Spans | None = None) -> np.ndarray:
    """An entry for each window of the contexts ``e``, which begin at ``first``
    in ``data`` or lie there one after another."""
    each = e["n"].astype(np.int64) + 1
    if first is None:
        first = np.cumsum(each + length - 1) - (each + length - 1)
    at = ragged(first, each)
    w = np.zeros(len(at), ENTRY)
    w["code"], w["doc"] = (spans or Spans(data)).of(at, at + length), np.repeat(e["doc"], each)
    w["at"] = np.repeat(e["at"] - first, each) + at
    return w


def _place(e: np.ndarray) -> np.ndarray:
    return e["doc"].astype(_U) * _U(0x9E3779B97F4A7C15) + e["at"].astype(_U)


def _gram(e: np.ndarray) -> np.ndarray:
    return (e["code"] >> _U(32)) * _U(0xC2B2AE3D27D4EB4F) + e["slot"].astype(_U)


def taken(key):
    """Bitmap keys of all entries of a batch of bodies."""
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        found = [key(entries(body.as_py())) for body in batch.column("body")]
        return np.concatenate(found) if found else np.zeros(0, _U)
    return keys


def single_windows(n: int, length: int, q: int, places, hot_grams):
    """The marked contexts: their bytes by q-gram, or their windows if hot."""
    def send(contexts: list, text: list, windows: list) -> pa.RecordBatch:
        first, again = _split(np.concatenate([np.empty(0, ENTRY), *windows]))
        c = np.concatenate([np.empty(0, ENTRY), *contexts])
        return _rows(again, length, n, (CONTEXT, c["slot"], c, text), (WINDOW, _spread(first, n), first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, hot_marked = np.frombuffer(places.value, np.uint8), np.frombuffer(hot_grams.value, np.uint8)
        contexts, text, windows, held = [], [], [], 0
        for batch in batches:
            for e, data, spans, first in _scan(batch, length, q, n):
                hit = contains(marked, _place(e))
                hot = hit & contains(hot_marked, _gram(e))
                cold = np.flatnonzero(hit & ~hot)
                contexts.append(e[cold])
                text += [data[a:b].tobytes() for a, b in zip(first[cold], first[cold] + e["n"][cold] + length)]
                if hot.any():
                    windows.append(_split(_windows(e[hot], data, first[hot], length, spans)))
                    yield _rows(windows[-1][1], length, n)
                    windows[-1] = windows[-1][0]
                held += 8 * len(cold) + (len(windows[-1]) if hot.any() else 0)
                if held >= FLUSH:
                    yield send(contexts, text, windows)
                    contexts, text, windows, held = [], [], [], 0
        if held:
            yield send(contexts, text, windows)
    return run


def by_document(table: pa.Table) -> pa.Table:
    """All removed stretches of a slot's documents, one row a document."""
    parts = [np.frombuffer(x.as_py(), np.int64).reshape(3, -1) for x in table.column("body")]
    doc, begin, end = _joined(*np.concatenate(parts, axis=1))
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    cells = [np.stack([begin[i:j], end[i:j]]).tobytes() for i, j in zip(at, np.append(at[1:], len(doc)))]
    return pa.table([pa.array(doc[at]), pa.array(cells, pa.binary())], names=["doc_id", "gone"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        versions = batch.column("version").to_numpy(zero_copy_only=False)
        gone, runs, kept = [], [], []
        for i, found in enumerate(batch.column("gone")):
            body, at = data[offsets[i]:offsets[i + 1]], versions[i] << SHIFT
            begin, end = np.frombuffer(found.as_py() or b"", np.int64).reshape(2, -1)
            mine = begin >> SHIFT == versions[i]
            begin, end = begin[mine] - at, end[mine] - at
            keep = zip(np.concatenate([[0], end]), np.append(begin, len(body)))
            gone.append(int((end - begin).sum())), runs.append(len(begin))
            kept.append(b"".join(body[a:b].tobytes() for a, b in keep))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _entries(bodies: DataFrame) -> int:
    return int(bodies.agg(F.sum(F.length("body"))).first()[0] or 0) // ENTRY.itemsize


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed,
    n_spans and ``kept``, the bytes that stay."""
    spark = docs.sparkSession
    docs = versioned(text_rows(docs))
    n = buckets(spark, text_bytes(docs) // 2)
    arrays = docs.mapInArrow(batch_arrays(n, length, q), MOVED)
    first = written(arrays.groupBy("bucket").applyInArrow(merge_bucket(length, n), MOVED), "suffix-levels")
    fine, hot = (first.filter(F.col("kind").isin(kinds)).select("body") for kinds in ([FINE, FINE_HOT], [FINE_HOT]))
    parts = [first.filter(F.col("kind") == GONE)]
    places = _entries(fine)
    if places:
        marks = (bitmap(fine, taken(_place), bits_for(places)), bitmap(hot, taken(_gram), bits_for(_entries(hot))))
        windows = docs.mapInArrow(single_windows(n, length, q, *map(spark.sparkContext.broadcast, marks)), MOVED)
        parts.append(windows.groupBy("bucket").applyInArrow(merge_windows(length, n), MOVED))
    gone = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    gone = gone.groupBy("bucket").applyInArrow(by_document, "doc_id long, gone binary")
    out = docs.join(gone, "doc_id", "left").select("doc_id", "version", "text", "gone")
    return (out.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumn("doc_id", F.expr("nullif(doc_id, -9223372036854775808)")))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
