"""Operator 2: similarity self-join on word shingles by PartEnum signatures.

Documents are sets of 5-word shingles (64-bit fingerprints). With a threshold
t, sets of sizes a and b that link differ in at most (a + b)(1 - t)/(1 + t)
elements. PartEnum makes this a search for equal signatures:

* Sizes fall into bands (powers of two). A band cuts the shingle domain into
  as many parts as its smallest size; a signature is one part's content. A set
  signs for its own band and for that of its largest possible partner, so any
  two linkable sets sign in a common band.
* A differing element spoils one part. A set that signs p non-empty parts and
  may differ by k elements therefore shares at least p - k signatures with
  each partner. In any common order of the signatures, the first k + 1 of both
  sets have one in common. The order used is by number of sets that hold the
  signature (rarest first), counted over all sets: a set with more than k
  signatures of its own has no partner and leaves, and passages that many
  documents share stay unused.
* Sets of under 32 shingles, and the rare ones with p <= k, sign every shingle
  by itself (the finest partition), for which p > k always holds.

Equal sets count once throughout. Sets that share a used signature, directly or
over others, form a candidate group. Groups of up to ``BLOCK`` sets are solved
where they meet: one product of their shingle matrix gives all intersections
exactly. Larger groups are cut into blocks. Every block is first compared with
one of them, which connects what is well connected; then only sets outside a
group's largest component so far are compared, in blocks, with all others. So
every pair that shares a signature is compared or already connected, no pairs
are written out, and a group of many near copies costs in proportion to its
size.

A signature that a batch holds more than 32 times goes straight to the sets
that hold it, and its bucket gets only a mark, so no bucket or task gathers a
hot signature's sets.

Null or blank texts are empty sets: n_shingles 0, linked with nothing. A null
doc_id gets the component of its set, but never names one. Repeated rows are
answered row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitmap import bitmap, bits_for, contains
from .components import components
from .frames import buckets, documents, text_bytes, text_rows, written
from .text import LOWER, Spans, chunks, flat, mix, word_spans

WORDS, NUM, DEN = 5, 75, 100
SMALL, FINEST = 32, 60
HOT_IN_BATCH, MARK = 32, 255
FLUSH = 1 << 19               # signatures that a task holds before it sends them
BUCKET_BYTES = 16 << 20       # of text, whose signatures meet in one bucket
MAX_BROADCAST = 1_000_000     # rows of (set, group), 24 MB
BLOCK = 64                    # sets of a group that are compared in one task
MANY = np.uint32(0xFFFFFFFF)
SIG_BITS = np.uint64(40)
_U = np.uint64
_C = mix(np.arange(1, 65, dtype=_U))
MOVED = "kind byte, bucket int, body binary"
DOCS, SIGNED, SHARED = 0, 1, 2
DOC = np.dtype([("doc", "<i8"), ("null", "<u1"), ("h", "<i8"), ("n", "<i8"), ("key", "<u8"), ("p1", "<i4"), ("p2", "<i4")])
SIG = np.dtype([("sig", "<u8"), ("key", "<u8"), ("count", "<u4"), ("e", "<u1")])


def spoiled(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements by which a set of n and a partner can differ."""
    return (n + n * den // num) * (den - num) // (den + num)


def band(n: np.ndarray) -> np.ndarray:
    """log2 of the number of parts for sets of n elements."""
    e = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.where(n < SMALL, FINEST, e)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows, number of each row)."""
    rows = len(offsets) - 1
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    if not len(start):
        return np.zeros(0, _U), np.zeros(rows, np.int64)
    word = Spans(low).of(start, end)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    total = np.zeros(max(0, len(word) - words + 1), _U)
    for j in range(words):
        total += word[j:j + len(total)] * _C[j]
    whole = row[:len(total)] == row[words - 1:] if len(total) else np.zeros(0, bool)
    parts, owners = [mix(total[whole])], [row[:len(total)][whole]]
    for m in range(1, words):  # shorter rows: the whole sequence
        few = np.flatnonzero(n == m)
        if len(few):
            t = np.full(len(few), m, _U) * _C[words + m]
            for j in range(m):
                t += word[first[few] + j] * _C[j]
            parts.append(mix(t)), owners.append(few)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        by = np.argsort(owner, kind="stable")
        value, owner = value[by], owner[by]
    each = np.bincount(owner, minlength=rows)
    at = np.concatenate([[0], np.cumsum(each)])
    for a, b in zip(at[:-1], at[1:]):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.bincount(owner[keep], minlength=rows)


def set_keys(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; 0 for empty sets."""
    out = np.zeros(len(n), _U)
    full = n > 0
    if full.any():
        at = (np.cumsum(n) - n)[full]
        out[full] = mix(np.add.reduceat(mix(value ^ _C[20]), at) + n[full].astype(_U) * _C[21]) | _U(1)
    return out


def signatures(value: np.ndarray, n: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all rows, number of each row); ``e``: log2 of the parts.
    Rows are non-empty and sorted, so a part is a run of equal leading bits."""
    part = value >> (_U(64) - np.repeat(e.astype(_U), n))
    new = np.ones(len(value), bool)
    new[1:] = part[1:] != part[:-1]
    new[np.cumsum(n) - n] = True
    at = np.flatnonzero(new)
    row = np.repeat(np.arange(len(n)), n)[at]
    sig = mix(np.add.reduceat(mix(value + _C[22]), at) + part[at] * _C[23] + e.astype(_U)[row] * _C[24])
    return sig, np.bincount(row, minlength=len(n))


def _batch(kind: list, bucket: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())],
                                      names=["kind", "bucket", "body"])


def _columns(a: np.ndarray) -> bytes:
    return b"".join(a[k].tobytes() for k in a.dtype.names)


def _records(body: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(body) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for k in dtype.names:
        out[k] = np.frombuffer(body, dtype[k], n, at)
        at += n * dtype[k].itemsize
    return out


def _by(slot: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(slot, the arrays' rows of that slot) in the rows' order."""
    by = np.argsort(slot.astype(np.uint16) if len(slot) and slot.max() < 65536 else slot, kind="stable")
    slot, arrays = slot[by], [a[by] for a in arrays]
    at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
    for i, j in zip(at, np.append(at[1:], len(slot)) if len(slot) else []):
        yield int(slot[i]), *(a[i:j] for a in arrays)


class Signed:
    """Signatures and documents that a task has made and not yet sent."""

    def __init__(self) -> None:
        self.docs, self.sigs, self.owners, self.keys, self.es = [], [], [], [], []
        self.known = self.held = 0

    def add(self, d: np.ndarray, new: np.ndarray, value: np.ndarray, n: np.ndarray, num: int, den: int) -> None:
        """Sign the ``new`` rows of a chunk (documents ``d``, sets ``value``)."""
        self.docs.append(d)
        rows = np.flatnonzero(new)
        if not len(rows):
            return
        value, m, key = value[np.repeat(new, n)], n[rows], d["key"][rows]
        own, far, k = band(m), band(m * den // num), spoiled(m, num, den)
        weak = np.zeros(len(rows), bool)
        for field, e in (("p1", own), ("p2", far), ("", np.full(len(rows), FINEST))):
            some = np.ones(len(rows), bool) if field == "p1" else far != own if field == "p2" else weak
            if not some.any():
                continue
            sig, p = signatures(value[np.repeat(some, m)], m[some], e[some])
            if field:
                d[field][rows[some]] = p
                weak[some] |= (p <= k[some]) & (e[some] != FINEST)
            self.sigs.append(sig), self.owners.append((self.known + np.repeat(np.arange(len(p)), p)).astype(np.uint32))
            self.keys.append(key[some]), self.es.append(e[some].astype(np.uint8))
            self.known += len(p)
            self.held += len(sig)

    def batch(self, n: int) -> pa.RecordBatch:
        kinds, slots, bodies = [], [], []
        docs = np.concatenate(self.docs)
        for slot, some in _by(((docs["key"] >> _U(8)) % _U(n)).astype(np.int64), docs):
            kinds.append(DOCS), slots.append(slot), bodies.append(_columns(some))
        if self.sigs:
            sig, owner, key, e = (np.concatenate(x) for x in (self.sigs, self.owners, self.keys, self.es))
            cold, hot = _hot(sig)
            if len(hot):
                rows = np.zeros(len(hot), SIG)
                rows["sig"], rows["key"], rows["e"], rows["count"] = _name(sig[hot], n), key[owner[hot]], e[owner[hot]], MANY
                for slot, some in _by(((rows["key"] >> _U(8)) % _U(n)).astype(np.int64), rows):
                    kinds.append(SHARED), slots.append(slot), bodies.append(_columns(some))
                mark = np.unique(sig[hot])
                key, e = np.append(key, _U(0)), np.append(e, np.uint8(MARK))
                sig = np.concatenate([sig[cold], mark])
                owner = np.concatenate([owner[cold], np.full(len(mark), len(key) - 1, np.uint32)])
            for slot, s, o in _by(((sig >> SIG_BITS) % _U(n)).astype(np.int64), sig, owner):
                at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                each = np.diff(np.append(at, len(o))).astype(np.uint32)
                own = o[at]
                kinds.append(SIGNED), slots.append(slot)
                bodies.append(b"".join([np.array([len(own), len(s)], "<u4").tobytes(), key[own].tobytes(), e[own].tobytes(), each.tobytes(),
                                        (s & _U(0xFFFFFFFF)).astype("<u4").tobytes(), ((s >> _U(32)) & _U(0xFF)).astype("<u1").tobytes()]))
        return _batch(kinds, slots, bodies)


def sign(buckets_: int, words: int, num: int, den: int):
    """Signatures by bucket, and documents by set; a set is signed once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        out = Signed()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            hashes = batch.column("h").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                value, n = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                d = np.zeros(b - a, DOC)
                d["doc"], d["null"], d["h"], d["n"], d["key"] = ids[a:b], null[a:b], hashes[a:b], n, set_keys(value, n)
                new = np.zeros(b - a, bool)
                for i, k in enumerate(d["key"].tolist()):
                    if k and k not in signed:
                        signed.add(k)
                        new[i] = True
                out.add(d, new, value, n, num, den)
                if out.held >= FLUSH:
                    yield out.batch(buckets_)
                    out = Signed()
        if out.docs:
            yield out.batch(buckets_)
    return run


def _hot(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the cold signatures, of the hot ones)."""
    by = np.argsort(sig, kind="stable")
    s = sig[by]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    each = np.diff(np.append(at, len(s)))
    hot = np.repeat(each > HOT_IN_BATCH, each)
    return np.sort(by[~hot]), np.sort(by[hot])


def _name(sig: np.ndarray, n: int) -> np.ndarray:
    """A signature as bucket and 40 bits, the form in which it travels."""
    return (((sig >> SIG_BITS) % _U(n)) << SIG_BITS) | (sig & ((_U(1) << SIG_BITS) - _U(1)))


def count_bucket(n: int):
    """Signatures that several sets hold, with the number of sets, by set."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds != SIGNED))]
        sigs, keys, es = [], [], []
        for body in table.filter(pa.array(kinds == SIGNED)).column("body"):
            body = body.as_py()
            a, m = np.frombuffer(body, "<u4", 2)
            at = 8
            own = np.frombuffer(body, "<u8", a, at); at += 8 * a  # noqa: E702
            e = np.frombuffer(body, "<u1", a, at); at += a  # noqa: E702
            each = np.frombuffer(body, "<u4", a, at); at += 4 * a  # noqa: E702
            sig = np.frombuffer(body, "<u4", m, at).astype(_U) | (np.frombuffer(body, "<u1", m, at + 4 * m).astype(_U) << _U(32))
            sigs.append(sig), keys.append(np.repeat(own, each)), es.append(np.repeat(e, each))
        if sigs:
            s = np.concatenate(sigs)
            by = np.argsort(s)
            s = s[by]
            twin = np.zeros(len(s), bool)
            twin[1:] = s[1:] == s[:-1]
            twin[:-1] |= twin[1:]
            rows = np.zeros(int(twin.sum()), SIG)
            by = by[twin]
            rows["sig"], rows["key"], rows["e"] = s[twin], np.concatenate(keys)[by], np.concatenate(es)[by]
            del sigs, keys, es, s, by
            rows = rows[np.lexsort((rows["key"], rows["sig"]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
            rows = rows[new]
            at = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1]])) if len(rows) else np.zeros(0, int)
            each = np.diff(np.append(at, len(rows)))
            marked = rows["e"][at] == MARK  # key 0 sorts first
            count = np.where(marked, MANY, np.minimum(each, MANY - 1).astype(np.uint32))
            rows["count"] = np.repeat(count, each)
            rows = rows[(rows["count"] > 1) & (rows["e"] != MARK)]
            rows["sig"] |= _U(key[0].as_py()) << SIG_BITS
            kinds, slots, bodies = [], [], []
            for slot, some in _by(((rows["key"] >> _U(8)) % _U(n)).astype(np.int64), rows):
                kinds.append(SHARED), slots.append(slot), bodies.append(_columns(some))
            out.append(pa.Table.from_batches([_batch(kinds, slots, bodies)]))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])
    return run


def prefix_bucket(num: int, den: int):
    """Of each set of a bucket, the shared signatures among its first k + 1."""
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        names = ["sig", "key"]
        nothing = pa.table([pa.array([], pa.int64())] * 2, names=names)
        if not (kinds == SHARED).any():
            return nothing
        take = lambda kind, dtype: np.concatenate([_records(x.as_py(), dtype) for x in table.filter(pa.array(kinds == kind)).column("body")])
        docs, rows = take(DOCS, DOC), take(SHARED, SIG)
        # a set has its part counts where it was signed; its other copies have 0
        docs = docs[np.lexsort((-docs["p1"], docs["key"]))]
        docs = docs[np.concatenate([[True], docs["key"][1:] != docs["key"][:-1]])]
        rows = rows[np.lexsort((rows["sig"], rows["count"], rows["e"], rows["key"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["key"][1:] != rows["key"][:-1]) | (rows["e"][1:] != rows["e"][:-1])
        rows = rows[new]
        d = docs[np.searchsorted(docs["key"], rows["key"])]
        at = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["e"][1:] != rows["e"][:-1])]))
        each = np.diff(np.append(at, len(rows)))
        one, e = d[at], rows["e"][at]
        p = np.where(e == band(one["n"]), one["p1"], np.where(e == band(one["n"] * den // num), one["p2"], one["n"]))
        left = spoiled(one["n"], num, den) + 1 - (p - each)
        keep = np.arange(len(rows)) - np.repeat(at, each) < np.repeat(left, each)
        rows = rows[keep]
        return pa.table([rows["sig"].astype(np.int64), rows["key"].astype(np.int64)], names=names)
    return run


def sets_of(wanted, words: int):
    """(key, shingles) of the sets that hit a bitmap, once in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                value, n = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                key = set_keys(value, n)
                hit = contains(marked, key) & (n > 0)
                at = np.concatenate([[0], np.cumsum(n)])
                rows = [i for i in np.flatnonzero(hit) if not (key[i] in seen or seen.add(key[i]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(key[rows].astype(np.int64)), pa.array([value[at[i]:at[i + 1]].astype(np.int64) for i in rows], pa.list_(pa.int64()))],
                                                     names=["key", "shingles"])
    return run


def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column("body"):
            d = _records(body.as_py(), DOC)
            yield pa.RecordBatch.from_arrays([pa.array(d["doc"], mask=d["null"] == 1), pa.array(d["h"]), pa.array(d["n"]), pa.array(d["key"].astype(np.int64))],
                                             names=["doc_id", "h", "n_shingles", "key"])


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets (sorted distinct arrays)."""
    both = a if b is None else a + b
    value, owner = np.concatenate(both), np.repeat(np.arange(len(both)), [len(x) for x in both])
    by = np.argsort(value, kind="stable")
    value, owner = value[by], owner[by]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1  # others intersect nothing
    keep = several[column]
    column, owner = (np.cumsum(several) - 1)[column[keep]], owner[keep]
    n, width = len(a), 4096
    out = np.zeros((n, n if b is None else len(b)), np.float64)
    cuts = np.searchsorted(column, np.arange(0, int(several.sum()) + width, width))
    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if y > x:
            m = np.zeros((len(both), width), np.float32)
            m[owner[x:y], column[x:y] - i * width] = 1
            out += m[:n] @ (m if b is None else m[n:]).T
    return out.astype(np.int64)


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    common = intersections(a, b)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in (a if b is None else b)])
    return den * common >= num * (na[:, None] + nb - common)


def smallest_reachable(link: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest it reaches."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label, len(link)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _table(keys: list, linked_to: list) -> pa.Table:
    return pa.table([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.concatenate(linked_to) if linked_to else np.zeros(0, np.int64))], names=["a", "b"])


def solve_groups(num: int, den: int):
    """Rows (key, component, shingles) of whole groups: links that connect."""
    def run(table: pa.Table) -> pa.Table:
        key, group = table.column("key").to_numpy(), table.column("component").to_numpy()
        by = np.lexsort((key, group))
        by = by[np.concatenate([[True], key[by][1:] != key[by][:-1]])]  # copies of a set
        at = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
        shingles = table.column("shingles").combine_chunks()
        out = [], []
        for i, j in zip(at, np.append(at[1:], len(by))):
            if j - i > 1:
                sets = [shingles[int(r)].values.to_numpy() for r in by[i:j]]
                low = smallest_reachable(linked(sets, None, num, den))
                far = np.flatnonzero(low != np.arange(j - i))
                out[0].append(key[by[i:j]][far]), out[1].append(key[by[i:j]][low[far]])
        return _table(*out)
    return run


def pack_sets(name: tuple, table: pa.Table) -> pa.Table:
    """One block: its distinct keys and their sets as one cell."""
    key = table.column("key").to_numpy()
    _, rows = np.unique(key, return_index=True)
    shingles = table.column("shingles").combine_chunks()
    sets = [shingles[int(r)].values.to_numpy() for r in rows]
    body = b"".join([np.array([len(rows), *map(len, sets)], "<i8").tobytes(), key[rows].astype("<i8").tobytes(), *(x.astype("<i8").tobytes() for x in sets)])
    return pa.table([pa.array([name[0].as_py()]), pa.array([name[1].as_py()], pa.int32()), pa.array([body], pa.binary())], names=["component", "block", "body"])


def _unpacked(body: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int(np.frombuffer(body, "<i8", 1)[0])
    sizes = np.frombuffer(body, "<i8", n, 8)
    at = np.cumsum(sizes) - sizes
    values = np.frombuffer(body, "<i8", offset=8 + 16 * n)
    return np.frombuffer(body, "<i8", n, 8 + 8 * n), [values[i:i + m] for i, m in zip(at, sizes)]


def solve_tiles(num: int, den: int):
    """Rows (x, y) of two blocks each: links that connect what links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (ka, a), (kb, b) = _unpacked(x.as_py()), _unpacked(y.as_py())
                key = np.concatenate([ka, kb])
                link = np.zeros((len(key), len(key)), bool)
                link[:len(ka), len(ka):] = linked(a, b, num, den)
                link |= link.T
                low = smallest_reachable(link)
                far = np.flatnonzero((low != np.arange(len(key))) & (key != key[low]))
                yield _table([key[far]], [key[low[far]]]).combine_chunks().to_batches()[0] if len(far) else pa.RecordBatch.from_pylist([], _table([], []).schema)
    return run


def _blocks(sets: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK`` sets from (key, component, size, shingles)."""
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block")
    return sets.select("component", block, "key", "shingles").groupBy("component", "block").applyInArrow(pack_sets, "component long, block int, body binary")


def _tiles(wanted: DataFrame, left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Links within the tiles (component, i, j) of left and right blocks."""
    tiles = (wanted.join(left.select("component", F.col("block").alias("i"), F.col("body").alias("x")), ["component", "i"])
             .join(right.select("component", F.col("block").alias("j"), F.col("body").alias("y")), ["component", "j"]))
    return tiles.select("x", "y").mapInArrow(solve_tiles(num, den), "a long, b long")


def link_sets(docs: DataFrame, members: DataFrame, n: int, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect every component of linkable sets, from
    ``members`` (sig, key): the sets of each used signature."""
    spark = docs.sparkSession
    pivot = members.groupBy("sig").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a != z").select("sig", "a")
    near = written(members.join(pivot, "sig").filter("key != a").select("a", F.col("key").alias("b")).distinct(), "near")
    groups = components(near)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    groups = written(groups.join(sizes, "component"), "groups")
    n_sets = groups.count()
    marks = spark.sparkContext.broadcast(bitmap(groups.select("key"), _keys, bits_for(n_sets)))
    sets = docs.mapInArrow(sets_of(marks, words), "key long, shingles array<long>")
    sets = written(sets.join(F.broadcast(groups) if n_sets <= MAX_BROADCAST else groups, "key"), "sets")
    small = sets.filter(F.col("size") <= BLOCK).withColumn("slot", F.pmod(F.xxhash64("component"), F.lit(n)))
    links = written(small.groupBy("slot").applyInArrow(solve_groups(num, den), "a long, b long"), "links")
    large = sets.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return links
    blocks = written(_blocks(large), "blocks")
    numbers = blocks.select("component", "block")
    links = links.union(written(_tiles(numbers.select("component", F.lit(0).alias("i"), F.col("block").alias("j")), blocks, blocks, num, den), "links"))
    # what the first block did not connect to the largest component of its group
    of = large.select("key", "component").distinct().join(components(links).select("key", F.col("component").alias("c")), "key", "left").withColumn("c", F.coalesce("c", "key"))
    most = of.groupBy("component", "c").agg(F.count("*").alias("m")).groupBy("component").agg(F.max(F.struct("m", "c")).alias("x")).select("component", F.col("x.c").alias("c"))
    rest = written(of.join(most, ["component", "c"], "left_anti"), "rest")
    if rest.isEmpty():
        return links
    sizes = rest.groupBy("component").agg(F.count("*").alias("size"))
    apart = written(_blocks(large.drop("size").join(rest.select("key"), "key", "left_semi").join(sizes, "component")), "rest-blocks")
    wanted = apart.select("component", F.col("block").alias("i")).join(numbers.select("component", F.col("block").alias("j")), "component")
    return links.union(written(_tiles(wanted, apart, blocks, num, den), "links"))


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, h, component) for every row of
    ``docs``. ``h``: xxhash64 of the text; ``component`` names the component
    even where rows share ids (null for empty sets)."""
    spark = docs.sparkSession
    docs = text_rows(docs).withColumn("h", F.xxhash64("text"))
    n = buckets(spark, text_bytes(docs), BUCKET_BYTES)
    signed = docs.mapInArrow(sign(n, words, num, den), MOVED).groupBy("bucket").applyInArrow(count_bucket(n), MOVED)
    signed = written(signed, "signatures")
    rows = signed.filter(F.col("kind") == DOCS).select("body").mapInArrow(document_rows, "doc_id long, h long, n_shingles long, key long")
    members = written(signed.groupBy("bucket").applyInArrow(prefix_bucket(num, den), "sig long, key long"), "members")
    names = rows.filter("key != 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    of = components(link_sets(docs, members, n, words, num, den)).withColumnRenamed("component", "linked")
    names = names.join(of, "key", "left").withColumn("component", F.coalesce("linked", "key"))
    lowest = names.groupBy("component").agg(F.min("low").alias("component_id"))
    names = names.join(lowest, "component").select("key", "component", "component_id")
    return (rows.join(names, "key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "component"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates:
    of each component the row with the smallest doc_id stays (nulls last, then
    by text hash), and of rows equal in both one. Blank texts all stay."""
    last = F.lit((1 << 63) - 1)
    found = jaccard_components(docs, **how).filter("component is not null")
    stay = (found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("i"), "h")).alias("x"))
            .select(F.col("x.i").alias("_i"), F.col("x.h").alias("_h")))
    text = F.col("text").cast("string")
    blank = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    keyed = docs.filter(~blank).withColumn("_i", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("_h", F.xxhash64(text))
    kept = keyed.join(stay, ["_i", "_h"], "left_semi").dropDuplicates(["_i", "_h"])
    return kept.select(*docs.columns).unionByName(docs.filter(blank))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("key").to_numpy(zero_copy_only=False).astype(_U)


def op2_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_partenum_jaccard": op2_partenum_jaccard}
