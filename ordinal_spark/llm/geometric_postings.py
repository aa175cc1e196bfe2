"""Operator 11: ranked lexical search over geometrically blocked posting lists.

Documents are indexed in *shards* of bounded size. In a shard each term's
posting list is cut into blocks of similar documents: the list's documents,
seen as projected weight vectors, go to the nearest of evenly drawn pivots of
the list. A block stores its documents and the largest impact that any of them
has in each term (a coordinatewise maximum, rounded up to 8 bits). A query
walks its terms' lists from the rarest on; a block whose summary cannot reach
the query's k-th best score is skipped, the documents of all others are scored
exactly, and a query ends once the terms left cannot reach that score either.
Bounds are whole numbers rounded up, so only documents that cannot rank are
skipped, and the result is exact.

Queries come in batches (of bounded vocabulary), and an index holds the terms of its
batch: postings of other terms cannot count. One pass reads the documents and
writes their term counts; sums over all of them give N, L and each df; a second
pass over the counts blocks and writes the shards. One shard in ``FIRST`` is
searched first, and its k-th best scores are the least that the others must
reach. A shard is a run of documents as they lie, so a term or a text that a
third of all rows hold is spread like any other, and no shuffle moves postings.

Terms are runs of ASCII letters and digits and of characters beyond ASCII;
only A-Z are lower-cased. Null texts have no terms. Documents without an id
rank before those with one; repeated rows are ranked row by row. Queries that
share an id are one query with the terms of all its texts; queries without
terms, and empty tables, give no rows. Memory follows the shard: long texts are
split at term borders. Other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import documents, text_rows, written
from .text import ragged

TOP = 10
BLOCK, SHORT = 128, 16          # postings of a block, on average; a list of so few is scored without a summary
SHARD_DOCUMENTS = 4096          # at most, and fewer where a batch has many terms:
SHARD_CELLS = 1 << 22           # documents times terms of a shard
FILE_SHARDS = 4                 # shards of a file: Spark reads a file's rows together
BATCH_TERMS = 4096              # distinct terms from which on another index serves the next queries
FIRST = 16                      # one shard in so many is searched first
PROJECTED, SEED = 24, 11
STEP = 4096                     # of the summaries: the largest part of a score, 10**6, needs 8 bits
PIECE = 1 << 20                 # bytes of a text that are split at once
COUNTED = "doc_id long, n long, terms binary, counts binary"
SHARDS = "shard long, body binary"
FOUND = "q int, doc_id long, score long"
_LOW_ID, _MOST = -(1 << 63), (1 << 63) - 1
# every byte that is in no term is a blank, A-Z are lower-cased
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = (text or "").encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text"):
                seen: Counter = Counter()
                for words in terms_of(text.as_py()):
                    seen.update(words)
                own = sorted((vocabulary[w], c) for w, c in seen.items() if w in vocabulary)
                n.append(seen.total())
                terms.append(np.array([t for t, _ in own], "<i4").tobytes())
                counts.append(np.array([c for _, c in own], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "n", "terms", "counts"])
    return run


def _documents_with(width: int):
    """(term, df) of a task's rows: one row for each term of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=width)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])
    return run


class Shard:
    """Documents with their parts of scores, and the blocks of their postings."""

    NAMES = ("ids", "sizes", "terms", "parts", "block_term", "block_size", "members", "held", "summary")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    def to_bytes(self) -> bytes:
        parts = [_narrow(getattr(self, n)) for n in self.NAMES]
        return np.array([[len(p), p.dtype.itemsize] for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, body: bytes) -> "Shard":
        sizes = np.frombuffer(body, "<i8", 2 * len(cls.NAMES)).reshape(-1, 2)
        at, out = 8 * sizes.size, {}
        for name, (n, width) in zip(cls.NAMES, sizes.tolist()):
            own = np.frombuffer(body, "<i8" if width == 8 else f"<u{width}", n, at)
            out[name] = own if name in ("held", "summary") else own.astype(np.int64)
            at += n * width
        return cls(**out)


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in ("<u1", "<u2", "<u4"):
        if not len(x) or x.min() >= 0 and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype("<i8")


def nearest_pivot(vectors: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each posting: the most similar of evenly drawn pivots."""
    pivots = vectors[np.linspace(0, len(vectors) - 1, blocks).astype(np.int64)]
    return (vectors @ pivots.T).argmax(axis=1)


def build_shard(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, parts: np.ndarray, weights: np.ndarray) -> Shard:
    """Blocks and summaries of documents in CSR form: ``parts`` is what a term
    adds to a document's score, divided by the term's weight."""
    width, docs = len(weights), np.repeat(np.arange(len(ids)), sizes)
    rough = np.zeros((len(ids), width), np.uint8)
    rough[docs, terms] = -(-parts.astype(np.int64) // STEP)
    # geometry: weighted vectors, projected by fixed random signs
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (width, PROJECTED))
    strength = (parts * weights[terms]).astype(np.float32)
    vectors = np.zeros((len(ids), PROJECTED), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for a in range(0, PROJECTED, 8):
            vectors[full, a:a + 8] = np.add.reduceat(signs[terms, a:a + 8] * strength[:, None], starts)
        vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)) + 1e-9
    # posting lists, each cut into blocks
    by = np.argsort(terms, kind="stable")
    members, of_term = docs[by], terms[by]
    length = np.bincount(terms, minlength=width)
    start = np.cumsum(length) - length
    own = np.zeros(len(members), np.int64)
    for t in np.flatnonzero(length > BLOCK):
        mine = slice(start[t], start[t] + length[t])
        own[mine] = nearest_pivot(vectors[members[mine]], -(-int(length[t]) // BLOCK))
    order = np.lexsort((members, own, of_term))
    members, own, of_term = members[order], own[order], of_term[order]
    new = np.ones(len(members), bool)
    new[1:] = (own[1:] != own[:-1]) | (of_term[1:] != of_term[:-1])
    begin = np.flatnonzero(new)
    block_size = np.diff(np.append(begin, len(members)))
    # a summary for each block of the longer lists, then turned: a query reads those of its terms
    stop = begin + block_size
    long = np.flatnonzero(length[of_term[begin]] > SHORT)
    most = np.zeros((len(long), width), np.uint8)
    for row, b in enumerate(long.tolist()):
        rough[members[begin[b]:stop[b]]].max(axis=0, out=most[row])
    turned = np.ascontiguousarray(most.T)
    held = turned > 0
    return Shard(ids=ids, sizes=sizes, terms=terms, parts=parts, block_term=of_term[begin], block_size=block_size, members=members,
                 held=np.packbits(held), summary=turned[held])


def search_shard(shard: Shard, weights: np.ndarray, queries: list[np.ndarray], floors: np.ndarray, top: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query, document ids, scores) of the best of a shard that reach the
    floors, and how many blocks were scored. Scores are below 2**53."""
    n, width = len(shard.ids), len(weights)
    docs = np.repeat(np.arange(n), shard.sizes)
    parts = np.zeros((n, width), np.int32)
    parts[docs, shard.terms] = shard.parts
    length = np.bincount(shard.terms, minlength=width)
    long = np.flatnonzero(length[shard.block_term] > SHORT)
    most = np.zeros((width, len(long)), np.uint8)
    most[np.unpackbits(shard.held, count=most.size).reshape(most.shape).view(bool)] = shard.summary
    first = np.searchsorted(shard.block_term, np.arange(width + 1))
    begin = np.cumsum(shard.block_size, dtype=np.int64) - shard.block_size
    tallest = np.zeros(width, np.int64)
    np.maximum.at(tallest, shard.terms, shard.parts.astype(np.int64))
    out, read = [], 0
    for q, terms in enumerate(queries):
        terms = terms[(length[terms] > 0) & (weights[terms] > 0)]
        if not len(terms):
            continue
        terms = terms[np.argsort(length[terms], kind="stable")]
        w = weights[terms]
        rest = np.cumsum((w * tallest[terms])[::-1])[::-1]  # what the terms from here on can add up to
        # what any document of a block can reach; short lists are always read
        bound = np.full(len(shard.block_term), _MOST)
        bound[long] = STEP * (w.astype(np.float64) @ most[terms]).astype(np.int64)
        floor, held = max(1, int(floors[q])), 0
        seen = np.zeros(n, bool)
        chosen, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < len(terms) and rest[at] >= floor:
            mine = ragged(first[terms[at:at + step]], first[terms[at:at + step] + 1] - first[terms[at:at + step]])
            mine = mine[bound[mine] >= floor]
            read += len(mine)
            new = shard.members[ragged(begin[mine], shard.block_size[mine])]
            fresh = np.zeros(n, bool)
            fresh[new] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            value = parts[np.ix_(new, terms)].astype(np.float64) @ w
            fit = value >= floor
            chosen, score = np.concatenate([chosen, new[fit]]), np.concatenate([score, value[fit].astype(np.int64)])
            best = np.lexsort((shard.ids[chosen], -score))[:top]
            chosen, score, held = chosen[best], score[best], len(best)
            if held == top:
                floor = max(floor, int(score[-1]))
            at, step = at + step, 2 * step  # more lists at once, as the floor settles
        if held:
            out.append((q, shard.ids[chosen], score))
    return out, read


def _shards(weights: np.ndarray, n_docs: int, length: int):
    """Rows of COUNTED to shards of bounded size."""
    most = int(max(1, min(SHARD_DOCUMENTS, SHARD_CELLS // len(weights))))

    def shard(table: pa.Table) -> pa.RecordBatch:
        column = table.column("doc_id")
        ids = column.fill_null(_LOW_ID).to_numpy()
        sizes = np.array([len(x) // 4 for x in table.column("terms").to_pylist()], np.int64)
        terms = np.frombuffer(b"".join(table.column("terms").to_pylist()), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8")
        m = np.repeat(10 + 90 * table.column("n").to_numpy() * n_docs // max(1, length), sizes)
        body = build_shard(ids, sizes, terms, 1_000_000_000 * tf // (1000 * tf + 8 * m), weights).to_bytes()
        # named by its content: a task that runs again names it alike
        name = int(np.bitwise_xor.reduce(ids * np.int64(0x9E3779B97F4A7C1))) if len(ids) else 0
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["shard", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.Table] = []
        for batch in batches:
            table = pa.concat_tables([*left, pa.Table.from_batches([batch.filter(pc.greater(pc.binary_length(batch.column("terms")), 0))])])
            at = 0
            while table.num_rows - at >= most:
                yield shard(table.slice(at, most).combine_chunks())
                at += most
            left = [table.slice(at)]
        if left and left[0].num_rows:
            yield shard(left[0].combine_chunks())
    return run


def _search(weights: np.ndarray, queries: list[np.ndarray], floors: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                found, _ = search_shard(Shard.from_bytes(body.as_py()), weights, queries, floors, top)
                ids = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
                number = np.repeat(np.array([x[0] for x in found], np.int32), [len(x[1]) for x in found])
                score = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in found)])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, mask=ids == _LOW_ID), pa.array(score)], names=["q", "doc_id", "score"])
    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _batch(docs: DataFrame, items: dict, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for a batch of queries: id to terms."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*items.values())))}
    queries = [np.array(sorted(vocabulary[w] for w in words), np.int64) for words in items.values()]
    counted = written(docs.mapInArrow(_counted(vocabulary), COUNTED), "term-counts")
    n_docs, length = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    # one row for each term of the batch
    for r in counted.select("terms").mapInArrow(_documents_with(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    index = written(counted.mapInArrow(_shards(weights, n_docs, length), SHARDS), "shards", FILE_SHARDS)
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    floors = np.zeros(len(queries), np.int64)
    first = written(_best(index.filter(early).select("body").mapInArrow(_search(weights, queries, floors, top), FOUND), top), "first")
    for r in first.filter(F.col("rank") == top).toLocalIterator():  # one row for each query of the batch
        floors[r["q"]] = r["score"]
    rest = index.filter(~early).select("body").mapInArrow(_search(weights, queries, floors, top), FOUND)
    names = spark.createDataFrame([(q, i) for q, i in enumerate(items)], "q int, item_id long")
    return (_best(first.select("q", "doc_id", "score").union(rest), top).join(F.broadcast(names), "q")
            .select("item_id", "rank", "doc_id", "score"))


def batches_of(items: DataFrame) -> Iterator[dict]:
    """Queries (item_id to set of terms) in batches."""
    out: dict = {}
    held: set = set()
    for r in items.orderBy(F.asc_nulls_first("item_id")).toLocalIterator():
        words = {w for some in terms_of(r["text"]) for w in some}
        if not words:
            continue
        if len(held) > BATCH_TERMS and r["item_id"] not in out:
            yield out
            out, held = {}, set()
        out.setdefault(r["item_id"], set()).update(words)
        held |= words
    if out:
        yield out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of
    each row of ``items`` (item_id, text), best first."""
    spark = docs.sparkSession
    docs = text_rows(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for batch in batches_of(items):
        one = _batch(docs, batch, top)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_geometric_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {"op11_geometric_postings": f"""
with words as (select doc_id, unnest({_TERMS.format('text')}) as term from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from words group by all),
n as (select doc_id, sum(tf) as n from tf group by doc_id),
total as (select count(*) as docs, sum(n) as len from n),
df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id, unnest({_TERMS.format('text')}) as term from benchmark where text is not null),
s as (
  select q.item_id, tf.doc_id,
         cast(sum(cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len)))) as bigint) as score
  from q join tf using (term) join df using (term) join n using (doc_id) cross join total
  group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""}

QUERIES = {"op11_geometric_postings": op11_geometric_postings}
