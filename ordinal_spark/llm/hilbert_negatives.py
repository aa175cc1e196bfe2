"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are quantised to integers, rows sorted by (label, place on a Hilbert
curve through all dimensions) and cut into blocks: rows of Parquet files, each
with the least and the largest component of every dimension (its zone map) and
of the labels. Interval arithmetic over a zone map bounds the inner product of
an anchor with any row of the block,

    sum(min(a lo, a hi)) <= a . x <= sum(max(a lo, a hi)),

so a search reads a block only if these bounds meet the scores that it still
asks for. Searches (*asks*: a vector, a label to have or to avoid, a window of
scores) run in two rounds: each first reads the block that promises most, which
raises the least score it asks for, and then every other block whose bounds
meet what is left. One round of asks finds each anchor's positives; their
scores are the windows of the next, which finds the negatives. All bounds and
scores are exact integers, so the result is exact.

Zone maps meet asks in packed groups, and a block is sent only to the packed
asks that must read it. Blocks are cut by count, so a label or a vector that a
third of all rows hold is many blocks; each gives an ask ``k`` rows at most.

Rows whose id or label is null, or whose vector is null or has null or
non-finite components, take no part. Vectors of other lengths are not compared.
Of rows that share an id the least (label, vector) counts. Scores beyond 64
bits are held at the limits. A negative positive score has an empty window.
Columns other than the three named ones play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90              # a negative's score in hundredths of the positive's
SCALE = 256
ROWS, ASKS, ZONES = 2048, 512, 512  # rows of a block; asks and zone maps that are packed together, on average
CELL_BITS = 2                   # of each dimension in a place on the curve
_CUTS = np.array([-0.67, 0.0, 0.67])  # quartiles of a standard normal
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
KEYED = "dim int, label long, id long, q array<long>, key binary"
BLOCKS = "block long, dim int, n int, label_lo long, label_hi long, lo binary, hi binary, body binary"
PACKED = "dim int, part int, body binary"
CHOSEN = "block long, asks binary"
FIRST = "anchor long, pos int, block long, most long"
HITS = "anchor long, pos int, id long, score long"


def hilbert_key(cells: np.ndarray, bits: int = CELL_BITS) -> list[bytes]:
    """Places of points on a Hilbert curve, as byte strings that sort. ``cells``
    holds the coordinates, ``bits`` bits each (Skilling's transposed form)."""
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while n and q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(high, np.uint32(q - 1), swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(cells.shape[0], np.uint32)
    q = 1 << (bits - 1)
    while n and q > 1:
        turn ^= np.where(x[n - 1] & q, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = [(x >> np.uint32(b)) & 1 for b in reversed(range(bits))]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1) if n else np.zeros((len(cells), 0), np.uint8)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            q = _matrix(part.column("q"), part.num_rows).astype(np.float64)
            norm = np.sqrt(np.maximum(1, (q * q).sum(axis=1, keepdims=True)))
            cells = np.searchsorted(_CUTS, q / norm * np.sqrt(max(1, d)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hilbert_key(cells), pa.binary())], names=[*batch.schema.names, "key"])


def _narrow(m: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds ``m``."""
    for kind in ("<i2", "<i4"):
        if not m.size or np.iinfo(kind).min <= m.min() and m.max() <= np.iinfo(kind).max:
            return m.astype(kind)
    return m.astype("<i8")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length (the last a matrix of integers) as one cell."""
    m = _narrow(arrays[-1])
    head = np.array([*m.shape, m.dtype.itemsize], "<i8")
    return b"".join(x.tobytes() for x in (head, *(a.astype("<i8") for a in arrays[:-1]), m))


def unpack(body: bytes, arrays: int) -> list[np.ndarray]:
    n, d, size = np.frombuffer(body, "<i8", 3)
    at = 24
    out = []
    for _ in range(arrays):
        out.append(np.frombuffer(body, "<i8", n, at))
        at += 8 * int(n)
    return [*out, np.frombuffer(body, f"<i{size}", n * d, at).reshape(n, d)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come in order of dimension, label and curve."""
    made = TaskContext.get().partitionId() << 32

    def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        at = 0
        dims = table.column("dim").to_numpy()
        while at < len(dims):
            end = min(at + ROWS, int(np.searchsorted(dims, dims[at], "right")))
            if end == len(dims) and end - at < ROWS and not last:
                break
            part = table.slice(at, end - at)
            labels, ids, q = part.column("label").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("q"), end - at)
            row = (made, int(dims[at]), end - at, int(labels.min()), int(labels.max()), q.min(axis=0).astype("<i8").tobytes(),
                   q.max(axis=0).astype("<i8").tobytes(), pack(ids, labels, q))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["block", "dim", "n", "label_lo", "label_hi", "lo", "hi", "body"])
            made, at = made + 1, end
        left.append(table.slice(at))

    left: list[pa.Table] = []
    for batch in batches:
        table = pa.concat_tables([*left, pa.Table.from_batches([batch])])
        left.clear()
        yield from blocks(table, False)
    if left:
        yield from blocks(left.pop(), True)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact and held within 64 bits."""
    reach = [int(np.abs(x.astype(np.float64)).max()) + 1 if x.size else 0 for x in (a, b)]
    if reach[0] * reach[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) possible products of vectors with rows within boxes."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    parts = [products(up, lo), products(down, hi), products(up, hi), products(down, lo)]
    if max(float(np.abs(p.astype(np.float64)).max()) if p.size else 0 for p in parts) < 2.0**61:
        return parts[0] + parts[1], parts[2] + parts[3]
    total = [np.clip(x.astype(object) + y.astype(object), _LEAST, _MOST).astype(np.int64) for x, y in (parts[:2], parts[2:])]
    # a part at the limit says nothing
    held = [np.abs(x.astype(np.float64)) >= 2.0**62 for x in parts]
    return np.where(held[0] | held[1], _LEAST, total[0]), np.where(held[2] | held[3], _MOST, total[1])


def possible(asks: list[np.ndarray], zones: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether an ask must read a block, the most it can find there)."""
    _, _, label, same, least, most, skip, vector = asks
    block, label_lo, label_hi, box = zones
    d = vector.shape[1]
    low, high = bounds(vector, box[:, :d], box[:, d:])
    has = (label_lo <= label[:, None]) & (label[:, None] <= label_hi)
    only = (label_lo == label[:, None]) & (label[:, None] == label_hi)
    fits = np.where(same[:, None] == 1, has, ~only)
    return fits & (high >= least[:, None]) & (low <= most[:, None]) & (block != skip[:, None]), np.minimum(high, most[:, None])


def _choose(first: bool):
    """Rows (asks, zones): which asks read which blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_body, z_body in zip(batch.column("asks"), batch.column("zones")):
                asks, zones = unpack(a_body.as_py(), 7), unpack(z_body.as_py(), 3)
                reads, reach = possible(asks, zones)
                if first:
                    best = np.where(reads, reach, _LEAST).argmax(axis=1)
                    some = np.flatnonzero(reads.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks[0][some], asks[1][some].astype(np.int32), zones[0][best[some]], reach[some, best[some]])],
                                                     names=["anchor", "pos", "block", "most"])
                    continue
                for z in np.flatnonzero(reads.any(axis=0)):
                    mine = np.flatnonzero(reads[:, z])
                    yield pa.RecordBatch.from_arrays([pa.array([zones[0][z]]), pa.array([pack(*(x[mine] for x in asks))], pa.binary())], names=["block", "asks"])
    return run


def best_rows(score: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest scores of each row among ``keep``,
    ties to smaller ids."""
    if not score.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.where(keep, score, _LEAST)
    if score.shape[1] > k:
        keep = keep & (held >= np.partition(held, -k, axis=1)[:, -k][:, None])
    row, col = np.nonzero(keep)
    by = np.lexsort((ids[col], ~held[row, col], row))  # ~x falls as x rises
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _search(k: int):
    """Rows (asks, body): the ``k`` best rows of the block for each ask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_body, body in zip(batch.column("asks"), batch.column("body")):
                anchor, pos, label, same, least, most, _, vector = unpack(a_body.as_py(), 7)
                ids, labels, q = unpack(body.as_py(), 2)
                one, which = np.unique(anchor, return_index=True)  # an anchor's asks share its vector
                score = products(vector[which], q)[np.searchsorted(one, anchor)]
                keep = (labels == label[:, None]) == (same[:, None] == 1)
                keep &= (score >= least[:, None]) & (score <= most[:, None]) & (ids != anchor[:, None])
                row, col = best_rows(score, ids, keep, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[row], pos[row].astype(np.int32), ids[col], score[row, col])],
                                                 names=["anchor", "pos", "id", "score"])
    return run


def _pack_asks(names: list[str]):
    """``names``: of the key (dim or block, and part) and of the packed cell."""
    kinds = [pa.int64() if names[0] == "block" else pa.int32(), pa.int32()]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "pos", "label", "same", "least", "most", "skip")]
        body = pack(*columns, _matrix(table.column("q"), table.num_rows))
        return pa.table([*(pa.array([x.as_py()], t) for x, t in zip(key, kinds)), pa.array([body], pa.binary())], names=names)
    return run


def _pack_zones(key: tuple, table: pa.Table) -> pa.Table:
    block = table.column("block").to_numpy()
    box = [np.stack([np.frombuffer(x.as_py(), "<i8") for x in table.column(c)]) for c in ("lo", "hi")]
    body = pack(block, table.column("label_lo").to_numpy(), table.column("label_hi").to_numpy(), np.concatenate(box, axis=1))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([body], pa.binary())], names=["dim", "part", "body"])


def _parts(n: int, each: int) -> int:
    return max(1, -(-n // each))


class Index:
    """Blocks of ``rows`` (id, label, q, dim) and their packed zone maps."""

    def __init__(self, rows: DataFrame, n: int) -> None:
        order = ["dim", "label", "key", "id"]
        keyed = rows.select("dim", "label", "id", "q").mapInArrow(_keyed, KEYED)
        parts = max(_parts(n, 16 * ROWS), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _parts(n, ROWS)))
        self.blocks = written(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cut, BLOCKS), "blocks")
        self.n = self.blocks.count()
        part = F.pmod(F.xxhash64("block"), F.lit(_parts(self.n, ZONES))).cast("int").alias("part")
        zones = self.blocks.select("dim", part, "block", "label_lo", "label_hi", "lo", "hi")
        self.zones = written(zones.groupBy("dim", "part").applyInArrow(_pack_zones, PACKED), "zones")

    def _meet(self, asks: DataFrame, first: bool) -> DataFrame:
        """Every packed group of asks with every packed group of zone maps."""
        n = _parts(self.n, ZONES)
        pairs = (asks.select("dim", F.col("body").alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
                 .join(self.zones.select("dim", "part", F.col("body").alias("zones")), ["dim", "part"]))
        return pairs.select("asks", "zones").mapInArrow(_choose(first), FIRST if first else CHOSEN)

    def _read(self, chosen: DataFrame, k: int) -> DataFrame:
        found = chosen.join(self.blocks.select("block", "body"), "block").select("asks", "body")
        return found.mapInArrow(_search(k), HITS)

    def search(self, asks: DataFrame, k: int) -> DataFrame:
        """(anchor, pos, id, score): the ``k`` best rows of each ask (anchor,
        pos, label, same, least, most, dim, q)."""
        asks = written(asks.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(_parts(asks.count(), ASKS))).cast("int"))
                       .withColumn("skip", F.lit(-1).cast("long")), "asks")
        packed = asks.groupBy("dim", "part").applyInArrow(_pack_asks(["dim", "part", "body"]), PACKED)
        start = (self._meet(packed, True).groupBy("anchor", "pos").agg(F.max_by("block", F.struct("most", -F.col("block"))).alias("skip")))
        begun = written(asks.drop("skip").join(start, ["anchor", "pos"]), "begun")
        early = begun.withColumn("block", F.col("skip")).groupBy("block", "part").applyInArrow(_pack_asks(["block", "part", "asks"]), "block long, part int, asks binary")
        early = written(self._read(early.select("block", "asks"), k), "early")
        order = Window.partitionBy("anchor", "pos").orderBy(F.desc("score"), "id")
        floor = early.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("anchor", "pos", F.col("score").alias("floor"))
        rest = begun.join(floor, ["anchor", "pos"], "left").withColumn("least", F.greatest("least", F.coalesce("floor", "least"))).drop("floor")
        late = self._read(self._meet(rest.groupBy("dim", "part").applyInArrow(_pack_asks(["dim", "part", "body"]), PACKED), False), k)
        return (early.union(late).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("anchor", "pos", "id", "score", "rank"))


def quantised(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, dim, q) of the rows that take part, one of each id."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    cell = lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-2.0**62)), F.lit(2.0**62)))
    rows = rows.select("id", "label", F.transform("v", cell).alias("q"))
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():  # ids are normally unique
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")
    return rows.select("id", "label", F.size("q").alias("dim"), "q")


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows for which ``is_anchor`` (of column ``id``)
    holds; ``label`` (of ``id`` and ``label``) replaces the labels."""
    rows = quantised(table, id_col, label_col, vector_col)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    rows = written(rows, "vectors")
    index = Index(rows, rows.count())
    anchors = rows.filter(is_anchor).withColumnRenamed("id", "anchor")
    limit = lambda x: F.lit(x).cast("long")
    asks = anchors.select("anchor", F.lit(0).alias("pos"), "label", F.lit(1).alias("same"), limit(_LEAST).alias("least"), limit(_MOST).alias("most"), "dim", "q")
    found = written(index.search(asks, positives), "positives")
    window = lambda share, up: F.expr(f"cast(cast(score as decimal(20,0)) * {share} + {up} as decimal(38,0)) div 100")
    wanted = (found.filter("score >= 0").select("anchor", F.col("rank").alias("pos"), window(low, 99).cast("long").alias("least"), window(high, 0).cast("long").alias("most"))
              .join(anchors, "anchor").withColumn("same", F.lit(0)))
    hits = index.search(wanted.select(*asks.columns), negatives)
    named = found.select("anchor", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (hits.join(named, ["anchor", "pos"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op13_hilbert_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, moved)


# all products in whole numbers; DuckDB sums a product of a few hundred squares exactly
ORACLE = {"op13_hilbert_zone_negatives": """
with e as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
         [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
), s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label as label, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, own, id as positive_id, score as positive_score
  from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), n as (
  select p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> p.own
   and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""}

QUERIES = {"op13_hilbert_zone_negatives": op13_hilbert_zone_negatives}
