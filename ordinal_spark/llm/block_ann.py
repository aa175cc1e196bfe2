"""Operator 1: nearest neighbours by a block matrix join over int8 tiles.

Vectors are scaled to length one, quantised to int8 with a scale of their own
and packed into blocks; each query block meets each candidate block in a tile.
A task takes a few query blocks and a few candidate blocks and makes all their
tiles, so blocks are sent once for each such group, not for each tile, and none
is joined (a join's size estimate leaves out the copies, and they would be
broadcast through the driver). A tile's int8 matrix product estimates all its cosines at once, and the norms
of what quantising lost bound the error (Cauchy-Schwarz):

    |x.y - s.t(q.p)| <= |s q| |y - t p| + |x - s q| |y|.

A pair whose upper bound reaches its query's k-th best lower bound survives;
survivors are recomputed in double precision from the original vectors and
merged by heaps, first over a task's tiles, then over the tasks. The bounds
hold, so the result is exact.

Equal vectors are searched once: a candidate stands for all rows that hold it,
of which the k + 1 smallest ids can matter, and rows with one vector share a
search. That bounds what a vector held by a third of all rows costs.

Rows whose id is null, or whose vector is null, empty, zero or has null or
non-finite components, take no part. Vectors of other lengths are not
compared. Rows that repeat an id and vector count once; a row with the query's
own id is never its neighbour.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import bound_batches, written

K = 5
QUERY_ROWS, ROWS = 2048, 4096   # most vectors of a block, on average
TILES = 16                      # candidate blocks that one task takes in a row
QUERY_TILES = 8                 # query blocks that meet them there
BLOCK = "dim int, block int, body binary"
NEAR = "q long, c long, score double"
_EPS = 1e-6                     # float rounding of the bounds themselves


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _block(vectors: np.ndarray, ids: np.ndarray) -> bytes:
    """Number, length, ids and components; these as floats, if that is exact."""
    with np.errstate(over="ignore", under="ignore"):
        short = vectors.astype("<f4")
    exact = np.array_equal(short.astype("<f8"), vectors)
    return np.array([*vectors.shape, exact], "<i8").tobytes() + ids.astype("<i8").tobytes() + (short if exact else vectors.astype("<f8")).tobytes()


def _unblock(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d, short = np.frombuffer(body, "<i8", 3)
    return np.frombuffer(body, "<i8", n, 24), np.frombuffer(body, "<f4" if short else "<f8", n * d, 24 + 8 * n).reshape(n, d).astype(np.float64)


def pack_blocks(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("v").to_numpy()
    by = np.argsort(ids)
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(ids), -1)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([_block(vectors[by], ids[by])], pa.binary())],
                    names=["dim", "block", "body"])


class Quantised:
    """Unit vectors as int8 with scale, norm of the int8 part and of the rest."""

    def __init__(self, body: bytes) -> None:
        self.ids, self.vectors = _unblock(body)
        big = np.abs(self.vectors).max(axis=1, keepdims=True)
        scaled = self.vectors / big  # no overflow in the squares
        unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        self.scaled = scaled
        self.norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.int8 = np.rint(unit / self.scale[:, None]).astype(np.int8)
        coarse = self.int8 * self.scale[:, None]
        self.coarse = np.sqrt(np.einsum("ij,ij->i", coarse, coarse))
        rest = unit - coarse
        self.rest = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        # float32 products of int8 are exact below 2**24
        self.product = self.int8.astype(np.float32 if 127 * 127 * unit.shape[1] < 1 << 24 else np.float64)


def cosines(q: Quantised, i: np.ndarray, c: Quantised, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, pair by pair."""
    out = np.empty(len(i))
    for a in range(0, len(i), 4096):
        s = slice(a, a + 4096)
        out[s] = np.einsum("ij,ij->i", q.scaled[i[s]], c.scaled[j[s]]) / (q.norms[i[s]] * c.norms[j[s]])
    return out


class Heaps:
    """The best ``keep`` candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, keep: int) -> None:
        self.ids, self.keep, self.heaps = ids, keep, [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def offer(self, row: np.ndarray, score: np.ndarray, c: np.ndarray) -> None:
        for r, s, x in zip(row.tolist(), score.tolist(), c.tolist()):
            heap = self.heaps[r]
            if len(heap) < self.keep:
                heapq.heappush(heap, (s, -x))
            elif (s, -x) > heap[0]:
                heapq.heapreplace(heap, (s, -x))
            if len(heap) == self.keep:
                self.floor[r] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(int(q), -c, s) for q, heap in zip(self.ids, self.heaps) for s, c in heap]
        q, c, s = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["q", "c", "score"])


def tile(q: Quantised, c: Quantised, heaps: Heaps) -> int:
    """One tile: bound, keep the possible, recompute, merge. Returns how many
    pairs were recomputed."""
    estimate = (q.product @ c.product.T).astype(np.float64) * q.scale[:, None] * c.scale
    error = q.coarse[:, None] * c.rest + q.rest[:, None] + _EPS
    keep = min(heaps.keep, estimate.shape[1])
    low = np.partition(estimate - error, -keep, axis=1)[:, -keep]
    floor = heaps.floor if keep < heaps.keep else np.maximum(heaps.floor, low)
    i, j = np.nonzero(estimate + error >= floor[:, None])
    heaps.offer(i, cosines(q, i, c, j), c.ids[j])
    return len(i)


def search_tiles(keep: int):
    """Rows (dim, q_group, c_group, is_candidate, block, body), those of a group
    together and its query blocks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked = None, []
        for batch in batches:
            for *group, is_candidate, body in zip(*(batch.column(x) for x in ("dim", "q_group", "c_group", "is_candidate", "body"))):
                here = tuple(x.as_py() for x in group)
                if here != current:
                    for _, heaps in asked:
                        yield heaps.batch()
                    current, asked = here, []
                if not is_candidate.as_py():
                    q = Quantised(body.as_py())
                    asked.append((q, Heaps(q.ids, keep)))
                elif asked:
                    c = Quantised(body.as_py())
                    for q, heaps in asked:
                        tile(q, c, heaps)
        for _, heaps in asked:
            yield heaps.batch()
    return run


def _cut(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // rows))
    out = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(n)).cast("int").alias("block"), "v", "vector")
    return out.groupBy("dim", "block").applyInArrow(pack_blocks, BLOCK), n


def nearest(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines of each row
    for which ``is_query`` (of column ``id``) holds, ties to smaller ids."""
    rows = (table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & usable("vector")))
    rows = rows.withColumn("h", F.xxhash64("vector"))
    # the rows of a vector: its k + 1 smallest ids; the smallest names it
    by_vector = Window.partitionBy("h", "vector")
    ranked = (rows.dropDuplicates(["h", "vector", "id"])
              .withColumn("r", F.row_number().over(by_vector.orderBy("id"))).filter(F.col("r") <= k + 1)
              .withColumn("v", F.min("id").over(by_vector)))
    ranked = written(ranked.select("id", "v", "r", "h", "vector"), "vectors")
    distinct = ranked.filter("r = 1").select("h", "v", "vector")
    asking = rows.filter(is_query).select("id", "h", "vector").join(distinct.select("h", "vector", "v").hint("merge"), ["h", "vector"]).select("id", "v", "h")
    wanted = asking.groupBy("v").agg(F.min("id").alias("any"))
    candidates, n_blocks = _cut(distinct, ROWS)
    queries, n_query_blocks = _cut(distinct.join(wanted, "v", "left_semi"), QUERY_ROWS)
    # every group of query blocks meets every group of candidate blocks, once
    q_groups, c_groups = -(-n_query_blocks // QUERY_TILES), -(-n_blocks // TILES)
    bound_batches(table.sparkSession)
    tiles = (queries.select("dim", F.floor(F.col("block") / QUERY_TILES).cast("int").alias("q_group"), F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))).alias("c_group"),
                            F.lit(False).alias("is_candidate"), "block", "body")
             .unionByName(candidates.select("dim", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))).alias("q_group"), F.floor(F.col("block") / TILES).cast("int").alias("c_group"),
                                            F.lit(True).alias("is_candidate"), "block", "body")))
    tiles = (tiles.repartitionById(q_groups * c_groups, F.col("q_group") * c_groups + F.col("c_group"))
             .sortWithinPartitions("dim", "q_group", "c_group", "is_candidate", "block"))
    near = tiles.drop("block").mapInArrow(search_tiles(k + 1), NEAR)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("q", "c", "score")
    named = near.join(ranked.select(F.col("v").alias("c"), F.col("id").alias("vec_id")), "c")
    # of each searched vector the 2 k + 2 best rows, enough whichever is the query's own
    named = (named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
             .filter(F.col("r") <= k + 1).select(F.col("q").alias("v"), "vec_id", "score"))
    pairs = asking.select(F.col("id").alias("query_id"), "v").distinct().join(named, "v").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


QUERIES = {"op1_block_matrix_ann": op1_block_matrix_ann}
