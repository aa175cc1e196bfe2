"""Bitmaps of bounded size over any number of keys: a filter whose false
positives may only add work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import mix

MAX_BITS = 1 << 28            # 32 MB, whatever the input
MAKERS = 64                   # tasks that build partial bitmaps
_U = np.uint64


def bits_for(n: int, most: int = MAX_BITS) -> int:
    return max(1 << 10, min(most, 1 << (16 * max(1, n)).bit_length()))


def contains(marked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys hit the bitmap (uint8 array)."""
    b = mix(keys.astype(_U)) & _U(len(marked) * 8 - 1)
    return (marked[(b >> _U(3)).astype(np.int64)] >> (b & _U(7)).astype(np.uint8)) & 1 == 1


def bitmap(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> bytes:
    """Bitmap of the keys that ``keys`` takes from the batches of ``df``.
    Non-zero blocks are merged on the executors before the driver gets them."""
    block = min(bits, 1 << 19)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            b = mix(keys(batch).astype(_U)) & _U(bits - 1)
            np.bitwise_or.at(own, (b >> _U(3)).astype(np.int64), (_U(1) << (b & _U(7))).astype(np.uint8))
        blocks = own.reshape(-1, block // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 64):
            some = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())],
                                             names=["block", "body"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        body = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("body")])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["block", "body"])

    out = np.zeros((bits // block, block // 8), np.uint8)
    marks = df.coalesce(MAKERS).mapInArrow(mark, "block int, body binary")
    for r in marks.groupBy("block").applyInArrow(merge, "block int, body binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["body"], np.uint8)
    return out.tobytes()
