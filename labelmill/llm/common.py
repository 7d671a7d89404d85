"""Helpers shared by the training-data operators: blocks of texts and vectorised hashing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes that one vectorised pass works on, so that its arrays stay small whatever the batch holds.
BLOCK_BYTES = 1 << 19


def single_threaded() -> None:
    """Numeric libraries in a Spark task use the task's one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch with the columns in the order of `schema`."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about `limit` bytes each; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: A 64-bit value for each byte value, and an odd base with its inverse modulo 2**64.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


class RollingHash:
    """Hash of any slice of a byte block from prefix sums; equal slices have equal hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * _power_table(BASE, n), out=self.sums[1:])
        self.inverse = _power_table(INVERSE, n + 1)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, width: int) -> np.ndarray:
        """Hash of every slice of `width` bytes, in order of its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n]
