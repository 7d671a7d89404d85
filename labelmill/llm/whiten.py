"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are taken to an upper bidiagonal matrix B with X V = U B, one column a step: u_j is X v_j without
its part along u_(j-1), and v_(j+1) is X'u_j without its part along v_j. Both are orthogonalised against all of their
predecessors again. A step is one pass over the rows (two where the first orthogonalisation cancels much): a task
works out X p, X'(X p) and the inner products with all earlier u for its own rows, and their sums are a few
numbers for each dimension. A left vector is kept as its coefficients (u = X w), so nothing as long as the
table is stored. Where a step breaks down, it goes on with a new direction, so repeated eigenvalues are found like
others. The small singular value decomposition of B gives components and deviations.

Steps end once the wanted components have converged and the variance not reached yet is less than the least
of them (no other component can be larger then), or when the space is exhausted.

Sums of dimensions and squared deviations are exact integers; centred values are (n x - S) / n from exact integers.

Defined results: vectors that are null, empty or hold a null or non-finite entry take no part, nor do those of
another length than the commonest (the longer on a tie); rows without a vec_id and repeated rows take part as they
are; a component without variance has `explained` 0 and a null `whitened`; a deviation beyond the range of long is null;
an empty table gives no rows; other columns are ignored, whatever their names. Entries are exact up to about 2**40.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import durable

from . import common

#: Rows that one vectorised pass works on.
BLOCK_ROWS = 4096
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary())])
_WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                       ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


@dataclass
class Whitening:
    """n rows with per-dimension sums; components as columns, their eigenvalues, trace and error of the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None
    steps: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x) / float(self.n)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        return self.n * (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        apart = self.apart(x)
        largest = int(np.abs(apart).max(initial=0))
        if largest ** 2 * apart.shape[1] < 1 << 63:
            return (apart ** 2).sum(axis=1).tolist()
        exact = (sum(v * v for v in row) for row in apart.tolist())
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components of some variance, scaled to deviation one; other columns are zero."""
        some = self.values > 0
        scale = np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0)
        return self.centred(x) @ self.components * scale


# --- rows ---


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with vectors of the commonest length that hold finite numbers only."""
    number = lambda x: x.cast("double")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(good)
    most = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("embedding") == (most["length"] if most else 0))


def whole(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) + shift."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long") + F.lit(shift).cast("long"))
    return usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield common.table({"ids": [part.column("vec_id").to_pylist()], "x": [flat.astype(np.int64).tobytes()]}, _BLOCK)


def _rows(x: bytes, size: int) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64).reshape(-1, size)


def summed(blocks: DataFrame, size: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the `width` numbers that `of` works out from a block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column("x"):
                total += of(_rows(x.as_py(), size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], type=pa.list_(pa.float64()))], names=["v"])

    parts = blocks.select("x").mapInArrow(run, "v array<double>")
    row = parts.agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]).first()
    return np.array([v or 0.0 for v in row], dtype=np.float64)


# --- bidiagonalisation ---


def _apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """`v` without its part in the space of the columns of `basis`."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], size: int, total: float,
                  wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors as columns, singular values, steps) of X, the largest `wanted`.

    `product(p, w)` gives X'(X p), (X w)'(X p) and |X p|^2; `total` is the squared norm of X.
    """
    rng = np.random.default_rng(seed)
    # Below this a direction is rounding alone: the step counts as broken down.
    tiny = 1e-11 * np.sqrt(total)
    v, w, z = (np.zeros((size, size)) for _ in range(3))
    small = np.zeros((size, size))
    start = rng.standard_normal(size)
    v[:, 0] = start / np.linalg.norm(start)
    beta = 0.0
    for j in range(size):
        p = v[:, j] - (beta * w[:, j - 1] if j else 0.0)
        for again in range(2):
            back, along, norm = product(p, w)
            p = p - w @ along
            back = back - z @ along
            left = norm - along @ along
            if left > 0.5 * norm:
                break
        alpha = np.sqrt(max(left, 0.0))
        if alpha > tiny:
            w[:, j], z[:, j] = p / alpha, back / alpha
        else:
            alpha = 0.0
        small[j, j] = alpha
        ahead = _apart(z[:, j] - alpha * v[:, j], v[:, :j + 1])
        beta = float(np.linalg.norm(ahead))
        left_vectors, values, right = np.linalg.svd(small[:j + 1, :j + 1])
        if j + 1 == size:
            break
        top = values[:wanted]
        converged = j + 1 > wanted and (beta * np.abs(left_vectors[j, :wanted]) <= 1e-14 * values[0]).all()
        if converged and total - (values ** 2).sum() < top[-1] ** 2:
            break
        if beta <= tiny:
            beta, ahead = 0.0, _apart(rng.standard_normal(size), v[:, :j + 1])
        v[:, j + 1] = ahead / np.linalg.norm(ahead)
        small[j, j + 1] = beta
    return (v[:, :j + 1] @ right.T)[:, :wanted], values[:wanted], j + 1


def fit(blocks: DataFrame, size: int, n: int, sums: list[int], wanted: int) -> Whitening:
    """Components of the rows in `blocks`."""
    model = Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    total = float(summed(blocks, size, 1, lambda x: (model.centred(x) ** 2).sum(keepdims=True).reshape(1))[0])

    def product(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            rows = model.centred(x)
            u = rows @ p
            return np.concatenate([rows.T @ u, (rows @ w).T @ u, [u @ u]])

        got = summed(blocks, size, 2 * size + 1, of)
        return got[:size], got[size:2 * size], float(got[-1])

    wanted = min(wanted, size)
    model.trace = total / n
    if total > 0:
        model.components, values, model.steps = bidiagonalise(product, size, total, wanted)
        model.values = np.where(values > 1e-13 * values[0], values ** 2 / n, 0.0)
    else:
        model.components, model.values = np.eye(size)[:, :wanted], np.zeros(wanted)
    k = len(model.values)
    some = np.flatnonzero(model.values > 0)
    if len(some):
        mean = summed(blocks, size, k, lambda x: model.whitened(x).sum(axis=0)) / n

        def outer(x: np.ndarray) -> np.ndarray:
            rows = model.whitened(x) - mean
            return (rows.T @ rows).ravel()

        covariance = summed(blocks, size, k * k, outer).reshape(k, k)[np.ix_(some, some)] / n
        model.identity_error = float(np.abs(covariance - np.eye(len(some))).max())
    return model


def _transform(model: Whitening, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        k = len(model.values)
        explained = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values]
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x")):
                x, ids = _rows(x.as_py(), size), ids.as_py()
                n = len(ids)
                values = np.where(model.values > 0, model.whitened(x), np.nan)
                deviations = model.deviations(x)
                yield common.table({
                    "vec_id": [i for i in ids for _ in range(k)], "component": np.tile(np.arange(1, k + 1, dtype=np.int32), n),
                    "n": np.full(n * k, model.n), "deviation": [d for d in deviations for _ in range(k)],
                    "whitened": pa.array(values.ravel(), from_pandas=True), "explained": explained * n,
                    "identity_error": [model.identity_error] * (n * k)}, _WHITENED)

    return run


def whiten(vectors: DataFrame, wanted: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every usable row and component."""
    rows = whole(vectors, scale, shift)
    blocks = durable(rows.mapInArrow(_pack, "ids array<long>, x binary"))
    shape = blocks.agg(F.sum(F.size("ids").cast("long")).alias("n"), F.sum(F.octet_length("x").cast("long")).alias("b")).first()
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    n, size = shape["n"], shape["b"] // shape["n"] // 8

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column("x"):
                total += _rows(x.as_py(), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "s"])

    by_dimension = blocks.select("x").mapInArrow(sums, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    exact = [int(r.s) for r in sorted(by_dimension.collect())]
    model = fit(blocks, size, n, exact, wanted)
    return blocks.mapInArrow(_transform(model, size), WHITENED)
