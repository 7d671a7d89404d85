"""Exact top-k inner products through ball trees, branch and bound per shard.

Vectors become whole numbers floor(scale * x). Candidates are dealt to shards by a hash of their id; a shard
is packed into one row. Inside a shard a ball tree halves the points along the line between two far points;
a node knows its centre and radius, and no point of it can score more than q . centre + |q| * radius for a
query q. Nodes are visited by falling bound, and a query leaves the rest once the bound is below its current
kth score.

Queries come in blocks, and the work is (block, shard) pairs, joined by shard number. There are two rounds. In the
first each block meets one shard, which gives every query a kth score to start from; the second takes that score
into all shards, so most nodes are cut off at once. A shard returns at most k candidates for a query; they are merged by
partial aggregation and a rank.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of
equal length are compared; ties go to the smaller vec_id; a row's own vec_id is never its candidate; rows that
repeat a vec_id are candidates of their own and one query (the smallest vector); rows without a vec_id take no part; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.session import durable

LEAF = 128
#: Vectors of a shard and queries of a block, in numbers (64 dimensions: about 4 MB and 1 MB).
SHARD_NUMBERS = 1 << 19
BLOCK_NUMBERS = 1 << 17

HIT = "query_id long, vec_id long, score long"
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class BallTree:
    """Points in tree order; nodes as (start, end, left, right) with centres and radii."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        nodes, centres, radii = [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            own = points[order[start:end]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            nodes.append([start, end, -1, -1])
            centres.append(centre)
            radii.append(float(np.sqrt(away.max())))
            if end - start > LEAF and away.max() > 0:
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own @ (b - a), half)]
                stack += [(start + half, end, at, 1), (start, start + half, at, 0)]
        # Sums of products stay exact in doubles below 2**53; larger numbers are multiplied as integers.
        large = float(np.abs(points).max(initial=0)) ** 2 * points.shape[1] >= 2.0 ** 51
        self.points, self.ids = points[order].astype(np.int64 if large else np.float64), ids[order]
        self.nodes = np.array(nodes)
        self.leaves = np.flatnonzero(self.nodes[:, 2] < 0)
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the best k candidates of each query that score at least `floor`."""
        norms = np.sqrt((queries ** 2).sum(axis=1))
        slack = 1e-6 * (1 + norms * (np.abs(self.centres).max(initial=0) * queries.shape[1] + self.radii.max()))
        kth = floor.astype(np.float64).copy()
        best_score = np.full((len(queries), k), -np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

        def bound(rows: np.ndarray, node: int) -> np.ndarray:
            return queries[rows] @ self.centres[node] + norms[rows] * self.radii[node] + slack[rows]

        # Depth first, the side with the larger mean bound first, with the queries that can still gain.
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            rows = rows[bound(rows, node) >= kth[rows]]
            if not len(rows):
                continue
            start, end, left, right = self.nodes[node]
            if left >= 0:
                lower, upper = sorted((left, right), key=lambda child: bound(rows, child).mean())
                stack += [(lower, rows), (upper, rows)]
                continue
            scores = (queries[rows].astype(self.points.dtype) @ self.points[start:end].T).astype(np.float64)
            ids = np.broadcast_to(self.ids[start:end], scores.shape)
            scores = np.where((ids == own[rows][:, None]) | (scores < kth[rows][:, None]), -np.inf, scores)
            keep = np.flatnonzero(scores.max(axis=1) > -np.inf)
            if not len(keep):
                continue
            rows = rows[keep]
            scores = np.concatenate([best_score[rows], scores[keep]], axis=1)
            ids = np.concatenate([best_id[rows], ids[keep]], axis=1)
            top = np.lexsort((ids, -scores), axis=1)[:, :k]
            best_score[rows], best_id[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
            kth[rows] = np.maximum(kth[rows], best_score[rows][:, -1])
        row, column = np.nonzero(best_score > -np.inf)
        return row, best_id[row, column], best_score[row, column].astype(np.int64)


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part, with v as whole numbers."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def packed(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row for each length and value of `key`: ids and vectors as two flat arrays."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").combine_chunks()
        flat = table.column("v").combine_chunks().flatten()
        size = table.column("size")[0].as_py()
        pick = table.column(name)[0].as_py()
        return pa.table({"size": pa.array([size], pa.int32()), name: pa.array([pick], pa.int64()),
                         f"{name}_ids": pa.array([ids.to_numpy().tobytes()]), f"{name}_v": pa.array([flat.to_numpy().tobytes()])})

    keyed = rows.select("vec_id", "v", F.size("v").alias("size"), key.cast("long").alias(name))
    return keyed.groupBy("size", name).applyInArrow(run, f"size int, {name} long, {name}_ids binary, {name}_v binary")


def _numbers(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, size).astype(np.float64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                size, shard, ids, v, q_ids, q, floor = (batch.column(c)[row].as_py() for c in (
                    "size", "shard", "shard_ids", "shard_v", "block_ids", "block_v", "floors"))
                if (size, shard) != of:
                    tree, of = BallTree(_numbers(v, size), np.frombuffer(ids, dtype=np.int64)), (size, shard)
                own = np.frombuffer(q_ids, dtype=np.int64)
                least = np.full(len(own), -np.inf)
                if floor:
                    known = {f["query_id"]: f["floor"] for f in floor}
                    least = np.array([known.get(i, -np.inf) for i in own.tolist()], dtype=np.float64)
                at, vec, score = tree.search(_numbers(q, size), own, k, least)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(vec), pa.array(score)], schema=_HIT)

    return run


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, shard_numbers: int = SHARD_NUMBERS,
          block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """query_id, rank, vec_id and score of the best k candidates of every row that `query` (on vec_id) picks."""
    rows = durable(whole(vectors, scale))
    asked = rows.filter(query).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = rows.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    wanted = asked.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    shards, blocks = max(1, -(-total // shard_numbers)), max(1, -(-wanted // block_numbers))
    shard = durable(packed(rows, F.pmod(F.xxhash64("vec_id"), F.lit(shards)), "shard"))
    block = durable(packed(asked, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)), "block"))
    kind = "array<struct<query_id:bigint,floor:bigint>>"

    # Round one: a block meets the shard of its own number.
    first = block.withColumn("shard", F.pmod("block", F.lit(shards))).withColumn("floors", F.lit(None).cast(kind))
    seen = _best(first.join(shard, ["size", "shard"]).mapInArrow(_search(k), HIT), k)
    floors = durable(seen.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
    placed = floors.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(blocks))).groupBy("block").agg(
        F.collect_list(F.struct("query_id", "floor")).alias("floors"))

    # Round two: all shards.
    second = block.join(placed, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return _best(second.join(shard, ["size", "shard"]).mapInArrow(_search(k), HIT), k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
