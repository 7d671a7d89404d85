"""Vector codes: product quantisation by Lloyd rounds over cover trees.

Vectors become whole numbers and are cut into equal consecutive parts, each with a codebook of its own. Every
partition packs its rows into blocks and builds a cover tree for each part of a block: a node's centre is one of its
points, its children's centres lie more than half its radius apart and each point is within half the radius of
its child's centre. Points stand in tree order with cumulative sums, so the sum over a subtree is one difference.

A Lloyd round walks down the trees. If a node's centre is nearer to one entry than to any other by more than
twice the node's radius, the triangle inequality gives all of its points to that entry, and count and sum of the
subtree are added as they are. Other nodes descend; points of ambiguous leaves are compared exactly, in
integers. A round moves the sums of the entries only, and results do not depend on how rows are dealt.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do those of
another length than the commonest (the longer on a tie); a length that the parts do not divide is cut as evenly as
can be; a codebook starts from the rows with the smallest vec_id (repeated ids by vector, missing ids last), fewer
where there are fewer rows; ties go to the lower entry; repeated rows have a code each; an empty table gives no
rows and empty codebooks; other columns but `label` are ignored. Components are exact up to about 2**28 after scaling.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import durable

from . import common, whiten

#: Rows of a block, whose trees are built and walked together, and points of a leaf.
BLOCK_ROWS = 8192
LEAF = 12

Codebooks = list[np.ndarray]


class CoverTree:
    """Points in tree order; nodes with range, centre, radius and children, which stand side by side."""

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        start, end, centre, radius, first, children = [0], [len(points)], [0], [0.0], [0], [0]
        node = 0
        while node < len(start):
            a, b = start[node], end[node]
            own = order[a:b]
            away = self._away(own, centre[node])
            radius[node] = float(away.max(initial=0.0))
            if b - a > LEAF and radius[node] > 0:
                first[node] = len(start)
                groups, left, half, at = [], own, radius[node] / 2, centre[node]
                while len(left):
                    near = away <= half
                    groups.append((at, left[near]))
                    left = left[~near]
                    if len(left):
                        at = left[0]
                        away = self._away(left, at)
                children[node] = len(groups)
                for at, members in groups:
                    order[a:a + len(members)] = members
                    start.append(a)
                    end.append(a + len(members))
                    centre.append(at)
                    radius.append(0.0)
                    first.append(0)
                    children.append(0)
                    a += len(members)
            node += 1
        self.order = order.astype(np.int32)
        self.start, self.end = np.array(start), np.array(end)
        self.centres = points[centre]
        self.radius, self.first, self.children = np.array(radius), np.array(first), np.array(children)
        self.points = points[order]

    def _away(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subtrees as (node, entry) and single points as (place in tree order, entry)."""
        nodes, entries, places, nearest = [], [], [], []
        front = np.zeros(1, dtype=np.int64)
        while len(front):
            away = np.sqrt(squares(self.centres[front], book))
            best = away.argmin(axis=1)
            rows = np.arange(len(front))
            least = away[rows, best]
            away[rows, best] = np.inf
            sure = away.min(axis=1) - least > 2 * self.radius[front] * (1 + 1e-9) + 1e-6 * (1 + least)
            nodes.append(front[sure])
            entries.append(best[sure])
            front = front[~sure]
            inner = self.children[front] > 0
            leaves, front = front[~inner], front[inner]
            if len(leaves):
                at = spans(self.start[leaves], self.end[leaves] - self.start[leaves])
                places.append(at)
                nearest.append(squares(self.points[at], book).argmin(axis=1))
            front = spans(self.first[front], self.children[front])
        none = [np.zeros(0, dtype=np.int64)]
        return tuple(np.concatenate(part or none) for part in (nodes, entries, places, nearest))

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, componentwise sum) of the points of each entry."""
        upto = np.concatenate([np.zeros((1, self.points.shape[1]), dtype=np.int64), np.cumsum(self.points, axis=0)])
        nodes, entries, places, nearest = self.assign(book)
        count, total = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        np.add.at(count, entries, self.end[nodes] - self.start[nodes])
        np.add.at(total, entries, upto[self.end[nodes]] - upto[self.start[nodes]])
        np.add.at(count, nearest, 1)
        np.add.at(total, nearest, self.points[places])
        return count, total

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point, in the order the points were given."""
        nodes, entries, places, nearest = self.assign(book)
        out = np.zeros(len(self.points), dtype=np.int64)
        lengths = self.end[nodes] - self.start[nodes]
        out[spans(self.start[nodes], lengths)] = np.repeat(entries, lengths)
        out[places] = nearest
        error = ((self.points - book[out]) ** 2).sum(axis=1)
        back = np.argsort(self.order)
        return out[back], error[back]


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (points, entries), exact in integers."""
    out = np.empty((len(points), len(book)), dtype=np.int64)
    for entry, c in enumerate(book):
        out[:, entry] = ((points - c) ** 2).sum(axis=1)
    return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)


def cuts(size: int, parts: int) -> list[int]:
    return [i * size // parts for i in range(parts + 1)]


def _pack(parts: int, schema: pa.Schema):
    def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(tables).combine_chunks()
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("v").chunks])
        v = flat.astype(np.int64).reshape(rows.num_rows, -1)
        at = cuts(v.shape[1], parts)
        trees = [CoverTree(np.ascontiguousarray(v[:, a:b])) for a, b in zip(at, at[1:])]
        return common.table({"ids": [rows.column("vec_id").to_pylist()], "labels": [rows.column("label").to_pylist()],
                             "trees": [pickle.dumps(trees)]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if size + part.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield block(held)

    return run


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for batch in batches:
            for trees in batch.column("trees"):
                for held, tree, book in zip(total, pickle.loads(trees.as_py()), books):
                    count, sums = tree.sums(book)
                    held[:, 0] += count
                    held[:, 1:] += sums
        flat = np.concatenate([t.ravel() for t in total])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "s"])

    return run


def _codes(books: Codebooks, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c) for c in ("ids", "labels", "trees"))):
                found = [tree.codes(book) for tree, book in zip(pickle.loads(trees.as_py()), books)]
                codes = np.stack([c for c, _ in found], axis=1)
                yield common.table({"vec_id": ids.values, "label": labels.values, "codes": codes.tolist(),
                                    "error": np.sum([e for _, e in found], axis=0)}, schema)

    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes and squared error of every usable row; the codebook of each part)."""
    rows = whiten.usable(vectors)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label, v.alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    field = rows.select("label").limit(0).toArrow().schema.field("label").type
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(field)), ("trees", pa.binary())])
    blocks = durable(rows.mapInArrow(_pack(parts, schema), f"ids array<long>, labels array<{kind}>, trees binary"))
    start = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    at = cuts(len(start[0]) if start else 0, parts)
    books = [np.array([row[a:b] for row in start], dtype=np.int64).reshape(len(start), b - a) for a, b in zip(at, at[1:])]
    for _ in range(rounds if start else 0):
        got = blocks.select("trees").mapInArrow(_sums(books), "i long, s long").groupBy("i").agg(F.sum("s").alias("s"))
        flat = np.zeros(sum(len(b) * (b.shape[1] + 1) for b in books), dtype=np.int64)
        for r in got.collect():
            flat[r.i] = r.s
        moved, used = [], 0
        for book in books:
            own = flat[used:used + len(book) * (book.shape[1] + 1)].reshape(len(book), -1)
            used += own.size
            moved.append(np.where(own[:, :1] > 0, own[:, 1:] // np.maximum(own[:, :1], 1), book))
        books = moved
    out = pa.schema([("vec_id", pa.int64()), ("label", field), ("codes", pa.list_(pa.int64())), ("error", pa.int64())])
    return blocks.mapInArrow(_codes(books, out), f"vec_id long, label {kind}, codes array<long>, error long"), books
