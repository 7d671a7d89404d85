"""SimHash near-duplicates through vantage-point trees.

Every document gets a 64-bit fingerprint: the majority of the bits of XXH64 (seed 42) over its three-word
shingles, repeats included. Different fingerprints are few and small against texts, and only they are searched.

A vantage-point tree over a sample of the fingerprints cuts Hamming space into shards. At a node with vantage
point v and border m, what lies within m of v goes left and what lies beyond goes right. By the triangle
inequality a pair within `radius` that the border parts has its left member beyond m - radius, so only the
members in that strip are copied to the right side and every linked pair meets in at least one shard. Inside
a shard the same recursion runs down to leaves of a few hundred fingerprints, whose pairs are compared. A
shard returns a spanning forest of its links, never the links themselves. Components are then found over the
forests' edges with alternating large-star and small-star rounds, each written to the checkpoint folder.

Defined results: a text without words, empty or null has fingerprint zero and is linked like any other; equal
fingerprints are linked; repeated rows and ids keep one row each in the result; a missing doc_id takes part, and
a component's id is its smallest doc_id (null only if it has none); an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.session import durable

from . import common

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a shard, and sampled fingerprints for each leaf of the tree that makes the shards.
SHARD_ROWS = 20_000
SAMPLE_PER_SHARD = 64
LEAF = 256

FINGERPRINT = "doc_id long, text_hash long, fp long"
_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


# --- fingerprints ---


def _hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, a bounded number at a time."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        yield np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - SHINGLE + 1]
    ends = ends[SHINGLE - 1:]
    for at in range(0, len(starts), 1 << 15):
        part = zip(starts[at:at + (1 << 15)].tolist(), ends[at:at + (1 << 15)].tolist())
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in part], dtype=np.uint64)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.array([len(h) for h in held])
            sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
            np.add.at(ones, rows, sums)
            np.add.at(total, rows, sizes)
            held.clear()
            rows.clear()

    size = 0
    for row, text in enumerate(texts):
        for h in _hashes(text):
            held.append(h)
            rows.append(row)
            size += len(h)
            if size >= 1 << 14:
                count()
                size = 0
    count()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        values = [fingerprints_of([(texts[i].as_py() or "").encode() for i in range(at, min(at + 1000, len(texts)))])
                  for at in range(0, len(texts), 1000)]
        fps = np.concatenate(values).view(np.int64) if values else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], schema=_FINGERPRINT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprint, FINGERPRINT)


# --- vantage-point trees ---


def distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int64)


def split(points: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """Vantage point and border that cut `points` into two parts, neither of them all.

    Of a few vantage points spread over the points, and borders that leave at least a fifth on either side
    where there are such, the one with the thinnest strip to be copied.
    """
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(np.int64)]:
        count = np.bincount(distance(points, v), minlength=65)
        upto = np.cumsum(count)
        for m in range(64):
            left, right = upto[m], len(points) - (upto[m - radius] if m >= radius else 0)
            if left == len(points) or right == len(points) or left == 0:
                continue
            uneven = min(left, len(points) - left) < 0.2 * len(points)
            cost = (uneven, max(left, right) if uneven else left + right)
            if best is None or cost < best[0]:
                best = cost, v, m
    return None if best is None else best[1:]


def sides(points: np.ndarray, v: np.uint64, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(points, v)
    return np.flatnonzero(d <= m), np.flatnonzero(d > m - radius)


def shard_tree(sample: np.ndarray, leaf: int, radius: int) -> tuple:
    """Nested (vantage point, border, left, right); a leaf is its shard number."""
    numbers = iter(range(1 << 62))

    def build(points: np.ndarray):
        at = split(points, radius) if len(points) > leaf else None
        if at is None:
            return next(numbers)
        left, right = sides(points, *at, radius)
        return (int(at[0]), int(at[1]), build(points[left]), build(points[right]))

    return build(np.unique(sample))


def route(points: np.ndarray, tree, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of the points that belong to it)."""
    stack = [(np.arange(len(points)), tree)]
    while stack:
        at, node = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        left, right = sides(points[at], np.uint64(node[0]), node[1], radius)
        stack += [(at[left], node[2]), (at[right], node[3])]


def close_pairs(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of different points within `radius`, some of them more than once."""
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) < 2:
            continue
        cut = split(points[at], radius, tries=4) if len(at) > LEAF else None
        if cut is not None:
            stack += [at[part] for part in sides(points[at], *cut, radius)]
            continue
        for i in range(0, len(at), LEAF):
            rows = at[i:i + LEAF]
            for j in range(i, len(at), 1 << 12):
                others = at[j:j + (1 << 12)]
                near = np.bitwise_count(points[rows][:, None] ^ points[others][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = rows[a], others[b]
                yield a[a < b], b[a < b]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n points the smallest point it is linked to through `pairs`."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _shard_edges(table: pa.Table) -> pa.Table:
    """Spanning forest of the links of a shard, as (fingerprint, smallest fingerprint of its tree)."""
    points = np.unique(table.column("fp").to_numpy())
    root = forest(len(points), close_pairs(points.view(np.uint64), RADIUS))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return pa.table([pa.array(points[linked]), pa.array(points[root[linked]])], schema=_EDGE)


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS, radius: int = RADIUS) -> DataFrame:
    """(u, v) with u > v: a forest that links exactly what a chain of close fingerprints links."""
    n = distinct.count()
    sample_rows = min(n, 200_000, max(2_000, SAMPLE_PER_SHARD * -(-n // shard_rows)))
    share = 1.0 if n <= sample_rows else sample_rows / n
    picked = distinct.filter(F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.lit(1_000_003)) <= share * 1_000_003)
    sample = np.array([r.fp for r in picked.select("fp").collect()], dtype=np.int64).view(np.uint64)
    leaf = max(16, int(shard_rows * max(len(sample), 1) / max(n, 1)))
    tree = shard_tree(np.sort(sample), leaf, radius) if n > shard_rows else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for shard, at in route(fps.view(np.uint64), tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(fps[at])], names=["shard", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(_shard_edges, "u long, v long")


# --- components ---


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that `edges` (u, v) connect with the node.

    Large-star and small-star rounds in turn until a round changes nothing.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    shape = None
    while True:
        edges = durable(stars(stars(edges, True), False).filter("u <> v"))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == shape:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        shape = now


def near_duplicates(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of `docs`."""
    marked = durable(fingerprints(docs))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, shard_rows))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each group of near duplicates, all columns: the one with the smallest doc_id (then text hash).

    Rows without an id come after the others. Of rows that are equal in id and text one stays.
    """
    return first_rows(docs, near_duplicates(docs, shard_rows))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of `docs` of each root in `found` (doc_id, text_hash, root), all columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    chosen = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("_kept_id"), F.col("first.text_hash").alias("_kept_hash"))
    keyed = docs.withColumn("_row_id", F.col("doc_id").cast("long")).withColumn("_row_hash", F.xxhash64("text"))
    kept = keyed.join(chosen, (F.col("_row_hash") == F.col("_kept_hash")) & F.col("_row_id").eqNullSafe(F.col("_kept_id")))
    one = Window.partitionBy("_row_hash", "_row_id").orderBy(F.lit(1))
    return kept.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select(*[docs[c] for c in docs.columns])
