"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are grouped by their number of distinct word shingles into classes that double in size. A class keeps
of each item the k smallest hash values (its bottom-k MinHash sketch), with k from the class's upper bound:
a document that holds a share `threshold` of an item's q shingles misses at most q - ceil(threshold * q)
of them, so it holds one of the k = floor((1 - threshold) * upper) + 1 smallest. Documents of any length are
therefore found without loss by looking their shingle hashes up in the sketches, and no estimate has to bridge
the difference in size between a short item and a long document. Candidates are verified by counting the
item's shingles that the document really holds.

The benchmark is the stated query set: it goes to the tasks in blocks of bounded size, and every block is
searched in all documents. Documents are read in place; only hits leave a task.

Words are runs of letters and digits in lower case; a shingle is five words, or all words of a shorter item.
Defined results: null and empty texts hold nothing and give no rows; an item without a word is never found;
repeated rows of either table are answered once each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
THRESHOLD = 0.8
#: Text of the benchmark that one pass over the documents searches for.
BLOCK_BYTES = 4 << 20

HIT = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()),
                  ("shared_shingles", pa.int64()), ("containment", pa.float64())])

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD_BYTES[0x80:] = True
_ORDER = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased UTF-8 bytes.

    Word bytes are ASCII letters and digits and what is beyond ASCII, but for the signs of Latin-1
    (U+0080 to U+00BF without ordinals and micro), general punctuation and CJK punctuation.
    """
    mask = np.zeros(len(data) + 2, dtype=bool)
    inner = mask[1:-1]
    inner[:] = _WORD_BYTES[data]
    for at in np.flatnonzero(data == 0xC2).tolist():
        if at + 1 < len(data) and data[at + 1] not in (0xAA, 0xB5, 0xBA):
            inner[at:at + 2] = False
    wide = np.flatnonzero((data == 0xE2) | (data == 0xE3))
    wide = wide[wide + 2 < len(data)]
    second = data[wide + 1]
    wide = wide[((data[wide] == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((data[wide] == 0xE3) & (second == 0x80))]
    for shift in range(3):
        inner[wide + shift] = False
    return np.flatnonzero(mask[1:-1] & ~mask[:-2]), np.flatnonzero(mask[1:-1] & ~mask[2:]) + 1


def words_of(text: str) -> list[bytes]:
    data = text.lower().encode()
    starts, ends = word_edges(np.frombuffer(data, dtype=np.uint8))
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total += words[i:i + n] * _ORDER[i]
    return common.mix(total)


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


class Index:
    """Sketches of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float):
        self.items, values, owners, widths = [], [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(WORDS, len(words))
            shingles = shingle_set(words, width)
            upper = 1 << (len(shingles) - 1).bit_length()
            keep = min(len(shingles), math.floor((1 - threshold) * upper + 1e-9) + 1)
            data = np.frombuffer(b" ".join(words), dtype=np.uint8)
            starts, ends = word_edges(data)
            hashes = np.unique(shingle_hashes(common.mix(common.RollingHash(data).slices(starts, ends)), width))
            values.append(hashes[:keep])
            owners.append(np.full(len(hashes[:keep]), len(self.items)))
            widths.append(np.full(len(hashes[:keep]), width))
            self.items.append((item_id, width, shingles))
        self.tables = {}
        if self.items:
            values, owners, widths = map(np.concatenate, (values, owners, widths))
            for width in np.unique(widths).tolist():
                of = widths == width
                order = np.argsort(values[of], kind="stable")
                keys, own = values[of][order], owners[of][order]
                seen = np.zeros(1 << 20, dtype=bool)
                seen[(keys >> np.uint64(44)).astype(np.int64)] = True
                self.tables[width] = (keys, own, seen)

    def candidates(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of `hashes` that are in a sketch, and the items."""
        keys, own, seen = self.tables[width]
        at = np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
        times = high - low
        pick = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), own[pick]


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts cut at white space; each part repeats the last words of the one before."""
    at, carry = 0, b""
    while at < len(text):
        end = at + limit
        if end < len(text):
            cuts = [c for c in (text.find(b" ", end), text.find(b"\n", end)) if c >= 0]
            end = min(cuts, default=len(text))
        part = carry + b" " + text[at:end]
        yield part
        tail = b""
        for cut in (1 << 12, len(part)):
            starts, ends = word_edges(np.frombuffer(part[-cut:].lstrip(bytes(range(0x80, 0xC0))), dtype=np.uint8))
            if len(starts) > WORDS or cut >= len(part):
                seen = part[-cut:].lstrip(bytes(range(0x80, 0xC0)))
                tail = b" ".join(seen[a:b] for a, b in zip(starts[-(WORDS - 1):].tolist(), ends[-(WORDS - 1):].tolist()))
                break
        carry, at = tail, end


def _hits(index: Index, texts: list[str | None], threshold: float) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of the rows that hold an item."""
    pairs: set[tuple[int, int]] = set()
    held: list[tuple[int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for piece in _pieces((text or "").lower().encode(), common.BLOCK_BYTES):
            held.append((row, piece))
            size += len(piece)
            if size >= common.BLOCK_BYTES:
                pairs |= _candidates(index, held)
                held, size = [], 0
    pairs |= _candidates(index, held)
    wanted: dict[int, list[int]] = {}
    for row, item in sorted(pairs):
        wanted.setdefault(row, []).append(item)
    hits = []
    for row, items in wanted.items():
        shared: dict[int, set[bytes]] = {item: set() for item in items}
        for piece in _pieces(texts[row].lower().encode(), common.BLOCK_BYTES):
            starts, ends = word_edges(np.frombuffer(piece, dtype=np.uint8))
            words = [piece[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            sets = {width: shingle_set(words, width) for width in {index.items[item][1] for item in items}}
            for item in items:
                shared[item] |= index.items[item][2] & sets[index.items[item][1]]
        hits += [(row, item, len(shared[item])) for item in items
                 if len(shared[item]) >= threshold * len(index.items[item][2]) - 1e-9]
    return hits


def _candidates(index: Index, held: list[tuple[int, bytes]]) -> set[tuple[int, int]]:
    """(row, item) wherever a shingle of the row is in the item's sketch."""
    if not held:
        return set()
    data = np.frombuffer(b"\n".join(piece for _, piece in held), dtype=np.uint8)
    starts, ends = word_edges(data)
    first = np.searchsorted(starts, np.cumsum([0] + [len(piece) + 1 for _, piece in held]))
    words = common.mix(common.RollingHash(data).slices(starts, ends))
    owner = np.repeat([row for row, _ in held], np.diff(first))
    part = np.repeat(np.arange(len(held)), np.diff(first))
    pairs: set[tuple[int, int]] = set()
    for width in index.tables:
        hashes = shingle_hashes(words, width)
        at, items = index.candidates(hashes, width)
        whole = part[at] == part[at + width - 1]
        pairs |= set(zip(owner[at][whole].tolist(), items[whole].tolist()))
    return pairs


def _blocks_of_items(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item with a containment of at least `threshold`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())

    def search(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, threshold)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = _hits(index, batch.column("text").to_pylist(), threshold)
                if hits:
                    of, names, shared = zip(*hits)
                    total = [len(index.items[item][2]) for item in names]
                    yield common.table({
                        "doc_id": [ids[row] for row in of], "item_id": [index.items[item][0] for item in names],
                        "item_shingles": total, "shared_shingles": shared,
                        "containment": [s / n for s, n in zip(shared, total)]}, _HIT)

        return run

    found = None
    for items in _blocks_of_items(benchmark, block_bytes):
        hits = rows.mapInArrow(search(items), HIT)
        found = hits if found is None else found.unionByName(hits)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no item."""

    def keep(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, threshold)
            for batch in batches:
                bad = {row for row, _, _ in _hits(index, batch.column("text").to_pylist(), threshold)}
                yield batch.filter(pa.array([row not in bad for row in range(batch.num_rows)], type=pa.bool_()))

        return run

    for items in _blocks_of_items(benchmark, block_bytes):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
