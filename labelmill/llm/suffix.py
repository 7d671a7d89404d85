"""Removal of repeated byte strings through a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `width` bytes (a window), by most-significant-digit passes of 8 bytes;
what is equal after the last pass are exactly the repeated windows, and a bucket of one needs no further pass.
A row for every suffix would be many times the text, so suffixes that share no window are left out before:

1. A window's anchor is the 32-byte gram in it whose scrambled hash is smallest (the leftmost such). Equal windows
   share it, and adjacent windows too, so that a run of about 35 windows is one row. Runs whose anchor occurs once are
   done, and of runs with the same anchor and bytes (64-bit hashes of both) the earliest goes on: the others repeat it.
2. The different runs with a common anchor are cut to stretches whose windows have the anchor at nearly the same place,
   first within a sixth of the width, then within a 25th. The bytes that all windows of a stretch would have take the
   anchor's part: what is alone is done, equal stretches are settled as equal runs are.
3. The windows that are left are sorted by their bytes: block by block in most-significant-digit passes, of which
   the earliest of equal windows goes on, then over the table.

Nothing hot meets in one task: equal runs of a batch and equal windows of a block send one row, and runs whose anchor has
several bodies in a batch are dealt by their bytes, two of them also by anchor to tell the others. Sorted
rows are read as a stream with one held back, so no bucket has to fit in memory.

Defined results: a null or empty text has nothing to remove; windows never cross documents; documents are
ordered by doc_id, a missing one first, and rows of one doc_id by a hash of their text; rows equal in id and text get
the same answer, judged as one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import durable

from . import common

WIDTH = 100
GRAM = 32
#: A longer text is cut into overlapping parts for hashing; positions in a part fit in 24 bits.
PART_BYTES = 4 << 20
_AT = np.uint64((1 << 24) - 1)

RUN = "gram long, body long, doc long, text_hash long, start long, n long, settled boolean, known boolean"
_RUN = pa.schema([(c.split()[0], pa.bool_() if "boolean" in c else pa.int64()) for c in RUN.split(", ")])
BUCKET = "doc long, text_hash long, start long, n long, open boolean"
_BUCKET = pa.schema([(c, pa.int64()) for c in ("doc", "text_hash", "start", "n")] + [("open", pa.bool_())])
WINDOW = "window binary, doc long, text_hash long, start long, n long"
_WINDOW = pa.schema([("window", pa.binary()), *((c, pa.int64()) for c in ("doc", "text_hash", "start", "n"))])
SPAN = "doc long, text_hash long, start long, n long"
_SPAN = pa.schema([(c, pa.int64()) for c in ("doc", "text_hash", "start", "n")])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", ")])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - have:][:len(values) - width + 1]) if have < width else out


def runs_of(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, gram hash, body hash) of the runs of windows that share an anchor."""
    gram = min(GRAM, width)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < width:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    begin = np.cumsum([0] + [len(t) for t in texts])
    rolling = common.RollingHash(data)
    grams = rolling.windows(gram)
    packed = (common.mix(grams) & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    anchor = sliding_min(packed, width - gram + 1) & _AT
    own = np.full(len(anchor) + 2, -1, dtype=np.int64)
    own[1:-1] = anchor
    for end in begin[1:].tolist():
        own[max(0, end - width + 1) + 1:min(end, len(anchor)) + 1] = -1
    new = own[1:] != own[:-1]
    starts = np.flatnonzero(new[:-1] & (own[1:-1] >= 0))
    ends = np.flatnonzero(new[1:] & (own[1:-1] >= 0)) + 1
    text = np.searchsorted(begin, starts, "right") - 1
    return text, starts - begin[text], ends - starts, grams[own[1:-1][starts]], common.mix(rolling.slices(starts, ends + width - 1))


def _parts(texts: list[bytes], width: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets, parts): blocks of texts, long ones in parts that overlap by a window less one byte."""
    rows, offsets, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), PART_BYTES):
            part = text[at:at + PART_BYTES + width - 1]
            if held and size + len(part) > common.BLOCK_BYTES:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield rows, offsets, held


def _dealt(gram, body, doc, hashed, start, n) -> pa.RecordBatch:
    """Rows of `RUN`: runs dealt by gram, as far as the rows at hand do not settle them."""
    # Of runs that are equal here the earliest goes on; the others are settled.
    both = common.mix(gram.view(np.uint64)) ^ body.view(np.uint64)
    by_value = np.argsort(both, kind="stable")
    same = both[by_value][1:] == both[by_value][:-1]
    often = by_value[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(both) else by_value
    order = often[np.lexsort((start[often], hashed[often], doc[often], body[often], gram[often]))]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (gram[order][1:] != gram[order][:-1]) | (body[order][1:] != body[order][:-1])
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    twin = (doc[order] == doc[lead]) & (hashed[order] == hashed[lead]) & (start[order] == start[lead])
    settled = np.zeros(len(gram), dtype=bool)
    settled[order[~twin]] = True
    # Settled runs are dealt out by their own place.
    place = common.mix(doc.view(np.uint64) * np.uint64(31) + hashed.view(np.uint64) + start.view(np.uint64))
    deal = np.where(settled, place.view(np.int64), gram)
    # Runs known here to share their gram with others are dealt by their bytes, two of each gram by both.
    left = np.flatnonzero(~settled)
    left = left[np.lexsort((body[left], gram[left]))]
    new = np.concatenate([[True], gram[left][1:] != gram[left][:-1]]) if len(left) else np.zeros(0, dtype=bool)
    last = np.concatenate([new[1:], [True]]) if len(left) else new
    shared = left[~(new & last)]
    deal[shared] = (common.mix(gram[shared].view(np.uint64)) ^ body[shared].view(np.uint64)).view(np.int64)
    known = np.zeros(len(gram), dtype=bool)
    known[shared] = True
    told = left[new ^ last]
    take = np.concatenate([np.arange(len(gram)), told])
    return common.table({"gram": np.concatenate([deal, gram[told]]), "body": body[take], "doc": doc[take], "text_hash": hashed[take],
                         "start": start[take], "n": n[take], "settled": settled[take],
                         "known": np.concatenate([known, np.zeros(len(told), dtype=bool)])}, _RUN)


def _find_runs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hashed = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            found = []
            for rows, offsets, parts in _parts(texts, width):
                text, start, n, gram, body = runs_of(parts, width)
                found.append((np.array(rows)[text], np.array(offsets)[text] + start, n, gram.view(np.int64), body.view(np.int64)))
            if found:
                row, start, n, gram, body = map(np.concatenate, zip(*found))
                yield _dealt(gram, body, doc[row], hashed[row], start, n)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs (open false) and the different runs that share an anchor (open true).

    Rows come ordered by gram, body and place. Held over from batch to batch: the earliest run of the last
    body, and whether its gram is known to have several bodies, in which case that run was given out.
    """
    held: tuple | None = None
    several = False
    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        whole = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "body", "doc", "text_hash", "start", "n", "known")]
        parts = [([c[settled] for c in whole[2:6]], False)]
        cols = [c[~settled] for c in whole]
        if len(cols[0]):
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held, cols)]
            gram, body, doc, hashed, start, n, known = cols
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new_body = new_gram | np.concatenate([[True], body[1:] != body[:-1]])
            heads = np.flatnonzero(new_body)
            lead = heads[np.cumsum(new_body) - 1]
            later = ~((doc == doc[lead]) & (hashed == hashed[lead]) & (start == start[lead]))
            of = np.cumsum(new_gram)[heads] - 1
            shared = np.bincount(of) > 1
            shared |= np.bincount(np.cumsum(new_gram) - 1, weights=known) > 0
            shared[0] |= several
            give = shared[of]
            give[0] &= not several
            parts += [([c[later] for c in (doc, hashed, start, n)], False),
                      ([c[heads[give]] for c in (doc, hashed, start, n)], True)]
            held, several = tuple(c[heads[-1]] for c in cols), bool(shared[-1])
        names = ("doc", "text_hash", "start", "n")
        rows = {c: np.concatenate([p[i] for p, _ in parts]) for i, c in enumerate(names)}
        yield common.table(rows | {"open": np.concatenate([np.full(len(p[0]), o) for p, o in parts])}, _BUCKET)


def stretches(data: np.ndarray, base: np.ndarray, n: np.ndarray, width: int, step: int) -> tuple[np.ndarray, ...]:
    """(run, first window, windows, gram, body) of the stretches of runs of n windows that start at `base` in `data`.

    Windows of a stretch have the anchor at one of `step` neighbouring places. `gram` is the hash of the bytes that
    all windows with the anchor at these places have, `body` that of the bytes of the stretch's own windows.
    """
    gram = min(GRAM, width)
    rolling = common.RollingHash(data)
    grams = common.mix(rolling.windows(gram)) & ~_AT
    anchor = np.zeros(len(base), dtype=np.int64)
    for at in range(0, len(base), 4000):
        anchor[at:at + 4000] = np.argmin(grams[base[at:at + 4000, None] + np.arange(width - gram + 1)], axis=1)
    # Windows of a run have their anchor at `anchor` down to `anchor - n + 1`.
    low, high = (anchor - n + 1) // step, anchor // step
    times = high - low + 1
    run = np.repeat(np.arange(len(base)), times)
    k = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + low[run]
    first = np.maximum(0, anchor[run] - k * step - step + 1)
    count = np.minimum(n[run] - 1, anchor[run] - k * step) - first + 1
    begin = base[run] + anchor[run] - k * step
    key = common.mix(rolling.slices(begin, begin + width - step + 1) + k.astype(np.uint64))
    begin = base[run] + first
    return run, first, count, key, common.mix(rolling.slices(begin, begin + count + width - 1))


def _block_stretches(width: int, step: int):
    def of_block(pieces: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        doc, hashed, start, n = (np.array(c, dtype=np.int64) for c in list(zip(*pieces))[:4])
        data = np.frombuffer(b"".join(p[4] for p in pieces), dtype=np.uint8)
        sizes = n + width - 1
        run, first, count, key, body = stretches(data, np.cumsum(sizes) - sizes, n, width, step)
        yield _dealt(key.view(np.int64), body.view(np.int64), doc[run], hashed[run], start[run] + first, count)

    return of_block


def radix_groups(data: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, bucket) of the windows data[b:b + width] that are not alone in their bucket, by bucket.

    Most-significant-digit passes of 8 bytes: each splits the buckets of the pass before and drops buckets of one.
    """
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(data) - 8, dtype=np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k:len(words) + k]
    member, bucket = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64)
    for at in range(0, width, 8):
        digit = words[begin[member] + at] >> np.uint64(8 * max(0, at + 8 - width))
        order = np.lexsort((digit, bucket))
        member, bucket, digit = member[order], bucket[order], digit[order]
        new = np.ones(len(member) + 1, dtype=bool)
        new[1:-1] = (bucket[1:] != bucket[:-1]) | (digit[1:] != digit[:-1])
        among = ~(new[:-1] & new[1:])
        member, bucket = member[among], np.cumsum(new[:-1])[among]
    return member, bucket


def _spans(doc, hashed, start) -> dict[str, np.ndarray]:
    """Neighbouring windows as one span; places in order."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return {"doc": doc[first], "text_hash": hashed[first], "start": start[first], "n": np.diff(np.append(first, len(doc)))}


def _binary(data: np.ndarray, begin: np.ndarray, width: int) -> pa.Array:
    cells = np.ascontiguousarray(data[begin[:, None] + np.arange(width)])
    offsets = (np.arange(len(begin) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(cells)])


def _block_windows(width: int, pieces: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a block as spans without a window, and the earliest of all its windows with their bytes."""
    doc, hashed, start, n = (np.array(c, dtype=np.int64) for c in list(zip(*pieces))[:4])
    data = np.frombuffer(b"".join(p[4] for p in pieces), dtype=np.uint8)
    sizes = n + width - 1
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(sizes) - sizes, n) + j
    doc, hashed, start = doc[row], hashed[row], start[row] + j
    member, bucket = radix_groups(data, begin, width)
    order = np.lexsort((start[member], hashed[member], doc[member], bucket))
    member, bucket = member[order], bucket[order]
    new = np.ones(len(member), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    lead = member[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(member) else member
    gone = np.zeros(len(row), dtype=bool)
    gone[member[~new]] = True
    again = member[(doc[member] != doc[lead]) | (hashed[member] != hashed[lead]) | (start[member] != start[lead])]
    again = again[np.lexsort((start[again], hashed[again], doc[again]))]
    if len(again):
        spans = _spans(doc[again], hashed[again], start[again])
        yield common.table({"window": pa.nulls(len(spans["doc"]), pa.binary())} | spans, _WINDOW)
    left = np.flatnonzero(~gone)
    for at in range(0, len(left), 50_000):
        some = left[at:at + 50_000]
        yield common.table({"window": _binary(data, begin[some], width), "doc": doc[some], "text_hash": hashed[some],
                            "start": start[some], "n": np.ones(len(some), dtype=np.int64)}, _WINDOW)


def _bodies(width: int, of_block):
    """Applies `of_block` to blocks of (doc, text_hash, start, n, bytes) of the listed runs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, hashed, text, runs in zip(*(batch.column(c) for c in ("doc", "text_hash", "text", "runs"))):
                doc, hashed, text = doc.as_py(), hashed.as_py(), text.as_py()
                for start, n in zip(runs.values.field("start").to_numpy().tolist(), runs.values.field("n").to_numpy().tolist()):
                    body = text[start:start + n + width - 1]
                    held.append((doc, hashed, start, n, body))
                    size += len(body)
                    if size > common.BLOCK_BYTES:
                        yield from of_block(held)
                        held, size = [], 0
        if held:
            yield from of_block(held)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows, in order of their bytes and places, that an earlier place holds too."""
    lead = None
    for batch in batches:
        out = []
        for window, *place in zip(*(batch.column(c).to_pylist() for c in _WINDOW.names)):
            if window is None:
                out.append(place)
            elif lead is None or window != lead[0]:
                lead = window, place
            elif place != lead[1]:
                out.append(place)
        if out:
            yield common.table(dict(zip(_SPAN.names, zip(*out))), _SPAN)


def kept_of(text: bytes, spans: list[tuple[int, int]], width: int) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, remaining bytes) for spans (first window, windows)."""
    runs: list[list[int]] = []
    for start, n in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + n - 1 + width)
        else:
            runs.append([start, start + n - 1 + width])
    edges = [0, *(edge for run in runs for edge in run), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text) - len(kept), len(runs), kept


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, starts, counts in zip(*(batch.column(c) for c in ("doc_id", "text", "starts", "counts"))):
                text = text.as_py() or b""
                spans = list(zip(starts.as_py() or [], counts.as_py() or []))
                removed, n, kept = kept_of(text, spans, width)
                out.append((doc_id.as_py(), len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            if out:
                yield common.table(dict(zip(_RESULT.names, zip(*out))), _RESULT)

    return run


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: nobody reads those again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, text_hash, start, n): n windows from byte `start` on that also start earlier.

    `rows` has doc, text_hash and the text as bytes; other columns are only passed to the join.
    """

    def settle(runs: DataFrame) -> DataFrame:
        runs = runs.repartition("gram").sortWithinPartitions("gram", "settled", "body", "doc", "text_hash", "start")
        return runs.mapInArrow(_buckets, BUCKET)

    def bodies(buckets: DataFrame, of_block, schema: str) -> DataFrame:
        # A run that was dealt twice counts once.
        listed = buckets.filter("open").groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
        return rows.join(listed, ["doc", "text_hash"]).select(*rows.columns, "runs").mapInArrow(_bodies(width, of_block), schema)

    with shuffles_dropped(rows.sparkSession):
        levels = [durable(settle(rows.mapInArrow(_find_runs(width), RUN)))]
    for share in (6, 25):
        levels.append(settle(bodies(levels[-1], _block_stretches(width, max(1, width // share)), RUN)))
    found = bodies(levels[-1], partial(_block_windows, width), WINDOW)
    found = found.repartition(F.when(F.col("window").isNull(), F.hash("doc", "text_hash", "start")).otherwise(F.hash("window")))
    found = found.sortWithinPartitions("window", "doc", "text_hash", "start")
    spans = found.mapInArrow(_neighbours, SPAN)
    for buckets in levels:
        spans = spans.unionByName(buckets.filter("not open").select("doc", "text_hash", "start", "n"))
    return spans


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # All joins of the texts take all columns of `rows`, so that one shuffle of the texts serves all.
    spans = repeated_spans(rows, width)
    by_doc = spans.groupBy("doc", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = rows.join(by_doc, ["doc", "text_hash"], "left").select("doc_id", "text", "starts", "counts")
    return joined.mapInArrow(_cut(width), RESULT)
