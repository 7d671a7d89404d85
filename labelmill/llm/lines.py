"""Lines that repeat across documents, found through two Bloom filters and confirmed exactly.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least `least` code
points that two documents hold go from all of them but the one with the smallest doc_id.

Keys are told apart by a 64-bit code first. Codes are dealt to segments of the code space, so many that a segment
stands for about SEGMENT_BYTES of text whatever the size of the table, and each segment keeps two Bloom filters: a
code that the once-seen filter already holds goes into the twice-seen filter, otherwise into the once-seen one. Tasks
send a code once for a block of documents, in packed rows. The twice-seen filters hold only suspected repeats; up to
FILTER_BYTES in all, they are handed to every task of a second scan, which lets only lines with suspected keys leave
the task. Beyond that size the scan's lines meet the suspected codes in a semi-join. Suspects are grouped by
their whole key with partial aggregation, which confirms the repeats and picks the first document. Confirmed keys
then meet the suspects again to name the lines that go; keys with more than a thousandth of all suspects (fewer
than a thousand keys) are salted there.

Defined results: a null or empty text is one empty line; rows that share a doc_id count as one document, and rows
without one as one document behind all others, so copies inside a document stay; repeated rows each give a row; a
text all of whose lines go becomes empty; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import durable

from . import common

SEGMENT_BYTES = 4 << 20
FILTER_BYTES = 64 << 20
PROBES = 6
BITS_PER_KEY = 12
#: Codes that a task holds before it sends them.
HELD = 1 << 20
FAN = 256

SPACE = b" \t\n\x0b\x0c\r"
_STEPS = np.arange(PROBES, dtype=np.uint64)
_SENT = pa.schema([("segment", pa.int64()), ("codes", pa.binary()), ("again", pa.binary())])
_FILTER = pa.schema([("segment", pa.int64()), ("bits", pa.binary()), ("codes", pa.binary())])
_SUSPECT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("code", pa.int64()), ("key", pa.binary()),
                      ("places", pa.list_(pa.int32()))])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def keys_of(text: bytes, least: int) -> dict[bytes, list[int]]:
    """Keys of at least `least` code points, each with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE)
        if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
            continue
        found.setdefault(key.lower(), []).append(number)
    return found


def code_of(key: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(key)


# --- Bloom filters ---


def _probes(codes: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """(codes, PROBES) bit numbers in filters of `sizes` bits, powers of two."""
    first, step = common.mix(codes), common.mix(~codes) | np.uint64(1)
    masks = np.asarray(sizes, dtype=np.uint64) - np.uint64(1)
    return ((first[:, None] + _STEPS * step[:, None]) & (masks[..., None] if masks.ndim else masks)).astype(np.int64)


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys, a power of two."""
    return max(64, 1 << (keys * BITS_PER_KEY - 1).bit_length())


def seen_twice(chunks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Codes that more than one document may hold, from chunks of (distinct codes, those of several documents)."""
    once = np.zeros(filter_bits(max(1, sum(len(codes) for codes, _ in chunks))), dtype=bool)
    twice = [np.zeros(0, dtype=np.uint64)]
    for codes, again in chunks:
        at = _probes(codes, len(once))
        twice += [codes[once[at].all(axis=1)], again]
        once[at] = True
    return np.unique(np.concatenate(twice))


def twice_filter(codes: np.ndarray) -> bytes:
    bits = np.zeros(filter_bits(max(1, len(codes))), dtype=np.uint8)
    bits[_probes(codes, len(bits))] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Filters:
    """The twice-seen filters of all segments, side by side."""

    def __init__(self, segments: int, parts: list[tuple[int, bytes]]):
        self.sizes, self.base = np.zeros(segments, dtype=np.int64), np.zeros(segments, dtype=np.int64)
        for segment, bits in parts:
            self.sizes[segment] = 8 * len(bits)
        self.base[1:] = np.cumsum(self.sizes)[:-1]
        self.bits = np.zeros(int(self.sizes.sum()) // 8, dtype=np.uint8)
        for segment, bits in parts:
            at = self.base[segment] // 8
            self.bits[at:at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)

    def hold(self, codes: np.ndarray) -> np.ndarray:
        segments = (codes % np.uint64(len(self.sizes))).astype(np.int64)
        out = self.sizes[segments] > 0
        some = np.flatnonzero(out)
        if len(some):
            own = segments[some]
            at = self.base[own][:, None] + _probes(codes[some], self.sizes[own])
            out[some] = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
        return out


# --- scans ---


def _send(least: int, segments: int):
    def rows(documents: list[np.ndarray]) -> pa.RecordBatch:
        codes, count = np.unique(np.concatenate(documents), return_counts=True)
        of = (codes % np.uint64(segments)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        codes, count, of = codes[order], count[order], of[order]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = [*starts[1:].tolist(), len(of)]
        parts = [(codes[a:b], codes[a:b][count[a:b] > 1]) for a, b in zip(starts.tolist(), ends)]
        return common.table({"segment": of[starts], "codes": [c.tobytes() for c, _ in parts],
                             "again": [c.tobytes() for _, c in parts]}, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                found = keys_of((text.as_py() or "").encode(), least)
                if found:
                    held.append(np.fromiter(map(code_of, found), dtype=np.uint64, count=len(found)))
                    size += len(found)
                if size >= HELD:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _filter_segment(table: pa.Table) -> pa.Table:
    chunks = [(np.frombuffer(c.as_py(), dtype=np.uint64), np.frombuffer(a.as_py(), dtype=np.uint64))
              for c, a in zip(table.column("codes"), table.column("again"))]
    codes = seen_twice(chunks)
    keep = [0] if len(codes) else []
    return pa.table({"segment": [table.column("segment")[0].as_py() for _ in keep], "bits": [twice_filter(codes) for _ in keep],
                     "codes": [codes.tobytes() for _ in keep]}, schema=_FILTER)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes in batch.column("codes"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes.as_py(), dtype=np.int64))], names=["code"])


def _suspects(least: int, filters: Filters | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")
            rows: list[tuple] = []
            size = 0

            def block() -> pa.RecordBatch:
                codes = np.fromiter((code_of(r[2]) for r in rows), dtype=np.uint64, count=len(rows))
                keep = np.flatnonzero(filters.hold(codes)) if filters else np.arange(len(rows))
                kept = [rows[i] for i in keep.tolist()]
                return common.table({"doc_id": [r[0] for r in kept], "text_hash": [r[1] for r in kept], "code": codes[keep].view(np.int64),
                                     "key": [r[2] for r in kept], "places": [r[3] for r in kept]}, _SUSPECT)

            for doc, text_hash, text in zip(ids, hashes, texts):
                body = (text.as_py() or "").encode()
                rows += [(doc, text_hash, key, places) for key, places in keys_of(body, least).items()]
                size += len(body)
                if size >= common.BLOCK_BYTES:
                    yield block()
                    rows, size = [], 0
            if rows:
                yield block()

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, gone in zip(batch.column("text"), batch.column("gone")):
            lines, gone = (text.as_py() or "").split("\n"), set(gone.as_py() or ())
            counts.append(len(lines))
            dropped.append(len(gone))
            texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text.as_py() or "")
        yield common.table({"doc_id": batch.column("doc_id"), "text": texts, "n_lines": counts, "n_dropped": dropped}, _KEPT)


def suspects(docs: DataFrame, least: int = 10, filter_bytes: int = FILTER_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, text_hash, code, key and places of every key that may be in more than one document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    segments = max(1, -(-size // segment_bytes))
    sent = rows.select("text").mapInArrow(_send(least, segments), "segment long, codes binary, again binary")
    made = durable(sent.groupBy("segment").applyInArrow(_filter_segment, "segment long, bits binary, codes binary"))
    lines = "doc_id long, text_hash long, code long, key binary, places array<int>"
    if (made.agg(F.sum(F.octet_length("bits").cast("long"))).first()[0] or 0) <= filter_bytes:
        filters = Filters(segments, [(r.segment, bytes(r.bits)) for r in made.select("segment", "bits").collect()])
        return rows.mapInArrow(_suspects(least, filters), lines)
    codes = made.select("codes").mapInArrow(_unpack, "code long")
    return rows.mapInArrow(_suspects(least, None), lines).join(codes, "code", "left_semi")


def drop_repeats(docs: DataFrame, least: int = 10, filter_bytes: int = FILTER_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, text without the repeated lines, n_lines (before) and n_dropped of every row."""
    found = durable(suspects(docs, least, filter_bytes, segment_bytes))
    owner = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    repeats = durable(found.groupBy("code", "key").agg(F.min(owner).alias("first"), F.max(owner).alias("last"), F.count("*").alias("n"))
                      .filter("first <> last").select("code", "key", "first", "n"))
    hot = [r.code for r in repeats.filter(F.col("n") > found.count() / 1000).select("code").distinct().collect()]
    salted = F.col("code").isin(hot) if hot else F.lit(False)
    left = found.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FAN))).otherwise(F.lit(0).cast("long")))
    salts = F.sequence(F.lit(0).cast("long"), F.when(salted, F.lit(FAN - 1)).otherwise(F.lit(0)).cast("long"))
    right = repeats.select("code", "key", "first", F.explode(salts).alias("salt"))
    gone = left.join(right, ["code", "key", "salt"]).filter(~owner.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.flatten(F.collect_set("places")).alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    marked = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    return marked.select("doc_id", "text", "gone").mapInArrow(_drop, "doc_id long, text string, n_lines long, n_dropped long")
