"""Packing: bounded-space online packing of tokenised documents into fixed windows.

Every partition tokenises its documents and keeps a fixed number of open windows. A document is cut only
where it is longer than a window; whole windows close at once, and its last piece goes to the open window
that it fills best. When none has room, the fullest is emitted and a new one opened. Windows still open at
the end of a partition are merged: their pieces are dealt to a sixteenth of the partitions and packed the
same way until one partition is left, in an order that mixes lengths: the largest first would hold all windows
half full until they have to be emitted. Pieces, not token ids, move between the rounds, so a
round shuffles a few numbers for each open window.

Defined results: a null text counts as empty and gives the end id alone; repeated rows are packed once
each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import durable

from . import common

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
_OPEN = _PIECE.append(pa.field("open", pa.bool_()))

#: Words whose ids a worker remembers before it starts afresh.
CACHE_WORDS = 800_000
SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 49407
#: White space for Python, but signs for the tokenizer.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class WordIds:
    """Ids of texts through a bounded memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    space-separated parts. Unknown parts of a block go to the tokenizer in one string with the end marker
    between them; parts that hold marker characters go one by one.
    """

    def __init__(self, path: str):
        common.single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.codes = _Codes()
        self.stems: dict[str, bytes] = {}
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _store(self, first: int, ids: list[bytes]) -> None:
        """Ids of the words numbered from `first` on."""
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        total, n = int(lengths.sum()), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + total] = np.frombuffer(b"".join(ids), dtype=np.uint32)
        self.begin[first:first + n] = self.used + np.cumsum(lengths) - lengths
        self.count[first:first + n] = lengths
        self.used += total

    def _tokenise(self, text: str) -> np.ndarray:
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, dtype=np.uint32)

    def _learn(self, first: int, words: list[str]) -> None:
        """Words that differ in ASCII case or in one comma or full stop behind an ASCII letter share their stem's ids.

        Behind other letters the sign stays: the tokenizer may take such a letter apart, and what then stands before
        the sign can be a mark, which changes the ids.
        """
        parts = []
        for word in words:
            tail = word[-1] if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and word[-2].isascii() else ""
            stem = word[:-1] if tail else word
            parts.append((stem.lower() if stem.isascii() else stem, tail))
        new = list(dict.fromkeys(stem for stem, _ in parts if stem not in self.stems))
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            ids = self._tokenise(SEPARATOR.join(w if "<|" not in w else "" for w in some))
            edges = [-1, *np.flatnonzero(ids == SEPARATOR_ID).tolist(), len(ids)]
            raw = ids.tobytes()
            self.stems.update(zip(some, [raw[4 * a + 4:4 * b] for a, b in zip(edges[:-1], edges[1:])]))
            self.stems.update((w, self._tokenise(w).tobytes()) for w in some if "<|" in w)
        tails = {"": b"", **{c: self._tokenise(c).tobytes() for c in ".,"}}
        self._store(first, [self.stems[stem] + tails[tail] for stem, tail in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > CACHE_WORDS:
            self.reset()
        known, coded = len(self.codes), []
        for text in texts:
            words = text.split(" ") if any(c in text for c in _NO_SPACE) else text.split()
            coded.append(np.fromiter(map(self.codes.__getitem__, words), dtype=np.int64, count=len(words)))
        if len(self.codes) > known:
            self._learn(known, list(islice(self.codes, known, None)))
        out = []
        for codes in coded:
            lengths = self.count[codes]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.begin[codes] - (ends - lengths), lengths)
            out.append(self.flat[np.arange(len(shift)) + shift])
        return out


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class OpenWindows:
    """A fixed number of open windows, kept in order of their room."""

    def __init__(self, size: int, spaces: int, first_id: int):
        self.size, self.spaces, self.next_id = size, spaces, first_id
        self.rooms: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece (doc_id, start, length, ...) into a window; the pieces of a window that closed."""
        length, closed = piece[2], None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.spaces:
                closed = self.pieces.pop(self.rooms.pop(0)[1])
            room, window = self.size, self.next_id
            self.next_id += 1
            self.pieces[window] = []
        self.pieces[window].append((*piece[:5], window, self.size - room))
        if room == length:
            full = self.pieces.pop(window)
            return full if closed is None else closed + full
        insort(self.rooms, (room - length, window))
        return closed

    def rest(self) -> list[tuple]:
        return [p for pieces in self.pieces.values() for p in pieces]


def _rows(done: list[tuple], open_: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, *open_)) if done or open_ else [[]] * len(_PIECE)
    arrays = [pa.array(c, type=pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([False] * len(done) + [True] * len(open_))], schema=_OPEN)


def _first_id(level: int) -> int:
    from pyspark import TaskContext

    return (level << 58) + (TaskContext.get().partitionId() << 30)


def _tokenise(path: str, size: int, spaces: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = word_ids(path), OpenWindows(size, spaces, _first_id(0))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                # As many rows as hold about a block of text.
                part, used = [], 0
                while at + len(part) < len(ids) and (not part or used < common.BLOCK_BYTES):
                    part.append(texts[at + len(part)].as_py() or "")
                    used += len(part[-1])
                done: list[tuple] = []
                for doc, tokens in zip(ids[at:at + len(part)], encoder.encode(part)):
                    total = len(tokens) + 1
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for start in range(0, total, size):
                        piece = tokens[start:start + size]
                        row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), total)
                        if len(piece) == size:
                            done.append((*row, windows.next_id, 0))
                            windows.next_id += 1
                        else:
                            done += windows.place(row) or []
                at += len(part)
                if done:
                    yield _rows(done, [])
        yield _rows([], windows.rest())

    return run


def _merge(size: int, spaces: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, done = OpenWindows(size, spaces, _first_id(level)), []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(_PIECE)))):
                done += windows.place(row[:5]) or []
            if done:
                yield _rows(done, [])
                done = []
        yield _rows(done, windows.rest())

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, spaces: int = 64, end_id: int = 2,
         fan_in: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `spaces` windows are open in a partition at a time; what is left open by `fan_in` partitions is packed
    by one task of the next round.
    """
    schema = f"{PIECE}, open boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = durable(rows.mapInArrow(_tokenise(tokenizer_path, size, spaces, end_id), schema))
    done, left, parts, level = packed.filter("not open"), packed.filter("open"), packed.rdd.getNumPartitions(), 0
    while parts > 1:
        parts, level = -(-parts // fan_in), level + 1
        dealt = left.drop("open").repartition(parts, F.xxhash64("sequence_id"))
        dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32"), "sequence_id", "offset")
        again = durable(dealt.mapInArrow(_merge(size, spaces, level), schema))
        done, left = done.unionByName(again.filter("not open")), again.filter("open")
    return done.unionByName(left).drop("open")
