"""Secret scans: a linear-chain conditional random field over the tokens of a text, and three base patterns.

Tokens are runs of value characters (letters, digits, `+/_.-`, anything beyond ASCII) and single other signs.
The field tags each as begin, inside or outside of a secret. Its features are the token's shape (which kinds of
characters, length, changes between letters and digits), the token itself and its two neighbours on either side as
hash buckets, and two of the file: its share of digits and its length. It is trained in numpy by gradient ascent
on the log-likelihood, on a bounded sample of at most `SAMPLE_ROWS` documents whose base matches are the labels;
half of the training runs hide the words and half get their value redrawn over another alphabet, so that shapes
count beyond the three base forms.

Decoding is exact Viterbi over every token of every whole text. A token is outside in every best path when its
margin exceeds what any change of its tag can gain in transitions; such tokens cut a text into short chains,
which are decoded side by side.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; spans of the
field that touch a base span are dropped, base spans always stay; repeated rows are answered once each; an empty
table gives no rows (a field without examples adds no spans); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns. Letters of a keyword count in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "field")

#: Bounds of the sample that the field is trained on: documents, and tokens on either side of a match.
SAMPLE_ROWS = 800
AROUND = 30

BUCKETS = 4096
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 value character, 2 other sign
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 0
_CLASS[[*b"+/_.-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[0x80:] = 1
# Kinds of characters as counters in the bytes of one number: lower, upper, digit, sign, beyond ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(97, 123)]], _KIND[[*range(65, 91)]], _KIND[[*range(48, 58)]] = 1, 2, 4
_KIND[[*b"+/_.-"]] = 8
_KIND[0x80:] = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a block of bytes; `cuts` are the starts of its texts."""
    kind = np.empty(len(data) + 2, dtype=np.uint8)
    kind[0] = kind[-1] = 0
    kind[1:-1] = _CLASS[data]
    value = kind == 1
    new = ~value[:-1]
    new[cuts[cuts < len(data)]] = True
    sign = kind[1:-1] == 2
    starts = np.flatnonzero((value[1:-1] & new[:-1]) | sign)
    ends = np.flatnonzero((value[1:-1] & (~value[2:] | new[1:])) | sign) + 1
    return starts, ends


#: Feature tables and their sizes.
TABLES = {"shape": 2048, "length": 16, "changes": 8, "digits": 8, "word": BUCKETS, "before": BUCKETS, "before2": BUCKETS,
          "after": BUCKETS, "after2": BUCKETS, "file_digits": 8, "file_length": 8}
WORDS = ("word", "before", "before2", "after", "after2")


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n_texts: int) -> dict[str, np.ndarray]:
    """A bucket of each table for each token; bucket 0 of the word tables is "no such token"."""
    kind = _KIND[data]
    present = np.bitwise_or.reduceat(kind, np.column_stack([starts, ends]).ravel())[::2] if len(starts) else kind[:0]
    digit = kind == 4
    sums = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(digit, out=sums[1:])
    turns = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(digit[1:] != digit[:-1], out=turns[2:])
    length = ends - starts
    digits = sums[ends] - sums[starts]
    changes = turns[ends] - turns[np.minimum(starts + 1, len(data))]
    hashed = (common.mix(common.RollingHash(data).slices(starts, ends)) >> np.uint64(52)).astype(np.int16)
    hashed = np.maximum(hashed, 1)
    texts = np.bincount(owner, weights=length, minlength=n_texts)
    shares = np.bincount(owner, weights=digits, minlength=n_texts) / np.maximum(texts, 1)
    near = {}
    for name, shift in (("before", 1), ("before2", 2), ("after", -1), ("after2", -2)):
        moved = np.zeros_like(hashed)
        if shift > 0:
            moved[shift:] = np.where(owner[shift:] == owner[:-shift], hashed[:-shift], 0)
        else:
            moved[:shift] = np.where(owner[:shift] == owner[-shift:], hashed[-shift:], 0)
        near[name] = moved
    bits = np.log2(length.astype(np.float32)) * 2
    digits = np.minimum(8 * digits // np.maximum(length, 1), 7)
    shape = (present.astype(np.int16) * 8 + digits.astype(np.int16)) * 8 + np.minimum(bits / 2, 7).astype(np.int16)
    return {"shape": shape, "length": np.minimum(bits, 15).astype(np.uint8),
            "changes": np.minimum(changes, 7).astype(np.uint8), "digits": digits.astype(np.uint8), "word": hashed, **near,
            "file_digits": np.minimum(shares * 200, 7).astype(np.uint8)[owner],
            "file_length": np.minimum(np.log2(texts + 1) / 2, 7).astype(np.uint8)[owner]}


class Field:
    """Weights of the feature tables (buckets x 3) and transitions (3 x 3)."""

    def __init__(self):
        self.weights = {name: np.zeros((size, 3), dtype=np.float32) for name, size in TABLES.items()}
        self.moves = np.zeros((3, 3), dtype=np.float32)

    def scores(self, buckets: dict[str, np.ndarray]) -> np.ndarray:
        total = None
        for name in TABLES:
            part = np.take(self.weights[name], buckets[name], axis=0)
            total = part if total is None else np.add(total, part, out=total)
        return total

    def fit(self, chains: list[dict[str, np.ndarray]], tags: list[np.ndarray], rounds: int = 40, rate: float = 0.2,
            decay: float = 1e-3) -> None:
        """Adam on the mean log-likelihood of whole chains, padded to one length and taken all at once."""
        t_max, n = max(map(len, tags)), len(tags)
        lengths = np.array([len(t) for t in tags])
        gold = np.full((t_max, n), OUTSIDE)
        buckets = {name: np.zeros((t_max, n), dtype=np.int64) for name in TABLES}
        for i, (chain, tag) in enumerate(zip(chains, tags)):
            gold[:len(tag), i] = tag
            for name in TABLES:
                buckets[name][:len(tag), i] = chain[name]
        inside = np.arange(t_max)[:, None] < lengths[None, :]
        columns = np.arange(n)
        values = {**self.weights, "moves": self.moves}
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in values.items()}
        for count in range(1, rounds + 1):
            score = self.scores(buckets)
            score[~inside] = 0
            alpha = np.zeros((t_max, n, 3), dtype=np.float32)
            beta = np.zeros((t_max, n, 3), dtype=np.float32)
            alpha[0] = score[0]
            for t in range(1, t_max):
                step = alpha[t - 1][:, :, None] + self.moves
                top = step.max(axis=1)
                nxt = top + np.log(np.exp(step - top[:, None, :]).sum(axis=1)) + score[t]
                alpha[t] = np.where(inside[t][:, None], nxt, alpha[t - 1])
            for t in range(t_max - 2, -1, -1):
                step = self.moves + (score[t + 1] + beta[t + 1])[:, None, :]
                top = step.max(axis=2)
                nxt = top + np.log(np.exp(step - top[:, :, None]).sum(axis=2))
                beta[t] = np.where(inside[t + 1][:, None], nxt, 0)
            top = alpha[-1].max(axis=1)
            total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
            delta = np.exp(alpha + beta - total[None, :, None])
            delta[np.arange(t_max)[:, None], columns[None, :], gold] -= 1
            delta[~inside] = 0
            grad_moves = np.zeros((3, 3))
            for t in range(1, t_max):
                on = inside[t]
                pair = alpha[t - 1][on][:, :, None] + self.moves + (score[t] + beta[t])[on][:, None, :] - total[on][:, None, None]
                grad_moves += np.exp(pair).sum(axis=0)
                np.add.at(grad_moves, (gold[t - 1][on], gold[t][on]), -1)
            grads = {"moves": grad_moves / n}
            flat = delta.reshape(-1, 3)
            for name, size in TABLES.items():
                of = buckets[name].ravel()
                grads[name] = np.column_stack([np.bincount(of, weights=flat[:, k], minlength=size) for k in range(3)]) / n
            for name, g in grads.items():
                w = values[name]
                g = g + decay * w
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9 ** count)) / (np.sqrt(v / (1 - 0.99 ** count)) + 1e-6)).astype(np.float32)

    def gains(self) -> np.ndarray:
        """For begin and inside, the most that a token can gain in transitions over being outside."""
        t = self.moves
        into = np.maximum((t - t[:, [OUTSIDE]]).max(axis=0), 0)
        out = np.maximum((t - t[[OUTSIDE], :]).max(axis=1), 0)
        return (into + out)[:2]

    def decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of all tokens; `first` marks the first token of each text."""
        tags = np.full(len(score), OUTSIDE, dtype=np.int8)
        sure = (score[:, OUTSIDE, None] - score[:, :2] > self.gains()).all(axis=1)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        head = np.concatenate([[True], (np.diff(open_) > 1) | first[open_[1:]]])
        starts = open_[head]
        lengths = np.diff(np.append(np.flatnonzero(head), len(open_)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        # A chain begins and ends beside an outside token, or at the border of a text.
        last = starts + lengths
        behind = (last < len(score)) & ~first[np.minimum(last, len(score) - 1)]
        best = score[starts] + np.where(first[starts][:, None], 0, self.moves[OUTSIDE])
        back = []
        for t in range(1, int(lengths[0])):
            n = int((lengths > t).sum())
            step = best[:n, :, None] + self.moves
            back.append(step.argmax(axis=1).astype(np.int8))
            best[:n] = step.max(axis=1) + score[starts[:n] + t]
        tag = (best + np.where(behind[:, None], self.moves[:, OUTSIDE], 0)).argmax(axis=1).astype(np.int8)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int((lengths > t).sum())
            tags[starts[:n] + t] = tag[:n]
            if t:
                tag[:n] = back[t - 1][np.arange(n), tag[:n]]
        return tags


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of texts, token starts, token ends, text of each token)"""
    # White space behind the last text, so that every token ends inside the block.
    data = np.frombuffer(b"".join([*texts, b"\n"]), dtype=np.uint8)
    cuts = np.cumsum([0] + [len(t) for t in texts])
    starts, ends = tokens(data, cuts[:-1])
    return data, cuts, starts, ends, np.searchsorted(cuts, starts, "right") - 1


def field_spans(field: Field, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """Byte spans that the field tags, by text."""
    data, cuts, starts, ends, owner = _block(texts)
    if not len(starts):
        return {}
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    tags = field.decode(field.scores(features(data, starts, ends, owner, len(texts))), first)
    out: dict[int, list[tuple[int, int]]] = {}
    for at in np.flatnonzero(tags != OUTSIDE).tolist():
        text, begin, end = int(owner[at]), int(starts[at] - cuts[owner[at]]), int(ends[at] - cuts[owner[at]])
        own = out.setdefault(text, [])
        if tags[at] == INSIDE and own and not first[at] and tags[at - 1] != OUTSIDE:
            own[-1] = (own[-1][0], end)
        else:
            own.append((begin, end))
    return out


# --- training ---

_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _chains(text: str, rng: np.random.Generator, redraw: bool, hide: bool) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Training chains of a text: the tokens around its base matches, or a part of it if it has none."""
    spans = []
    for start, _, end in base_spans(text):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    if redraw:
        shifted, out, at = [], [], 0
        for start, end in spans:
            # The value is the last run of value characters in the match.
            value = re.search(r"[A-Za-z0-9+/_.=-]+$", text[start:end])
            begin = start + (value.start() if value else 0)
            letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
            new = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(16, 48)))
            out += [text[at:begin], new]
            length = sum(map(len, out))
            shifted.append([length - len(new) - (begin - start), length])
            at = end
        text, spans = "".join([*out, text[at:]]), shifted
    data, _, starts, ends, owner = _block([text.encode()])
    if not len(starts):
        return
    chars = np.cumsum((data & 0xC0) != 0x80)
    place = chars[starts] - 1
    tags = np.full(len(starts), OUTSIDE)
    for start, end in spans:
        of = np.flatnonzero((place >= start) & (place < end))
        tags[of] = INSIDE
        tags[of[:1]] = BEGIN
    found = features(data, starts, ends, owner, 1)
    if hide:
        found |= {name: np.zeros_like(found[name]) for name in WORDS}
    begins = np.flatnonzero(tags == BEGIN)[:4].tolist() or rng.integers(0, len(starts), 3).tolist()
    for at in begins:
        part = slice(max(0, at - AROUND), at + AROUND)
        yield {name: values[part] for name, values in found.items()}, tags[part]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Excerpts of at most `rows` documents, smallest hashes first: half around a base match, half without one."""
    body = docs.select("text", F.xxhash64("doc_id", F.lit(5)).alias("h")).filter(F.col("text").isNotNull())
    pattern = rf"(?:(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{{{LEAST_VALUE},}}|AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}|[0-9a-f]{{16,}})"
    # Around the first match, and from a place of the text that its hash picks.
    at = F.regexp_instr("text", F.lit(pattern))
    spot = F.when(at > 0, at).otherwise(F.pmod("h", F.greatest(F.lit(1), F.length("text"))).cast("int") + 1)
    cut = F.substring("text", F.greatest(F.lit(1), spot - 400), F.lit(1200))
    picked = body.select(cut.alias("text"), "h", (at > 0).alias("hit"))
    half = [picked.filter(F.col("hit") == hit).orderBy("h", "text").limit(rows // 2).select("text") for hit in (True, False)]
    return sorted(r.text for r in half[0].unionAll(half[1]).collect())


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    rng = np.random.default_rng(0)
    chains = []
    for text in sample(docs, rows):
        ways = [(a, b) for a in (False, True) for b in (False, True)] if base_spans(text) else [(False, False)]
        chains += [pair for redraw, hide in ways for pair in _chains(text, rng, redraw, hide)]
    field = Field()
    if any((tags != OUTSIDE).any() for _, tags in chains):
        field.fit([c for c, _ in chains], [t for _, t in chains])
    else:
        field.weights["shape"][:, OUTSIDE] = 1
    return field


# --- scans ---


def spans_of(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, by start, then kind."""
    found = [base_spans(t) for t in texts]
    encoded = [t.encode() for t in texts]
    for first, held in common.blocks(encoded):
        for row, own in field_spans(field, held).items():
            data = np.frombuffer(held[row], dtype=np.uint8)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = found[first + row]
            begins = np.array([s for s, _, _ in base])
            reach = np.maximum.accumulate(np.array([e for _, _, e in base])) if base else begins
            new = []
            for begin, end in own:
                start, stop = int(chars[begin]), int(chars[end])
                at = int(np.searchsorted(begins, stop, "left"))
                if not at or reach[at - 1] <= start:
                    new.append((start, 3, stop))
            found[first + row] = sorted(base + new)
    return found


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and the spans (start, kind, end) of every row; `KINDS` names the kinds."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [[dict(zip(("start", "kind", "end"), s)) for s in own] for own in spans_of(field, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=schema.field("spans").type)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,end:int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind < 3)
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(show(base).cast("binary"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs`, all columns, with every span of their texts replaced by `mark`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, own in enumerate(spans_of(field, [t or "" for t in texts])):
                if own:
                    parts, at = [], 0
                    for start, _, end in own:
                        if start >= at:
                            parts += [texts[i][at:start], mark]
                        at = max(at, end)
                    texts[i] = "".join([*parts, texts[i][at:]])
            where = batch.schema.get_field_index("text")
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, type=batch.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)
