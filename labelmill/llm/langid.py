"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read as windows of `WINDOW` bytes. Two gated recurrent units run over a window, one from either end;
at every position their states give a distribution over the languages, and the distributions of all positions
of all windows of a document are averaged into its probabilities. The network is written in numpy and trained
by backpropagation through time (Adam) on a bounded sample of labelled rows: at most `ROWS_PER_LANGUAGE` rows of
a language, chosen by a hash of their id, and of each at most `WINDOWS_PER_ROW` windows spread over the whole
text. Everything else sees whole texts: every window of every document is read.

Windows of many documents run side by side, so a step is one matrix product whatever the lengths of the
texts, and memory is bounded by the windows of a step, not by a text.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language first in
alphabetical order; rows without a language are not learned from; with no row to learn from all rows are `und`;
repeated rows are answered once each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.session import small_table

from . import common

WINDOW = 64
HIDDEN = 8
#: Bounds of the sample that the network is fitted on.
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_ROW = 8
EPOCHS = 6
#: Windows that run side by side.
SIDE_BY_SIDE = 2048
UNKNOWN = "und"

PREDICTION = "doc_id long, lang_pred string, score double"
_PREDICTION = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


class Network:
    """Weights of both directions: input tables (3H x 257), recurrent matrices (3H x H), output (C x 2H).

    Gates in the order update, reset, candidate. Input 256 stands for what is behind the end of a text.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {"out": rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32),
                        "out_bias": np.zeros((classes, 1), dtype=np.float32)}
        for way in ("forward", "backward"):
            self.weights[f"{way}_in"] = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
            self.weights[f"{way}_state"] = rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(np.float32)
            self.weights[f"{way}_bias"] = np.zeros((hidden, 1), dtype=np.float32)

    def _states(self, steps: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """Hidden states (T, H, N) for input codes (T, N), in the order of the text."""
        h_size, (t_max, n) = self.hidden, steps.shape
        table, state = self.weights[f"{way}_in"], self.weights[f"{way}_state"]
        bias = self.weights[f"{way}_bias"]
        half = np.repeat(np.array([0.5, 0.5, 1.0], dtype=np.float32), h_size)[:, None]
        # The gates' sigmoid as a tanh of half the input: the halves are taken once, in the weights.
        table, state = np.ascontiguousarray((table * half).T), state * half
        out = np.empty((t_max, h_size, n), dtype=np.float32)
        h = np.zeros((h_size, n), dtype=np.float32)
        order = range(t_max) if way == "forward" else range(t_max - 1, -1, -1)
        for t in order:
            x = np.ascontiguousarray(table[steps[t]].T)
            s = state @ h
            gates = np.tanh(x[:2 * h_size] + s[:2 * h_size])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h_size], gates[h_size:]
            inner = s[2 * h_size:] + bias
            c = np.tanh(x[2 * h_size:] + r * inner)
            if trace is not None:
                trace.append((t, h, z, r, inner, c))
            h = c + z * (h - c)
            out[t] = h
        return out

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, N) of the languages at every position."""
        states = np.concatenate([self._states(steps, "forward"), self._states(steps, "backward")], axis=1)
        logits = self.weights["out"] @ states + self.weights["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions within texts, and its gradients, through time."""
        h_size = self.hidden
        traces = {"forward": [], "backward": []}
        states = np.concatenate([self._states(steps, way, traces[way]) for way in ("forward", "backward")], axis=1)
        logits = self.weights["out"] @ states + self.weights["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(axis=1, keepdims=True)
        inside = (steps < 256).astype(np.float32) / max(1, int((steps < 256).sum()))
        columns = np.arange(steps.shape[1])
        loss = float(-(np.log(probs[:, labels, columns] + 1e-12) * inside).sum())
        delta = probs
        delta[:, labels, columns] -= 1
        delta *= inside[:, None, :]
        grads = {"out": np.einsum("tcn,thn->ch", delta, states), "out_bias": delta.sum(axis=(0, 2))[:, None]}
        back = np.einsum("ch,tcn->thn", self.weights["out"], delta)
        for way, rows in (("forward", slice(0, h_size)), ("backward", slice(h_size, 2 * h_size))):
            state = self.weights[f"{way}_state"]
            d_state, d_bias = np.zeros_like(state), np.zeros((h_size, 1), dtype=np.float32)
            d_in = np.zeros((257, 3 * h_size), dtype=np.float32)
            dh = np.zeros((h_size, steps.shape[1]), dtype=np.float32)
            for t, h, z, r, inner, c in reversed(traces[way]):
                dh = dh + back[t, rows]
                d_c = dh * (1 - z) * (1 - c * c)
                d_z = dh * (h - c) * z * (1 - z)
                d_r = d_c * inner * r * (1 - r)
                d_inner = d_c * r
                into = np.concatenate([d_z, d_r, d_c])
                np.add.at(d_in, steps[t], into.T)
                through = np.concatenate([d_z, d_r, d_inner])
                d_state += through @ h.T
                d_bias += d_inner.sum(axis=1, keepdims=True)
                dh = dh * z + state.T @ through
            grads |= {f"{way}_in": d_in.T, f"{way}_state": d_state, f"{way}_bias": d_bias}
        return loss, grads

    def fit(self, steps: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 256) -> float:
        """Adam over shuffled batches, every language with the same weight; the last epoch's mean loss."""
        rng = np.random.default_rng(1)
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        count, share = 0, 1 / np.bincount(labels)[labels]
        for epoch in range(epochs):
            order = rng.choice(len(labels), len(labels), p=share / share.sum())
            losses = []
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                loss, grads = self.gradients(steps[:, pick], labels[pick])
                losses.append(loss)
                count += 1
                step = rate * (0.5 ** (epoch / 2)) * (1 - 0.999 ** count) ** 0.5 / (1 - 0.9 ** count)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= (step * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return float(np.mean(losses))


def window_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (T, N) of the windows of all texts, and the text of each window."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    codes = np.full(int(count.sum()) * WINDOW, 256, dtype=np.int16)
    base = (np.cumsum(count) - count) * WINDOW
    for at, text in zip(base.tolist(), texts):
        codes[at:at + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return codes.reshape(-1, WINDOW).T, owner


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions of each text."""
    total = np.zeros((len(texts), len(network.weights["out"])))
    sizes = np.array([max(1, len(t)) for t in texts])

    def add(codes: np.ndarray, owner: np.ndarray) -> None:
        for at in range(0, codes.shape[1], SIDE_BY_SIDE):
            part = np.ascontiguousarray(codes[:, at:at + SIDE_BY_SIDE])
            probs = network.positions(part)
            ends = (part >= 256).any(axis=0)
            sums = probs.sum(axis=0)
            if ends.any():
                sums[:, ends] = (probs[:, :, ends] * (part[:, ends] < 256)[:, None, :]).sum(axis=0)
            np.add.at(total, owner[at:at + SIDE_BY_SIDE], sums.T)

    # A text of many windows is cut between windows; the sums do not depend on the cuts.
    limit = WINDOW * SIDE_BY_SIDE
    pieces = [(row, text[at:at + limit]) for row, text in enumerate(texts) for at in range(0, len(text), limit)]
    for first, held in common.blocks([piece for _, piece in pieces], limit):
        codes, owner = window_codes(held)
        add(codes, np.array([row for row, _ in pieces[first:first + len(held)]])[owner])
    return total / sizes[:, None]


def training_windows(docs: DataFrame) -> DataFrame:
    """(lang, window) of the sample: the rows with the smallest hash of each language, windows evenly spread."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    keyed = known.select("lang", F.xxhash64("doc_id", F.lit(11)).alias("h"), F.col("text").cast("binary").alias("body"))
    # A hash bound that passes about three times the rows wanted keeps texts from being ranked in full. One row per
    # language, of which the fit holds up to ROWS_PER_LANGUAGE texts' windows anyway.
    counts = known.groupBy("lang").count().collect()
    bounds = small_table(docs.sparkSession, [(r["lang"], min(1.0, 3.0 * ROWS_PER_LANGUAGE / r["count"])) for r in counts],
                         "lang string, bound double")
    low = keyed.join(F.broadcast(bounds), "lang").filter(F.pmod("h", F.lit(1 << 40)) < F.col("bound") * float(1 << 40))
    size = F.octet_length("body")
    step = F.greatest(F.lit(1), F.floor(size / (WINDOW * WINDOWS_PER_ROW))) * WINDOW
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_ROW - 1)), lambda i: i * step)
    cut = F.transform(F.filter(cut, lambda at: at < size), lambda at: F.substring("body", (at + 1).cast("int"), F.lit(WINDOW)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "windows"))
    ranked = low.select("lang", "h", cut.alias("windows")).withColumn("rank", rank).filter(F.col("rank") <= ROWS_PER_LANGUAGE)
    return ranked.select("lang", F.explode("windows").alias("window"))


def fit(docs: DataFrame) -> tuple[list[str], Network | None]:
    """Languages, in alphabetical order, and the network fitted on the sample of labelled rows."""
    rows = sorted((r.lang, bytes(r.window)) for r in training_windows(docs).collect())
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return [], None
    codes, _ = window_codes([window for _, window in rows])
    network = Network(len(languages))
    network.fit(codes, np.array([languages.index(lang) for lang, _ in rows]))
    return languages, network


def _answers(languages: list[str], network: Network | None, texts: list[str | None], lettered: list[bool]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, known in enumerate(lettered) if known and network is not None]
    for at in range(0, len(rows), 2000):
        part = rows[at:at + 2000]
        probs = pooled(network, [texts[i].encode() for i in part])
        for i, best, p in zip(part, probs.argmax(axis=1).tolist(), probs):
            names[i], scores[i] = languages[best], float(min(1.0, max(0.0, p[best])))
    return names, scores


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = _answers(languages, network, texts, [_has_letter(t) for t in texts])
            yield common.table({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}, _PREDICTION)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTION)


def with_language(docs: DataFrame, languages: list[str], network: Network | None, least: float | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that are in a learned language with at least the score `least`.

    Without `least` the bound lies a fifteenth of the way from chance (one over the number of learned languages) to
    certainty: it only takes out what no language fits better than chance. A text of one or two words is often told
    with a score of 0.4 to 0.5 among four languages, and stays.
    """
    if least is None:
        chance = 1.0 / max(1, len(languages))
        least = chance + (1.0 - chance) / 15 - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.single_threaded()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = _answers(languages, network, texts, [_has_letter(t) for t in texts])
            good = [name != UNKNOWN and score >= least for name, score in zip(names, scores)]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
