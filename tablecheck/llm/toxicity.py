"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (if the sample has it in several texts) plus the mean of its hashed
character n-gram vectors. The network reads windows of ``WINDOW`` words that overlap (every ``STRIDE`` words), attention pools the
states of a window to one logit, and the document's score comes from its strongest window, so all of
a long text counts. Labels are per document: training looks for the window that carries the label
(at first by word evidence, later by the network's own logits).

The network is fitted on the driver on a bounded sample of labelled rows (``PER_CLASS`` texts per
label, each of at most ``MAX_CHARS`` characters) and shipped to the tasks; its size is fixed.

Defined cases: null and empty text is one empty window. Without labelled rows of both kinds the
score is the smoothed share of label 1. Rows are scored one by one, so repeated rows, ties, null ids
and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import released, small_batches
from tablecheck.llm.subwords import (
    character_grams,
    labelled_sample,
    prior_shift,
    remainder,
)

WINDOW, STRIDE = 24, 8  # a run of up to WINDOW - STRIDE + 1 words is whole in some window
BUCKETS = 1 << 16
GRAMS = range(3, 6)
DIMENSIONS, HIDDEN = 12, 8
PER_CLASS = 900
MAX_CHARS = 4000
EPOCHS = 7
OWN_VECTOR = 4  # texts of the sample that hold a word with a vector of its own
BATCH = 64
RATE = 0.06
CACHED_WORDS = 150_000
BLOCK = 2048  # windows scored at once
WORDS_AT_ONCE = 4096  # of the sample, when all its windows are scored
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows_of(count: int) -> list[int]:
    """First words of the windows of a text of so many words; the last one ends with the text."""
    if count <= WINDOW:
        return [0]
    starts = list(range(0, count - WINDOW, STRIDE))
    return starts + [count - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights; direction 0 reads forwards, direction 1 backwards."""

    def __init__(self, words: list[str] = (), seed: int = 5):
        self.own = {w: i + 1 for i, w in enumerate(words)}  # row 0: any other word
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, DIMENSIONS

        def draw(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.weights = {
            "words": np.zeros((len(words) + 1, d), np.float32),
            "grams": draw(BUCKETS, d, scale=0.2),
            "into0": draw(d, 3 * h, scale=0.4),
            "into1": draw(d, 3 * h, scale=0.4),
            "along0": draw(h, 3 * h, scale=0.3),
            "along1": draw(h, 3 * h, scale=0.3),
            "bias0": np.zeros(3 * h, np.float32),
            "bias1": np.zeros(3 * h, np.float32),
            "attend": draw(2 * h, scale=0.3),
            "out": draw(2 * h, scale=0.5),
            "base": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])  # from the strongest window to log odds
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.weights.items()}

    def vectors(self, ids, owners, counts, own) -> np.ndarray:
        w = self.weights
        total = np.zeros((len(counts), DIMENSIONS), np.float32)
        if len(ids):
            heads = np.flatnonzero(np.diff(owners, prepend=-1))
            total[owners[heads]] = np.add.reduceat(w["grams"][ids], heads, axis=0)
        return total / np.maximum(counts, 1)[:, None] + w["words"][own]

    def states(self, inputs: list[np.ndarray], mask: np.ndarray, keep: list | None = None):
        """States of both directions, time first. inputs: per direction (time, windows, 3 * hidden)."""
        h = HIDDEN
        steps, count = mask.shape
        both = np.zeros((steps, count, 2 * h), np.float32)
        for way in (0, 1):
            along, state = self.weights[f"along{way}"], np.zeros((count, h), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x = inputs[way][t]
                inner = state @ along
                gates = sigmoid(x[:, : 2 * h] + inner[:, : 2 * h])
                update, reset = gates[:, :h], gates[:, h:]
                fresh = np.tanh(x[:, 2 * h :] + reset * inner[:, 2 * h :])
                m = mask[t][:, None]
                after = state + m * (1 - update) * (fresh - state)
                if keep is not None:
                    keep.append((way, t, state, update, reset, fresh, inner[:, 2 * h :], m))
                both[t, :, way * h : (way + 1) * h] = after
                state = after
        return both

    def pooled(self, both: np.ndarray, mask: np.ndarray):
        """Attention weights, pooled states and logits of the windows."""
        strength = both @ self.weights["attend"] - 1e4 * (1 - mask)
        share = np.exp(strength - strength.max(axis=0))
        share *= mask
        share /= np.maximum(share.sum(axis=0), 1e-9)
        context = np.einsum("tb,tbh->bh", share, both)
        return share, context, context @ self.weights["out"] + self.weights["base"][0]

    def step(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, labels: np.ndarray):
        """Gradients of the mean log loss. at: (time, windows) rows of vectors."""
        w, h = self.weights, HIDDEN
        x = vectors[at]
        inputs = [x @ w[f"into{way}"] + w[f"bias{way}"] for way in (0, 1)]
        keep: list = []
        both = self.states(inputs, mask, keep)
        share, context, logits = self.pooled(both, mask)
        error = (sigmoid(logits) - labels).astype(np.float32) / len(labels)
        grads = {"out": context.T @ error, "base": error.sum(keepdims=True)}
        to_context = error[:, None] * w["out"]
        to_share = np.einsum("bh,tbh->tb", to_context, both)
        to_strength = share * (to_share - (share * to_share).sum(axis=0))
        grads["attend"] = np.einsum("tb,tbh->h", to_strength, both)
        to_both = share[:, :, None] * to_context + to_strength[:, :, None] * w["attend"]
        to_x = np.zeros_like(x)
        for way in (0, 1):
            along = w[f"along{way}"]
            to_along, to_inputs = np.zeros_like(along), np.zeros_like(inputs[way])
            back = np.zeros((x.shape[1], h), np.float32)
            for _, t, state, update, reset, fresh, inner, m in reversed(
                [k for k in keep if k[0] == way]
            ):
                now = back + to_both[t, :, way * h : (way + 1) * h]
                inside = m * now
                to_update = inside * (state - fresh) * update * (1 - update)
                to_fresh = inside * (1 - update) * (1 - fresh**2)
                to_reset = to_fresh * inner * reset * (1 - reset)
                gate = np.concatenate([to_update, to_reset, to_fresh * reset], axis=1)
                to_along += state.T @ gate
                to_inputs[t] = np.concatenate([to_update, to_reset, to_fresh], axis=1)
                back = now * (1 - m) + inside * update + gate @ along.T
            grads[f"along{way}"] = to_along
            grads[f"bias{way}"] = to_inputs.sum(axis=(0, 1))
            flat = to_inputs.reshape(-1, 3 * h)
            grads[f"into{way}"] = x.reshape(-1, DIMENSIONS).T @ flat
            to_x += to_inputs @ w[f"into{way}"].T
        return grads, to_x

    def move(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None):
        """One adaptive step, on some rows only if they are given (each once)."""
        where = slice(None) if rows is None else rows
        self.squares[name][where] += grad**2
        self.weights[name][where] -= RATE * grad / np.sqrt(self.squares[name][where])


class _Sample:
    """Words of the labelled sample, coded."""

    def __init__(self, rows: list[tuple[str, int]]):
        split = [words_of(t) for t, _ in rows]
        self.labels = np.array([y for _, y in rows])
        words = sorted({w for s in split for w in s})
        number = {w: i for i, w in enumerate(words)}
        self.coded = [np.array([number[w] for w in s], np.int64) for s in split]
        ids, owners = character_grams(words, GRAMS, BUCKETS)
        order = np.argsort(owners, kind="stable")
        self.ids, self.owners = ids[order], owners[order]
        self.counts = np.bincount(owners, minlength=len(words))
        self.ends = np.concatenate([[0], np.cumsum(self.counts)])
        texts = np.bincount(np.concatenate([np.unique(s) for s in self.coded]), minlength=len(words))
        self.frequent = [w for w, n in zip(words, texts) if n >= OWN_VECTOR]
        self.own = np.where(texts >= OWN_VECTOR, np.cumsum(texts >= OWN_VECTOR), 0)
        self.texts, starts = [], []
        for i, s in enumerate(self.coded):
            for start in windows_of(len(s)):
                self.texts.append(i)
                starts.append(start)
        self.texts = np.array(self.texts)
        self.at = np.zeros((len(starts), WINDOW), np.int64)
        self.mask = np.zeros((len(starts), WINDOW), np.float32)
        for row, (i, start) in enumerate(zip(self.texts, starts)):
            piece = self.coded[i][start : start + WINDOW]
            self.at[row, : len(piece)] = piece
            self.mask[row, : len(piece)] = 1
        self.evidence = self._evidence(words)

    def _evidence(self, words: list[str]) -> np.ndarray:
        """Log odds of the strongest word or character n-gram of each window."""
        toxic, clean = Counter(), Counter()
        grams: list[Counter] = [Counter(), Counter()]
        for s, y in zip(self.coded, self.labels):
            some = np.unique(s)
            (toxic if y else clean).update(some.tolist())
            found = [self.ids[self.ends[i] : self.ends[i + 1]] for i in some]
            if found:
                grams[y].update(np.unique(np.concatenate(found)).tolist())
        word = np.zeros(len(words))
        for i in range(len(words)):
            word[i] = np.log((toxic[i] + 0.5) / (clean[i] + 2))
        gram = np.zeros(BUCKETS)
        for b in set(grams[0]) | set(grams[1]):
            gram[b] = np.log((grams[1][b] + 0.5) / (grams[0][b] + 2))
        best = word.copy()
        np.maximum.at(best, self.owners, gram[self.ids])
        return (best[self.at] * self.mask).max(axis=1)

    def strongest(self, strength: np.ndarray) -> np.ndarray:
        """The window with the greatest strength of each text."""
        order = np.lexsort((-strength, self.texts))
        return order[np.flatnonzero(np.diff(self.texts[order], prepend=-1))]

    def vectors(self, network: Network, words: np.ndarray) -> tuple:
        counts = self.counts[words]
        ids = np.concatenate([self.ids[self.ends[i] : self.ends[i + 1]] for i in words])
        owners = np.repeat(np.arange(len(words)), counts)
        return network.vectors(ids, owners, counts, self.own[words]), ids, owners, counts


def train(rows: list[tuple[str, int]], counts: tuple[int, int]) -> Network:
    if len({y for _, y in rows}) < 2:
        network = Network()
        network.scale = np.array([0.0, np.log((counts[1] + 1) / (counts[0] + 1))])
        return network
    rng = np.random.default_rng(3)
    sample = _Sample(rows)
    network = Network(sample.frequent)
    every = np.arange(len(sample.own))
    strength = sample.evidence
    clean = np.flatnonzero(sample.labels[sample.texts] == 0)
    for epoch in range(EPOCHS):
        best = sample.strongest(strength)
        toxic = best[sample.labels[sample.texts[best]] == 1]
        hard = best[sample.labels[sample.texts[best]] == 0]
        picked = np.concatenate([toxic, hard, rng.choice(clean, 2 * len(toxic))])
        rng.shuffle(picked)
        for start in range(0, len(picked), BATCH):
            _descend(network, sample, picked[start : start + BATCH])
        if epoch in (1, 3, EPOCHS - 1):
            # in parts, as the vectors of all n-grams of all words would fill the driver's memory
            parts = (every[k : k + WORDS_AT_ONCE] for k in range(0, len(every), WORDS_AT_ONCE))
            vectors = np.concatenate([sample.vectors(network, some)[0] for some in parts])
            tables = [vectors @ network.weights[f"into{w}"] + network.weights[f"bias{w}"] for w in (0, 1)]
            strength = logits(network, tables, sample.at, sample.mask)
    best = sample.strongest(strength)
    network.scale = _platt(strength[best], sample.labels[sample.texts[best]])
    network.scale[1] += prior_shift(rows, counts)
    network.squares = {}
    return network


def _descend(network: Network, sample: _Sample, windows: np.ndarray):
    words, at = np.unique(sample.at[windows], return_inverse=True)
    at = at.reshape(len(windows), WINDOW).T
    vectors, ids, owners, counts = sample.vectors(network, words)
    mask = np.ascontiguousarray(sample.mask[windows].T)
    labels = sample.labels[sample.texts[windows]]
    grads, to_x = network.step(vectors, at, mask, labels)
    for name, grad in grads.items():
        network.move(name, grad)
    to_words = _added(to_x.reshape(-1, DIMENSIONS), at.ravel(), len(words))
    own = sample.own[words]
    for name, rows, grad in (
        ("words", own[own > 0], to_words[own > 0]),
        ("grams", ids, (to_words / np.maximum(counts, 1)[:, None])[owners]),
    ):
        seen, place = np.unique(rows, return_inverse=True)
        network.move(name, _added(grad, place, len(seen)), seen)


def _added(rows: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows that go to each place."""
    sums = [np.bincount(place, rows[:, k], count) for k in range(rows.shape[1])]
    return np.stack(sums, axis=1).astype(np.float32)


def _platt(strength: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and intercept of a logistic fit by Newton steps with a small ridge."""
    spread = strength.std() + 1e-6
    x = np.stack([strength / spread, np.ones_like(strength)], axis=1).astype(np.float64)
    fit = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        fit -= np.linalg.solve(hessian, x.T @ (p - labels) + 0.5 * fit)
    return np.array([fit[0] / spread, fit[1]])


def logits(network: Network, tables: list[np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows (windows, time) of rows of the tables of projected words."""
    found = np.empty(len(at), np.float32)
    for start in range(0, len(at), BLOCK):
        some = np.ascontiguousarray(at[start : start + BLOCK].T)
        on = np.ascontiguousarray(mask[start : start + BLOCK].T)
        both = network.states([tables[0][some], tables[1][some]], on)
        found[start : start + BLOCK] = network.pooled(both, on)[2]
    return found


class Scorer:
    """Scores texts; keeps the projected vectors of words that it has met, up to a bound."""

    def __init__(self, network: Network):
        w = network.weights
        self.network = network
        self.into = np.concatenate([w["into0"], w["into1"]], axis=1)
        self.bias = np.concatenate([w["bias0"], w["bias1"]])
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}
        self.tables = [np.zeros((4096, 3 * HIDDEN), np.float32) for _ in (0, 1)]

    def learn(self, words: list[str]):
        first, last = len(self.number), len(self.number) + len(words)
        while last > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
        for start in range(0, len(words), 20_000):
            some = words[start : start + 20_000]
            ids, owners = character_grams(some, GRAMS, BUCKETS)
            order = np.argsort(owners, kind="stable")
            counts = np.bincount(owners, minlength=len(some))
            own = np.fromiter((self.network.own.get(w, 0) for w in some), np.int64, len(some))
            vectors = self.network.vectors(ids[order], owners[order], counts, own)
            projected = vectors @ self.into + self.bias
            place = slice(first + start, first + start + len(some))
            self.tables[0][place] = projected[:, : 3 * HIDDEN]
            self.tables[1][place] = projected[:, 3 * HIDDEN :]
        self.number.update(zip(words, range(first, last)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.number) > CACHED_WORDS:
            self.forget()
        new = {w for words in split for w in set(words)}
        self.learn([w for w in new if w not in self.number])
        lengths = np.array([len(s) for s in split])
        flat = np.fromiter(
            (n for s in split for n in map(self.number.__getitem__, s)), np.int32, lengths.sum()
        )
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = [windows_of(n) for n in lengths.tolist()]
        counts = np.array([len(s) for s in starts])
        first = np.repeat(begins, counts) + np.concatenate(starts).astype(np.int64)
        room = np.repeat(np.minimum(lengths, WINDOW), counts)
        steps = np.arange(WINDOW)
        mask = (steps < room[:, None]).astype(np.float32)
        places = np.where(mask > 0, first[:, None] + steps, 0)
        at = flat[places] if len(flat) else np.zeros(places.shape, np.int32)
        strength = logits(self.network, self.tables, at, mask)
        best = np.maximum.reduceat(strength, np.concatenate([[0], np.cumsum(counts)[:-1]]))
        slope, base = self.network.scale
        return 1 / (1 + np.exp(-np.clip(slope * best + base, -30, 30)))


def _slices(column: pa.Array, words: int = 100_000) -> Iterator[list[str | None]]:
    """Runs of texts with about so many words together."""
    some, size = [], 0
    for text in column:
        some.append(text.as_py())
        size += len(some[-1] or "") // 6
        if size > words:
            yield some
            some, size = [], 0
    if some:
        yield some


@released
def _score(batches: Iterator[pa.RecordBatch], network: Network, name: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(network)
    for batch in batches:
        found = [scorer.scores(some) for some in _slices(batch.column("text"))]
        scores = np.concatenate(found) if found else np.zeros(0)
        columns = [batch.column(c) for c in batch.schema.names if c != "text" or name == "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, name])


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    rows, counts = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, PER_CLASS, MAX_CHARS)
    return train(rows, counts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    network = fitted(docs, labels)
    return (
        small_batches(docs).select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(remainder(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
            "text",
        )
        .mapInArrow(
            lambda batches: _score(batches, network, "score"),
            "doc_id long, held_out boolean, score double",
        )
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


@released
def _clean(batches: Iterator[pa.RecordBatch], network: Network, threshold) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(network)
    for batch in batches:
        found = [scorer.scores(some) for some in _slices(batch.column("_row").field("text"))]
        scores = np.concatenate(found) if found else np.zeros(0)
        yield batch.filter(pa.array(scores < threshold, pa.bool_()))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    network = fitted(docs, labels)
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.mapInArrow(lambda batches: _clean(batches, network, threshold), rows.schema).select("_row.*")
