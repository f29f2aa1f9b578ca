"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

The vectors and the softmax layer are fitted on the driver on a bounded sample of labelled rows
(``PER_CLASS`` texts per label, each of at most ``MAX_CHARS`` characters). A score is the softmax of
the mean of all feature vectors of a whole text. As the mean is linear, a worker keeps one number
per word, so scoring is a sum over words in one pass over the documents.

Defined cases: null and empty text has no features and gets the score of the bias alone. Without
labelled rows of both kinds the score is the smoothed share of label 1. Rows are scored one by one,
so repeated rows, ties, null ids and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.subwords import (
    character_grams,
    labelled_sample,
    prior_shift,
    remainder,
    word_buckets,
)

BUCKETS = 1 << 16
DIMENSIONS = 10
GRAMS = range(2, 5)
PER_CLASS = 1200
MAX_CHARS = 5000
EPOCHS = 5
WORDS_PER_STEP = 64
CACHED_WORDS = 300_000
THRESHOLD = 0.7
MODULUS, HELD_OUT = 4, 2


class _Vocabulary:
    """Feature buckets of each word: its own, and those of its n-grams (shifted by BUCKETS)."""

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(words)}
        ids, owners = character_grams(words, GRAMS, BUCKETS)
        ids = np.concatenate([word_buckets(words, BUCKETS), BUCKETS + ids])
        owners = np.concatenate([np.arange(len(words)), owners])
        order = np.argsort(owners, kind="stable")
        self.ids = ids[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])

    def features(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([self.ids[self.ends[i] : self.ends[i + 1]] for i in numbers])


REPEATED = 2 * BUCKETS  # the feature of a word that equals the word before it


def train(rows: list[tuple[str, int]], counts: tuple[int, int]) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: log odds of label 1 are mean(numbers of features) + bias."""
    if len({y for _, y in rows}) < 2:
        return np.zeros(2 * BUCKETS + 1, np.float32), float(np.log((counts[1] + 1) / (counts[0] + 1)))
    rng = np.random.default_rng(11)
    split = [text.split() for text, _ in rows]
    vocabulary = _Vocabulary(sorted({w for words in split for w in words}))
    coded = [np.array([vocabulary.number[w] for w in words], np.int64) for words in split]
    labels = np.array([y for _, y in rows])
    vectors = rng.uniform(-1, 1, (2 * BUCKETS + 1, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = 0.5 * (1 - step / steps)
            step += 1
            words = coded[i]
            if not len(words):
                continue
            at = rng.integers(0, len(words), min(WORDS_PER_STEP, len(words)))
            ids = vocabulary.features(words[at])
            twice = int(((at > 0) & (words[at] == words[at - 1])).sum())
            ids = np.concatenate([ids, np.full(8 * twice, REPEATED)])
            mean = vectors[ids].mean(axis=0)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            pull = softmax @ error
            softmax -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            seen, times = np.unique(ids, return_counts=True)
            vectors[seen] -= (rate / len(ids)) * times[:, None] * pull
    direction = softmax[:, 1] - softmax[:, 0]
    return vectors @ direction, float(bias[1] - bias[0]) + prior_shift(rows, counts)


class _Scorer:
    def __init__(self, numbers: np.ndarray, bias: float):
        self.numbers, self.bias, self.known = numbers, bias, {}

    def learn(self, words: list[str]):
        if not words:
            return
        ids, owners = character_grams(words, GRAMS, BUCKETS)
        total = np.bincount(owners, self.numbers[BUCKETS + ids], len(words))
        total += self.numbers[word_buckets(words, BUCKETS)]
        size = np.bincount(owners, minlength=len(words)) + 1
        self.known.update(zip(words, zip(total.tolist(), size.tolist())))

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [(t or "").split() for t in texts]
        new = {w for words in split for w in set(words)}
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        self.learn([w for w in new if w not in self.known])
        found, known = [], self.known
        for words in split:
            total, size = 0.0, 0
            for number, features in map(known.__getitem__, words):
                total += number
                size += features
            twice = 8 * sum(map(str.__eq__, words, words[1:]))
            total += twice * float(self.numbers[REPEATED])
            odds = self.bias + (total / (size + twice) if size else 0.0)
            found.append(float(1 / (1 + np.exp(-odds))))
        return found


def _score(batches: Iterator[pa.RecordBatch], numbers, bias, threshold) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(numbers, bias)
    for batch in batches:
        scores = []
        for start in range(0, batch.num_rows, 500):
            scores += scorer.scores(batch.column("text").slice(start, 500).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(scores, pa.float64()),
                pa.array([int(s >= threshold) for s in scores], pa.int32()),
            ],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows, counts = labelled_sample(
        docs, labels, "quality", MODULUS, HELD_OUT, PER_CLASS, MAX_CHARS
    )
    numbers, bias = train(rows, counts)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "text",
    ).mapInArrow(
        lambda batches: _score(batches, numbers, bias, threshold),
        "doc_id long, held_out boolean, score double, predicted int",
    )
