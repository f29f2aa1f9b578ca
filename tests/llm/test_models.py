"""The trained operators on planted words, odd rows and empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tablecheck.llm import quality_classifier, toxicity


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        words = ["".join(rng.choices(["ra", "lo", "mi", "ten"], k=3)) for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(60)] = "zugwort" + rng.choice(["en", "a", "is"])
            words[rng.randrange(60)] = "zugwort"
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_of_held_out_documents(planted):
    found = toxicity.toxicity_scores(*planted).collect()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in found if r["held_out"]]
    assert np.mean(right) >= 0.9


def test_filter_keeps_clean_documents(planted):
    kept = {r["doc_id"] for r in toxicity.without_toxic(*planted).collect()}
    clean = [i for i in range(500) if i % 3]
    assert np.mean([i in kept for i in clean]) >= 0.95


def test_held_out_rows_are_never_learned(planted):
    docs, labels = planted
    only = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    scores = {r["score"] for r in quality_classifier.quality_scores(docs, only).collect()}
    assert scores == {0.5}  # no label is left to learn from


@pytest.mark.parametrize(
    "operator", [toxicity.toxicity_scores, quality_classifier.quality_scores]
)
def test_odd_rows(planted, odd, none, operator):
    _, labels = planted
    found = operator(odd, labels).collect()
    assert len(found) == len(odd.rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert operator(none, labels).collect() == []
    assert operator(odd, labels.where("false")).count() == len(odd.rows)


def test_windows_cover_all_words():
    for count in (0, 1, 24, 25, 40, 41, 100):
        starts = toxicity.windows_of(count)
        covered = {i for s in starts for i in range(s, min(count, s + toxicity.WINDOW))}
        assert covered == set(range(count))


def test_training_forms_the_vectors_of_few_words_at_once(monkeypatch):
    rows = [(" ".join(f"w{i}x{k}" for k in range(150)) + " zug" * (i % 2), i % 2) for i in range(40)]
    seen = []
    plain = toxicity._Sample.vectors
    monkeypatch.setattr(
        toxicity._Sample, "vectors", lambda self, net, words: seen.append(len(words)) or plain(self, net, words)
    )
    network = toxicity.train(rows, (20, 20))
    assert max(seen) < 6000 <= len({w for text, _ in rows for w in text.split()})
    scores = toxicity.Scorer(network).scores([text for text, _ in rows])
    assert scores.shape == (40,) and np.isfinite(scores).all()
