"""Rows that members of one group make when they meet by their differences from the pivot."""

from __future__ import annotations

import random

import pytest

from tablecheck.llm import bottom_k, jaccard_join

from test_copies import compare, near_copies
from test_sampling_and_vectors import crowd, plain_near


def unlinked(count):
    """Copies of one text with edits of their own, too many for most links."""
    rng = random.Random(count)
    rows = []
    for i in range(count):
        words = [f"b{k}" for k in range(200)]
        for k in rng.sample(range(200), rng.randrange(8, 14)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    return rows


def equal(docs):
    return jaccard_join.near_equal(docs, 5, 80).drop("_id", "_tag")


def near(docs):
    return bottom_k.near_duplicates(docs, 5, 80).drop("kept", "_id", "_tag")


@pytest.mark.parametrize("made", [equal, near])
def test_differences_from_the_pivot_meet_in_few_rows(spark, monkeypatch, made):
    rows, joined = unlinked(120), []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame, join = type(docs), type(docs).join

    def counted(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if isinstance(on, list) and on == ["p", "value"]:
            joined.append(found.count())
        return found

    monkeypatch.setattr(frame, "join", counted)
    found = made(docs).collect()
    compare(found, [r[:3] for r in plain_near(rows, 5, 80)])
    # a text shares tens of differences from the pivot with most others; the rest of them is its own
    assert joined and sum(joined) < len(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_jaccard_join_of_five_words(spark, seed):
    rows = near_copies(seed) + [(i + 10**6, text) for i, text in crowd(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(equal(docs).collect(), [r[:3] for r in plain_near(rows, 5, 80)])
