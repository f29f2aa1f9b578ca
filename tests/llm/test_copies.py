"""Near-equal documents and repeated bytes against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tablecheck.llm import jaccard_join, repeated_bytes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def plain_sets(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOW)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def plain_components(rows):
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 63), order(doc_id))
    for i, (doc_id, _) in enumerate(rows):
        found = least[top(i)] if sets[i] else order(doc_id)
        yield doc_id, len(sets[i]), None if found == (1 << 63) - 1 else found


def near_copies(seed):
    """Chains and crowds of texts about the threshold, some of them sharing a passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows, doc_id = [], 100
    for family in range(12):
        words = [f"f{family}w{rng.randrange(80)}" for _ in range(rng.randrange(5, 120))]
        if family % 2:
            words[3:3] = passage
        for _ in range(rng.randrange(1, 25)):
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            rows.append((doc_id, " ".join(words)))
            doc_id += rng.choice([1, 7, -3, 11])
    rng.shuffle(rows)
    return [(10 * i + d % 10, t) for i, (d, t) in enumerate(rows)]


def compare(found, wanted):
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, wanted))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.near_equal(docs).drop("_id", "_tag").collect()
    compare(found, plain_components(rows))


def test_jaccard_join_odd_rows(odd, none):
    found = jaccard_join.near_equal(odd).drop("_id", "_tag").collect()
    compare(found, plain_components([(r[0], r[1]) for r in odd.rows]))
    kept = jaccard_join.one_per_component(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id in (5, 6, 12, 13)").count() == 2
    assert jaccard_join.near_equal(none).collect() == []


def plain_repeats(rows):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            first[key] = min(first.get(key, 1 << 63), order(doc_id))
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < order(doc_id):
                gone[i : i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()


def repeated_texts(seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab é") for _ in range(rng.randrange(20, 160))) for _ in range(30)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pieces) for _ in range(rng.randrange(0, 5))]
        parts.insert(0, "".join(rng.choice("cd") for _ in range(rng.randrange(0, 90))))
        rows.append((rng.randrange(1000), "".join(parts)))
    rows += [(2000, "a" * 300), (2001, "a" * 49), (2002, "b" + "a" * 200), (1500, "ab" * 100), (1600, "ba" * 90)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = repeated_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(repeated_bytes.without_repeats(docs).collect(), plain_repeats(rows))


def test_repeated_bytes_odd_rows(odd, none):
    found = repeated_bytes.without_repeats(odd).collect()
    compare(found, plain_repeats([(r[0], r[1]) for r in odd.rows]))
    assert repeated_bytes.without_repeats(none).collect() == []


def test_repeated_bytes_writes_no_row_per_context(spark, monkeypatch):
    text = " ".join(f"word{i * i % 1009}" for i in range(200))
    rows = [(i, text if i % 4 else f"{i} {text[:700]} {i} {text[900:]}") for i in range(40)]
    kept, plain = [], repeated_bytes.written
    monkeypatch.setattr(repeated_bytes, "written", lambda frame: kept.append(plain(frame)) or kept[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(repeated_bytes.without_repeats(docs).collect(), plain_repeats(rows))
    assert sum(frame.count() for frame in kept) <= len(rows)


def test_repeated_bytes_of_a_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BLOCK", 300)
    words = " ".join(f"word{i * i % 1009}" for i in range(200))
    found = [words.encode(), b"", b"short", words[37:900].encode(), words[:60].encode()]
    runs = repeated_bytes.runs_of(found)
    for row, text in enumerate(found):
        here = runs.row == row
        starts = [s + k for s, n in zip(runs.start[here], runs.count[here]) for k in range(n)]
        assert starts == list(range(max(0, len(text) - 49)))
    rows = [(i, text.decode()) for i, text in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(repeated_bytes.without_repeats(docs).collect(), plain_repeats(rows))
