"""Resampling, bottom-k near-duplicates and clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tablecheck.llm import bottom_k, clustering, resampling

from test_copies import LOW, compare, near_copies, order

LAST = (1 << 63) - 1


# ------------------------------------------------------------------ resampling


def plain_features(text, buckets, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    runs = [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]
    return len(words), [zlib.crc32(run.encode()) % buckets for run in runs]


def plain_resampling(rows, target, percent, buckets, longest, least):
    made = [(i, *plain_features(t, buckets, longest)) for i, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, codes in made:
        for b in codes:
            s[b] += 1
    for text in target:
        for b in plain_features(text, buckets, longest)[1]:
            t[b] += 1
    gain = [
        math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets))))
        for x, y in zip(s, t)
    ]
    scored = []
    for doc_id, words, codes in made:
        name = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in codes)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, words, len(codes), weight, weight + noise))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], order(r[0])))
    drawn = len(able) * percent // 100
    for place, r in enumerate(able, 1):
        yield r[0], r[2], r[3], r[4], place if place <= drawn else None
    for r in scored:
        if r[1] < least:
            yield r[0], r[2], r[3], r[4], None


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 70)])
def test_resampling(spark, odd, longest, buckets):
    rng = random.Random(longest)
    words = [f"w{i}" for i in range(60)] + ["größe", "漢字", "Zeit"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 90)))) for i in range(20, 420)]
    rows += [(r[0], r[1]) for r in odd.rows] + rows[:3]
    target = [" ".join(rng.choices(words[:9], k=40)) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resampled(docs, items, percent=30, buckets=buckets, longest=longest)
    compare(found.collect(), plain_resampling(rows, target, 30, buckets, longest, 20))


def test_resampling_extra_columns_and_empty_tables(odd, none):
    named = odd.withColumn("score", odd.text).withColumn("rank", odd.lang)
    assert resampling.resampled(named, named).columns == [
        "doc_id", "n_features", "weight", "score", "rank",
    ]
    assert resampling.resampled(none, odd).collect() == []
    rows = [(r[0], r[1]) for r in odd.rows]
    found = resampling.resampled(odd, none, percent=50)
    compare(found.collect(), plain_resampling(rows, [], 50, 10_000, 1, 20))


def test_planes_hold_every_bit():
    values = np.array([0, 1, 5, 1023, 7, 2**14 - 1], np.int64)
    signed = [(1, resampling.planes(values))]
    codes = np.repeat(np.arange(6), [3, 0, 70, 1, 2, 9])
    found = resampling.weights(codes, np.zeros(len(codes), np.int64), 1, signed, 6)
    assert found.tolist() == [int(values[codes].sum())]


# ------------------------------------------------------------------ near-duplicates


def plain_near(rows, size, percent):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOW)) if w]
        width = min(size, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (doc_id, _) in zip(root, rows):
        least[r] = min(least.get(r, LAST), order(doc_id))
    for r, s, (doc_id, _) in zip(root, sets, rows):
        found = least[r] if s else order(doc_id)
        yield doc_id, len(s), None if found == LAST else found, order(doc_id) == found


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 85), (2, 3, 85), (3, 5, 80), (4, 2, 60)])
def test_near_duplicates(spark, seed, size, percent):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bottom_k.near_duplicates(docs, size, percent).drop("_id", "_tag").collect()
    compare(found, plain_near(rows, size, percent))


def crowd(seed):
    """Copies of one long text about the threshold, most of them linked only with some others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(4, 40)):
            words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i, " ".join(words)))
        if i % 4 == 0:  # a copy of the copy, farther from the base
            for _ in range(rng.randrange(0, 14)):
                words[rng.randrange(400)] = f"y{rng.randrange(10**6)}"
            rows.append((2 * i + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_crowd_of_near_copies(spark, seed):
    rows = crowd(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bottom_k.near_duplicates(docs).drop("_id", "_tag").collect()
    compare(found, plain_near(rows, 3, 85))


def test_near_duplicates_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd.rows]
    compare(bottom_k.near_duplicates(odd).drop("_id", "_tag").collect(), plain_near(rows, 3, 85))
    assert bottom_k.near_duplicates(none).collect() == []


def test_sketch_bounds():
    floor_ = bottom_k.least_shared(64, 85)
    tail = sum(math.comb(64, c) * 0.85**c * 0.15 ** (64 - c) for c in range(floor_))
    assert tail <= bottom_k.LOSS < tail + math.comb(64, floor_) * 0.85**floor_ * 0.15 ** (64 - floor_)
    assert [bottom_k.must_share(n, 64, 85) for n in (1, 20, 54)] == [1, 17, 46]
    assert bottom_k.must_share(10_000, 64, 85) == floor_


# ------------------------------------------------------------------ clustering


def plain_clusters(rows, clusters, rounds, width):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == width:
            if all(x is not None and math.isfinite(x) for x in vector):
                kept.append((vec_id, tuple(math.floor(256 * x) for x in vector)))
    key = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    mids = [r[1] for r in sorted(kept, key=key)[:clusters]]

    def place():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in mids] for _, v in kept]
        return [min((d, c) for c, d in enumerate(row)) for row in apart]

    for _ in range(rounds):
        placed = place()
        for c in range(len(mids)):
            own = [v for (_, v), (_, at) in zip(kept, placed) if at == c]
            if own:
                mids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    placed = place()
    for (vec_id, _), (d, c) in zip(kept, placed):
        digest = hashlib.sha256(",".join(map(str, mids[c])).encode()).hexdigest()
        inertia = sum(x for x, at in placed if at == c)
        yield vec_id, c, d, inertia, sum(x for x, _ in placed), digest


def vectors(seed, count, width):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), -0.5, 0.25]) for _ in range(width)]) for i in range(count)]
    rows += rows[:20] + [(1000 + i, rows[0][1]) for i in range(30)]  # repeated rows and vectors
    odd = [None, [], [0.5] * (width - 1), [0.5] * (width + 1), [None] + [0.5] * (width - 1)]
    odd += [[x] + [0.5] * (width - 1) for x in (math.nan, math.inf, -math.inf)]
    rows += [(2000 + i, v) for i, v in enumerate(odd)] + [(None, [0.125] * width)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, clusters, width", [(1, 12, 5), (2, 40, 64), (3, 400, 3)])
def test_clustering(spark, seed, clusters, width):
    rows = vectors(seed, 240, width)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = clustering.clustered(frame, clusters, rounds=3, width=width, leading=min(4, width))
    compare(found.collect(), plain_clusters(rows, clusters, 3, width))


def test_clustering_extra_columns_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, cluster string, x int, distance int"
    rows = [(1, [0.5] * 64, "a", 1, None), (2, [-0.5] * 64, None, 1, 2)]
    frame = spark.createDataFrame(rows, schema)
    compare(clustering.clustered(frame).collect(), plain_clusters([r[:2] for r in rows], 40, 5, 64))
    assert clustering.clustered(frame.where("false")).collect() == []


def test_bound_spares_distances_and_is_never_above():
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 300, (20, 24))
    x = np.floor(middles[rng.integers(0, 20, 2000)] + rng.normal(0, 20, (2000, 24))).astype(np.int64)
    found = clustering.Axes(x.mean(0), np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :8])
    mids = x[:20]
    cluster, best, measured = clustering.nearest(x, *found.of(x), mids, found)
    plain = ((x[:, None] - mids) ** 2).sum(axis=2)
    assert (cluster == plain.argmin(axis=1)).all() and (best == plain.min(axis=1)).all()
    assert measured < 0.25 * plain.size
