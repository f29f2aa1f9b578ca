"""Packing against direct tokenisation and bounds; mixing against plain proportional fitting."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tablecheck.llm import mixing, packing


def plain_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for number, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            yield doc_id, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(odd, capacity):
    found = packing.packed(odd, capacity=capacity).collect()
    rows = [(r[0], r[1]) for r in odd.rows]
    assert sorted(map(str, (tuple(r[:5]) for r in found))) == sorted(
        map(str, plain_pieces(rows, capacity))
    )
    check_sequences(found, capacity)


def check_sequences(found, capacity):
    members = defaultdict(list)
    for r in found:
        members[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in members.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return members


@pytest.mark.parametrize("ranges", [100_000, 300])
def test_best_fit_quality(spark, monkeypatch, ranges):
    monkeypatch.setattr(packing, "ROWS_PER_RANGE", ranges)
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(4.0, 1.2, 3000).astype(int) + 1, 1000)
    sizes[:700] = 77  # many equal sizes
    rows = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "key long, size long")
    placed = {r["key"]: r for r in packing.place(rows, 1000).collect()}
    assert len(placed) == len(sizes)
    members = defaultdict(list)
    for key, r in placed.items():
        members[r["sequence"]].append((r["offset"], int(sizes[key])))
    for places in members.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1000
    assert len(members) <= 1.02 * sizes.sum() / 1000 + 2


def test_mixing_reaches_the_targets(spark):
    rng = np.random.default_rng(2)
    rows = [
        (i, " ".join(["w"] * int(rng.integers(1, 200))), "en" if i % 3 else "de", f"s{min(i % 7, 3)}")
        for i in range(400)
    ] + [(1000, None, None, None), (1001, "", "xx", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixture(docs).toPandas()
    assert len(found) == len(rows)
    cells = found.groupby(["source", "lang", "topic"], dropna=False).agg(
        tokens=("n_tokens", "sum"), weight=("weight", "first"), p=("probability", "first")
    ).reset_index()
    some = cells[cells.tokens > 0].copy()
    plain = some.tokens / some.tokens.sum()
    goal = {}
    for margin in mixing.MARGINS:
        share = some.groupby(margin).tokens.sum() ** mixing.POWERS[margin]
        goal[margin] = share / share.sum()
    for _ in range(mixing.ROUNDS):
        for margin in mixing.MARGINS:
            plain = plain * some[margin].map(goal[margin]) / plain.groupby(some[margin]).transform("sum")
    assert np.allclose(plain, some.weight, atol=1e-3)
    rate = some.weight / some.tokens
    assert np.allclose(rate / rate.max(), some.p, atol=1e-6)
    assert found[found.n_tokens == 0].kept.all()
    assert (mixing.mixture(docs).toPandas().sort_values("doc_id").kept.values
            == found.sort_values("doc_id").kept.values).all()


def test_one_tiny_cell_hardly_changes_the_mixture(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, " ".join(["w"] * int(rng.integers(50, 200))), "en" if i % 3 else "de", f"s{i % 4}")
        for i in range(600)
    ]
    schema = "doc_id long, text string, lang string, source string"
    shares, cells = [], []
    for more in ([], [(1000, "five words of one source", "en", "tiny")]):
        found = mixing.mixture(spark.createDataFrame(rows + more, schema)).toPandas()
        shares.append((found.n_tokens * found.probability).sum() / found.n_tokens.sum())
        cells.append(found[found.source != "tiny"].groupby(["source", "lang"]).weight.first())
    assert found[found.source == "tiny"].kept.all()
    assert min(shares) > 0.49 and shares[1] > 0.4
    assert np.allclose(cells[0], cells[1], atol=0.02)


def test_mixing_odd_rows(odd, none):
    assert mixing.drawn(odd).count() == len(odd.rows)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixture(none).collect() == [] and packing.packed(none).collect() == []


def test_ranges_that_share_a_task_are_swept_for_themselves():
    import pyarrow as pa

    rows = [(0, 1, 50, 0), (1, 2, 30, 0), (1, 3, 20, 1), (0, 4, 10, 2), (1, 5, 10, 2)]
    kind, key, size, part = zip(*rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(key), pa.array(size), pa.array(part, pa.int32())],
        names=["kind", "key", "size", "part"],
    )
    whole = [r for b in packing._sweep(iter([batch]), 100) for r in b.to_pylist()]
    cut = [
        r for b in packing._sweep((batch.slice(i, 1) for i in range(5)), 100) for r in b.to_pylist()
    ]
    for found in (whole, cut):
        seen = {(r["kind"], r["key"], r["size"], r["sequence"], r["offset"], r["part"], r["place"]) for r in found}
        assert seen == {
            (2, 2, 30, 1, 50, 0, None), (0, 1, 20, None, None, 0, None),  # 20 of the gap stay in range 0
            (1, 3, 20, None, None, 1, 0), (2, 5, 10, 4, 90, 2, None),
        }


def test_mixing_runs_few_jobs_and_partitions_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [
        (i, " ".join(["w"] * int(rng.integers(1, 400))), ["en", "de", None][i % 3], f"s{int(i**0.5) % 9}")
        for i in range(500)
    ] + [(1000, "five words of one source", "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    group = "mixing-jobs"
    spark.sparkContext.setJobGroup(group, "")
    found = mixing.mixture(docs).toPandas().sort_values("doc_id")
    spark.sparkContext.setJobGroup("", "")
    assert (found.probability == 1).any() and (found.probability < 1).any()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 60
    monkeypatch.setattr(mixing, "CELLS", 5)
    split = mixing.mixture(docs).toPandas().sort_values("doc_id")
    assert np.allclose(found.probability, split.probability, atol=1e-8)
