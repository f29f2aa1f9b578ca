"""The pipeline's stages on small tables."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tablecheck.llm import bottom_k, exact_dedup, jaccard_join, packing, toxicity
from tablecheck.llm.common import BATCH_BYTES, read_table

from test_sampling_and_vectors import plain_near


def shingles(text, size):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def similarity(one, two, size):
    a, b = shingles(one, size), shingles(two, size)
    return len(a & b) / len(a | b)


def test_near_stage_drops_copies_of_five_words_and_eight_tenths(spark):
    words = [f"w{i}" for i in range(300)]
    other = list(words)
    for i in range(25, 300, 50):
        other[i] = f"x{i}"
    base, near = " ".join(words), " ".join(other)
    assert similarity(base, near, 3) < 0.9 and similarity(base, near, 5) > 0.8
    rows = [(1, base, "en", "a"), (2, near, "en", "a"), (3, " ".join(f"y{i}" for i in range(300)), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_stages_follow_one_another(spark, tmp_path):
    """Every stage on all its predecessor kept, against plain versions where rows decide."""
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables with toxic documents to learn from
    docs = read_table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]

    def kept(name, before):
        path = str(tmp_path / name)
        stages[name](spark, before, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    def pairs(frame):
        return sorted((r.doc_id, r.text) for r in frame.collect())

    clean = kept("toxicity", docs)
    assert clean.columns == docs.columns and set(pairs(clean)) <= set(pairs(docs))
    assert 0.5 * docs.count() < clean.count() < docs.count()

    single = kept("exact_dedup", clean)
    groups = {}
    for doc_id, text in pairs(clean):
        groups.setdefault(re.sub("[ \t-\r]", "", text), []).append((-len(text), doc_id))
    assert [d for d, _ in pairs(single)] == sorted(min(g)[1] for g in groups.values())

    apart = kept("jaccard_join", single)
    first = {d for d, _, component, _ in plain_near(pairs(single), 5, 80) if d == component}
    assert [d for d, _ in pairs(apart)] == sorted(first)

    mixed = kept("mixing", apart)
    assert mixed.columns == docs.columns and 0 < mixed.count() and set(pairs(mixed)) <= set(pairs(apart))

    pieces = [r.asDict() for r in kept("packing", mixed).collect()]
    assert {p["doc_id"] for p in pieces} == {d for d, _ in pairs(mixed)}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 4096


def test_python_gets_small_batches_unless_a_bound_is_set(spark):
    rows = [(i, f"{i} " + "x" * 100_000, "en", "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    before = spark.conf.get(BATCH_BYTES, None)
    try:
        for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.packing_stage):
            spark.conf.unset(BATCH_BYTES)
            stage(spark, docs, "")
            found = [r.bytes for r in docs.mapInArrow(bytes_of, "bytes long").collect()]
            assert len(found) > 1 and max(found) < 5 << 20
        spark.conf.set(BATCH_BYTES, "1m")
        corpus_pipeline.exact_stage(spark, docs, "")
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def test_tasks_give_memory_of_batches_back(monkeypatch):
    class Pool:
        given = 0

        def release_unused(self):
            self.given += 1

    text = pa.array(["one two three", None])
    row = pa.StructArray.from_arrays([text], ["text"])
    ids = pa.array([1, 2], pa.int64())
    whole = pa.array([np.arange(9, dtype=np.uint64).tobytes()] * 2, pa.binary())
    made = {
        "toxicity": lambda b: toxicity._clean(b, toxicity.Network(), 0.5),
        "exact": lambda b: exact_dedup._combine(b, exact_dedup.sha256, False, 0),
        "scanned": lambda b: bottom_k._scanned(b, 5, 80, 64),
        "whole": lambda b: bottom_k._whole_sets(b, 5),
        "compared": lambda b: jaccard_join._compared(b, 64, 80, 30),
        "pieces": lambda b: packing._pieces(b, None, 4096),
    }
    batch = pa.RecordBatch.from_arrays(
        [row, ids, text, *[ids] * 4, whole, whole, pa.array([True, False])],
        names=["_row", "_order", "text", "doc_id", "_id", "_tag", "sid", "x", "y", "wide"],
    ).append_column("p", ids)
    for name, make in made.items():
        pool = Pool()
        with monkeypatch.context() as patch:
            patch.setattr(pa, "default_memory_pool", lambda: pool)
            found = list(make(iter([batch] * 3)))
        assert found and pool.given >= min(3, len(found)) + 1, name
