"""Importance resampling towards a target corpus, with bit-sliced weights.

Features are the runs of 1 to ``longest`` consecutive words, hashed into buckets. Two passes:

1. Counts: every task adds up the buckets of its texts, the source and the target give one count
   per bucket. A bucket's gain is the floored log ratio of both shares, with one added to each count.
2. Weights: a block of documents becomes a pile of bit planes, plane ``j`` holding bit ``j`` of every
   bucket's count. The gains are planes too, those of gains above zero apart from those below.
   Plane AND plane, counted bits, times a power of two: the sums are the weights, exact in integers.

A document's draw is its weight plus Gumbel noise from the digest of its id, so the highest draws
are a sample without replacement, the same on every run. Ranks come from one range sort: rows know
their place in their range, and the sizes of the ranges, one number each, shift them.

Defined cases: a null text has no words. A null id is digested as empty text and sorts last among
equal scores. Rows that repeat an id and its text tie and take consecutive ranks. An empty target
gives gains from the source alone; an empty source gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import NO_ID, texts, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CACHED_WORDS = 300_000
BLOCK = 256  # documents that become planes at once
RANGE = 1 << 33  # monotonically_increasing_id: partition times this plus the row


class Buckets:
    """Buckets of the features of a text; those of single words are remembered."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.known = buckets, longest, {}

    def of(self, text: bytes) -> tuple[int, list[int]]:
        """Number of words, and one bucket per feature."""
        words = WORD.findall(text.lower())  # of ASCII letters only, as these are bytes
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, buckets = self.known, self.buckets
        for word in set(words):
            if word not in known:
                known[word] = zlib.crc32(word) % buckets
        found = [known[word] for word in words]
        for size in range(2, self.longest + 1):
            for i in range(len(words) - size + 1):
                found.append(zlib.crc32(b" ".join(words[i : i + size])) % buckets)
        return len(words), found


def _counted(batches, buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    made, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
    for batch in batches:
        for text in texts(batch.column("text")):
            _, found = made.of(text)
            total += np.bincount(np.array(found, np.int64), minlength=buckets)
    (held,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(frame: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: one number per bucket comes back."""
    found = frame.select("text").mapInArrow(
        lambda batches: _counted(batches, buckets, longest), "bucket long, n long"
    )
    total = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), in doubles."""
    more = float(len(source))
    all_source, all_target = float(source.sum()) + more, float(target.sum()) + more
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative values, lowest bit first, as 64-bit words: (bits, words)."""
    bits = max(int(values.max(initial=0)).bit_length(), 1)
    width = -(-len(values) // 64) * 64
    rows = np.zeros((bits, width), bool)
    for j in range(bits):
        rows[j, : len(values)] = (values >> j) & 1
    return np.packbits(rows, axis=1).view(np.uint64)


def weights(codes: np.ndarray, owners: np.ndarray, count: int, signed: list, buckets: int):
    """Sum of gains for each of ``count`` documents: ``codes[i]`` is a feature of ``owners[i]``.

    signed: (sign, planes) of the gains above and below zero.
    """
    width = -(-buckets // 64) * 64
    cells, times = np.unique(owners * width + codes, return_counts=True)
    found = np.zeros(count, np.int64)
    for j in range(int(times.max(initial=0)).bit_length()):
        bits = np.zeros(count * width, bool)
        bits[cells[(times >> j) & 1 == 1]] = True
        rows = np.packbits(bits.reshape(count, width), axis=1).view(np.uint64)
        for sign, pile in signed:
            for k, plane in enumerate(pile):
                shared = np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
                found += sign * (shared << (j + k))
    return found


def noise(doc_id: int | None, seed: int) -> int:
    """Floored Gumbel noise of an id, in thousandths."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(batches, gain: np.ndarray, longest: int, seed: int) -> Iterator[pa.RecordBatch]:
    buckets = len(gain)
    made = Buckets(buckets, longest)
    signed = [(1, planes(np.maximum(gain, 0))), (-1, planes(np.maximum(-gain, 0)))]
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            each = [made.of(text) for text in texts(batch.column("text"))]
            sizes = np.array([len(found) for _, found in each], np.int64)
            codes = np.concatenate([np.array(found, np.int64) for _, found in each])
            owners = np.repeat(np.arange(len(each)), sizes)
            weight = weights(codes, owners, len(each), signed, buckets)
            drawn = [noise(i, seed) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in each], pa.int64()),
                    pa.array(sizes),
                    pa.array(weight),
                    pa.array(weight + np.array(drawn, np.int64)),
                ],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )


def importance_scores(
    docs: DataFrame, target: DataFrame, buckets: int, longest: int, seed: int
) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        lambda batches: _scored(batches, gain, longest, seed),
        "doc_id long, n_words long, n_features long, weight long, score long",
    )


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    buckets: int = 10_000,
    longest: int = 1,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and rank among the drawn (else null).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    spark = docs.sparkSession
    scored = written(importance_scores(docs, target, buckets, longest, seed))
    able = scored.where(F.col("n_words") >= least_words).withColumn(
        "_id", F.coalesce("doc_id", F.lit(NO_ID))
    )
    order = [F.desc("score"), F.asc("_id"), F.asc("weight"), F.asc("n_features")]
    placed = written(
        able.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.floor(F.col("_place") / F.lit(RANGE)).alias("_part")
    before, shifts = 0, []
    for row in placed.groupBy(part).agg(F.count("*").alias("n")).orderBy("_part").collect():
        shifts.append((row._part, before))
        before += row.n
    draw = before * percent // 100
    shift = F.broadcast(spark.createDataFrame(shifts, "_part long, _before long"))
    place = F.col("_before") + F.col("_place") % F.lit(RANGE) + 1
    ranked = placed.withColumn("_part", part).join(shift, "_part").withColumn(
        "rank", F.when(place <= draw, place)
    )
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(names).union(rest.select(names))
