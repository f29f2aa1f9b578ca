"""Hashed character n-grams of many words at once, and the labelled sample that models are fitted on."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def character_grams(words: list[str], sizes: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every character n-gram of ``<word>``; buckets: a power of two."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    joined = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        count = len(codes) - n + 1
        mixed = np.full(count, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + codes[k : k + count]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:count] == owner[n - 1 :]
        found.append((mixed[inside] >> np.uint64(32)) & np.uint64(buckets - 1))
        owners.append(owner[:count][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def word_buckets(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter(
        (zlib.crc32(w.encode("utf-8", "surrogatepass")) & (buckets - 1) for w in words),
        np.int64,
        len(words),
    )


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    per_class: int,
    max_chars: int,
) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most ``per_class`` whole texts of each label, and the counts of both labels over all rows.

    Held-out rows are never read. Twice ``per_class`` ids of each label are taken by the smallest
    hashes of doc_id; of those documents, the ones of at most ``max_chars`` characters come to the
    driver, so the sample has a bound in rows and in bytes, and the broadcast ids have one too.
    """
    known = (
        labels.where((remainder(modulus) != held_out) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
    )
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [
        known.where(F.col("_label") == y).orderBy(*order).limit(2 * per_class) for y in (0, 1)
    ]
    found = (
        docs.where(F.length("text") <= max_chars)
        .select("doc_id", "text")
        .join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")
        .groupBy("doc_id", "_label")
        .agg(F.min("text").alias("text"))
        .select(F.xxhash64("doc_id").alias("_order"), "doc_id", "text", "_label")
        .collect()
    )
    found.sort()
    rows = [
        (r["text"], y) for y in (0, 1) for r in [x for x in found if x["_label"] == y][:per_class]
    ]
    return rows, (counts.get(0, 0), counts.get(1, 0))


def prior_shift(rows: list[tuple[str, int]], counts: tuple[int, int]) -> float:
    """What to add to log odds fitted on the sample so that they hold for all labelled rows."""
    ones = sum(y for _, y in rows)
    zeros = len(rows) - ones
    if not ones or not zeros or not min(counts):
        return 0.0
    return float(np.log(counts[1] / counts[0]) - np.log(ones / zeros))
