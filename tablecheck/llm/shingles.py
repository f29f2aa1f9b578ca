"""Word shingles as sorted hashes, and components of links between sets of them."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import written

CACHED_WORDS = 300_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * M1
    return values ^ (values >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        codes = np.array([known[w] for w in words], np.uint64)
        width = min(self.size, len(words))
        count = len(words) - width + 1
        found = np.full(count, width, np.uint64)
        for k in range(width):
            found = mixed(found * M2 + codes[k : k + count])
        return np.unique(found)


def components(links_: DataFrame) -> DataFrame:
    """(node, root) of the nodes in links (a, b): the smallest node reachable, by repeated minima."""
    both = links_.select("a", "b").union(links_.select("b", "a")).distinct()
    state = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = (
            both.join(state.select(F.col("a").alias("b"), F.col("root").alias("r")), "b")
            .groupBy("a").agg(F.min("r").alias("r"))
        )
        step = state.join(near, "a").select("a", "root", F.least("root", "r").alias("next"))
        jump = state.select(F.col("a").alias("next"), F.col("root").alias("far"))
        after = written(
            step.join(jump, "next", "left").select(
                "a", F.least("next", F.coalesce("far", "next")).alias("root"),
                (F.least("next", F.coalesce("far", "next")) < F.col("root")).alias("moved"),
            )
        )
        state = after.select("a", "root")
        if not after.where("moved").limit(1).count():
            return state.withColumnRenamed("a", "node")
