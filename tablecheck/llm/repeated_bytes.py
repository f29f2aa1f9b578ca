"""Substring dedup: bytes covered by a 50-byte string that also starts in an earlier document go.

This does not use the external induced sorting that was named for it; see the README. Equal strings
are brought together by content instead, which needs no order of suffixes:

1. Of every 50-byte string the 16-byte piece with the smallest hash is its anchor, so equal strings
   have the same anchor at the same place. Neighbouring strings with one anchor are a run; the bytes
   that they cover are its context. Each document reports anchors and 64-bit checks of contexts.
2. One shuffle by anchor: a context that a smaller document holds too goes whole. Of each other the
   smallest document is left, and is asked for the bytes if the anchor has several contexts.
3. The contexts that were asked for are compared string by string in one place, smallest document
   first; a string that was there before starts in a smaller document.
4. Both kinds of runs go back to their documents.

Texts are shuffled once. Strings of differing contexts are compared by their bytes. Equal contexts are
told by the check within an anchor: two differing ones agree with a probability of 2^-64.
Defined cases: null text is empty; a null doc_id sorts last; rows that repeat a doc_id are one document
and do not clear each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import identity, texts, written

LENGTH, PIECE = 50, 16
REACH = LENGTH - PIECE  # places that an anchor can have in a string, less one
P = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(24)  # bits of a place in a block; the others hold the hash that anchors go by
BLOCK = 1 << 17  # bytes that are hashed at once


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from every position on, by doubling."""
    found, width = (data.astype(np.uint64) + np.uint64(1)) * P, 1
    while width < PIECE:
        found = found[:-width] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * width) + (found[width:] ^ (found[width:] >> np.uint64(29)))
        width *= 2
    return (found ^ (found >> np.uint64(32))) * P


class Runs(NamedTuple):
    """Strings of texts that share an anchor: text, first string, how many, anchor's place in it."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    inside: np.ndarray
    anchor: np.ndarray
    check: np.ndarray


def runs_of(found: list[bytes]) -> Runs:
    """The runs of some texts in order. Blocks hold many texts; one that is longer is cut, which only ends runs early."""
    parts, block, size = [], [], 0
    for row, text in enumerate(found):
        for first in range(0, len(text) - LENGTH + 1, BLOCK):
            block.append((row, first, text[first : first + BLOCK + LENGTH - 1] if len(text) > BLOCK else text))
            size += len(block[-1][2])
            if size > BLOCK:
                parts.append(_block_runs(block))
                block, size = [], 0
            if len(text) <= BLOCK:
                break
    if block:
        parts.append(_block_runs(block))
    if not parts:
        return Runs(*[np.zeros(0, np.int64)] * 6)
    return Runs(*map(np.concatenate, zip(*parts)))


def _block_runs(block: list[tuple[int, int, bytes]]) -> Runs:
    data = np.frombuffer(b"".join(piece for _, _, piece in block), np.uint8)
    heads = np.cumsum([0] + [len(piece) for _, _, piece in block])
    hashes = piece_hashes(data)
    # smallest of REACH + 1 neighbours, the leftmost of equal ones, by doubling
    low, width = (hashes >> PLACE << PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * width <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    whole = np.ones(len(low), bool)
    for end in heads[1:-1]:
        whole[end - LENGTH + 1 : end] = False  # these would go on in the next text
    strings = np.flatnonzero(whole)
    low = low[strings]
    firsts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
    start = strings[firsts]
    last = strings[np.append(firsts[1:], len(strings)) - 1]
    place = (low[firsts] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    check = ((place - start) * 64 + last - start).astype(np.uint64)
    for k in range(-(-(2 * LENGTH - PIECE) // PIECE)):  # pieces that cover the context
        check = (check ^ hashes[np.minimum(start + k * PIECE, last + REACH)]) * np.uint64(0xD6E8FEB86659FD93)
        check ^= check >> np.uint64(32)
    at = np.searchsorted(heads, start, "right") - 1
    rows, offsets = np.array([(row, first) for row, first, _ in block], np.int64).T
    return Runs(
        rows[at], start - heads[at] + offsets[at], last - start + 1, place - start,
        (low[firsts] >> PLACE).astype(np.int64), check.view(np.int64),
    )


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchors and checks of each document."""
    for batch in batches:
        runs = runs_of(texts(batch.column("text")))
        order = np.lexsort((runs.check, runs.row))
        row, check = runs.row[order], runs.check[order]
        new = order[(np.diff(row, prepend=-1) != 0) | (np.diff(check, prepend=0) != 0)]
        pick = pa.array(runs.row[new])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(runs.anchor[new]), pa.array(runs.check[new]),
                batch.column("_id").take(pick), batch.column("_tag").take(pick),
            ],
            names=["anchor", "check", "_id", "_tag"],
        )


def _matching(found: list[bytes], checks: list[list[int] | None]) -> tuple[Runs, np.ndarray]:
    """The runs of the texts that have checks, and which of them have one of their text's."""
    runs = runs_of([text if some else b"" for text, some in zip(found, checks)])
    bounds = np.searchsorted(runs.row, np.arange(len(found) + 1))
    match = np.zeros(len(runs.row), bool)
    for some, a, b in zip(checks, bounds[:-1], bounds[1:]):
        if some:
            match[a:b] = np.isin(runs.check[a:b], np.array(some, np.int64))
    return runs, match


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that a document was asked for, with the place of the first string."""
    for batch in batches:
        found = texts(batch.column("text"))
        runs, match = _matching(found, batch.column("asked").to_pylist())
        row, start, count, inside, anchor, _ = (x[match] for x in runs)
        ends = start + count - 1 + LENGTH
        pick = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchor), pa.array(inside, pa.int32()),
                pa.array([found[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), ends.tolist())], pa.binary()),
                pa.array(start, pa.int32()),
                batch.column("_id").take(pick), batch.column("_tag").take(pick),
            ],
            names=["anchor", "inside", "context", "start", "_id", "_tag"],
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and document; runs of strings that start in a smaller document."""
    last, smallest = None, {}
    for batch in batches:
        ids, tags, spans = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("anchor", "context", "start", "_id", "_tag"))
        for anchor, context, start, own, tag in zip(*columns):
            if anchor != last:
                last, smallest = anchor, {}
            span = []
            for i in range(len(context) - LENGTH + 1):
                if smallest.setdefault(context[i : i + LENGTH], own) < own:
                    if span and span[-1] == start + i:
                        span[-1] += 1
                    else:
                        span += [start + i, start + i + 1]
            if span:
                ids.append(own)
                tags.append(tag)
                spans.append(span)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()),
             pa.array(spans, pa.list_(pa.int32()))],
            names=["_id", "_tag", "runs"],
        )


def _cut(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests, kept = [], [], [], [], []
        found = texts(batch.column("text"))
        whole, match = _matching(found, batch.column("covered").to_pylist())
        row, first, end = whole.row[match], whole.start[match], (whole.start + whole.count)[match]
        bounds = np.searchsorted(row, np.arange(len(found) + 1))
        for i, (text, runs) in enumerate(zip(found, batch.column("runs").to_pylist())):
            change = np.zeros(len(text) + 1, np.int32)
            here = slice(bounds[i], bounds[i + 1])
            np.add.at(change, first[here], 1)
            np.add.at(change, end[here] - 1 + LENGTH, -1)
            if runs:
                ends = np.array([v for run in runs for v in run]).reshape(-1, 2)
                np.add.at(change, ends[:, 0], 1)
                np.add.at(change, ends[:, 1] - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = np.frombuffer(text, np.uint8)[~gone].tobytes()
            sizes.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        columns = [
            batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, pa.int64()), pa.array(digests, pa.string()),
        ]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept_bytes"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def without_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = Window.partitionBy("anchor")
    found = (
        source.select("text", "_id", "_tag")
        .mapInArrow(_reported, "anchor long, check long, _id long, _tag long")
        .repartition(n, "anchor")
        .withColumn("_first", F.min("_id").over(Window.partitionBy("anchor", "check")))
        .withColumn("_several", F.min("check").over(one) < F.max("check").over(one))
        .withColumn("_shared", F.min("_id").over(one) < F.max("_id").over(one))
    )
    covered = F.col("_first") < F.col("_id")
    lists = written(
        found.where(covered | (F.col("_several") & F.col("_shared")))
        .groupBy("_id", "_tag")
        .agg(
            F.collect_list(F.when(covered, F.col("check"))).alias("covered"),
            F.collect_list(F.when(~covered, F.col("check"))).alias("asked"),
        )
    )
    # both uses take all columns, so that they share one shuffle of the texts
    held = source.join(lists, ["_id", "_tag"], "left").select(
        "doc_id", "text", "_id", "_tag", "covered", "asked"
    )
    runs = (
        held.mapInArrow(
            _contexts, "anchor long, inside int, context binary, start int, _id long, _tag long"
        )
        .repartition(n, "anchor")
        .sortWithinPartitions("anchor", "_id")
        .mapInArrow(_compared, "_id long, _tag long, runs array<int>")
        .groupBy("_id", "_tag")
        .agg(F.collect_list("runs").alias("runs"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        held.join(runs, ["_id", "_tag"], "left")
        .mapInArrow(
            lambda batches: _cut(batches, with_bytes),
            schema + (", kept_bytes binary" if with_bytes else ""),
        )
    )
