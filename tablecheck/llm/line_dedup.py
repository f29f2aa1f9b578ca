"""Line dedup: lines found in several documents stay only in the document with the smallest id.

Lines are exploded to hashes of their normalised form, the documents of each hash are counted with
map-side combining (smallest and largest id, so a hot line is one row per task), the lines over the
threshold are joined back and the texts are put together again by line position.

Defined cases: null and empty text is one empty line. Rows that repeat a doc_id count as one
document, each keeps its own text. A null doc_id sorts after all others. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import SPACE, code_points, identity, texts, written

MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower touches A-Z only


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; each has one to four bytes."""
    return len(key) >= least and (len(key) >= 4 * least or code_points(key) >= least)


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows, places = [], [], []
        for row, text in enumerate(texts(batch.column("text"))):
            for place, line in enumerate(text.split(b"\n")):
                key = line_key(line)
                if long_enough(key, least):
                    hashes.append(hashlib.md5(key).digest())
                    rows.append(row)
                    places.append(place)
        pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
        taken = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ascontiguousarray(pair[:, 0])),
                pa.array(np.ascontiguousarray(pair[:, 1])),
                batch.column("_id").take(taken),
                batch.column("_tag").take(taken),
                pa.array(places, pa.int32()),
            ],
            names=["_h1", "_h2", "_id", "_tag", "_place"],
        )


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, digests, kept = [], [], [], []
        for text, places in zip(texts(batch.column("text")), batch.column("_places").to_pylist()):
            lines = text.split(b"\n")
            out = set(places or ())
            left = b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else text
            n_lines.append(len(lines))
            n_dropped.append(len(out))
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            + ([pa.array(kept, pa.string())] if with_text else []),
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * with_text,
        )


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = 2, with_text: bool = False
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.

    A line whose normalised form has at least ``min_chars`` code points and is found in at least
    ``min_documents`` documents is dropped everywhere but in the one with the smallest id.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    lines = source.select("text", "_id", "_tag").mapInArrow(
        lambda batches: _lines(batches, min_chars),
        "_h1 long, _h2 long, _id long, _tag long, _place int",
    )
    if min_documents <= 2:
        found = lines.groupBy("_h1", "_h2").agg(
            F.min("_id").alias("_first"), F.max("_id").alias("_last")
        )
        repeated = found.where("_first < _last").select("_h1", "_h2", "_first")
    else:
        found = lines.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2")
        repeated = found.agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        repeated = repeated.where(F.col("_n") >= min_documents).select("_h1", "_h2", "_first")
    # as a table: with an aggregate below it Spark would not split the copies of a hot line
    repeated = written(repeated)
    dropped = (
        lines.join(repeated, ["_h1", "_h2"])
        .where("_id <> _first")
        .groupBy("_id", "_tag")
        .agg(F.collect_list("_place").alias("_places"))
    )
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    return (
        source.join(dropped, ["_id", "_tag"], "left")
        .select("doc_id", "text", "_places")
        .mapInArrow(
            lambda batches: _kept(batches, with_text),
            schema + (", kept_text string" if with_text else ""),
        )
    )
