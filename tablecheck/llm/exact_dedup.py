"""Exact dedup with skew-safe combining.

Texts are equal when their normalised forms (white space deleted) are equal. Three combining steps
use one routine: every task deduplicates what it reads, the local winners meet by digest and salt,
the salt winners meet by digest. Each step compares whole normalised texts, never digests alone, so
two texts that share a digest stay two groups. After the first step a hot group is at most one row
per task chunk, so no task ever gets all its copies.

Of equal texts the row with the most code points in the original text stays, then the smallest
doc_id. Defined cases: null text counts as empty; a null doc_id sorts last; of rows that repeat
doc_id and text one stays; an empty table gives an empty result; extra columns are carried along by
``survivors`` and ignored by ``groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.common import NO_ID, SPACE, code_points, released, small_batches, texts, written

SALTS = 8
CHUNK_BYTES = 48 << 20  # normalised text that a task holds at once in the first step


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


@released
def _digests(batches: Iterator[pa.RecordBatch], digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = texts(batch.column("text"))
        plain = [normal(x) for x in data]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([digest(x) for x in plain], pa.binary()),
                pa.array([code_points(x) for x in data], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
            ],
            names=["doc_id", "_digest", "_chars", "text_sha256"],
        )


class _Groups:
    """Groups of equal normalised texts met so far, each with its best row."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.by_digest: dict[bytes, list[dict]] = {}
        self.rows_kept: list[pa.RecordBatch] = []
        self.fresh: list[dict] = []
        self.held = 0

    def add(self, digest: bytes, plain: bytes, rank: tuple, count: int, row: int):
        found = self.by_digest.setdefault(digest, [])
        group = next((g for g in found if g["plain"] == plain), None)  # whole texts
        if group is None:
            group = {"plain": plain, "rank": rank, "count": 0, "row": None}
            found.append(group)
            self.held += 2 * len(plain) + 500
        if group["count"] == 0 or rank < group["rank"]:
            group["rank"], group["row"] = rank, row
            self.fresh.append(group)
        group["count"] += count

    def end_of_batch(self, batch: pa.RecordBatch):
        """Copy the best rows of this batch, so that the batch itself can go."""
        fresh = {id(g): g for g in self.fresh}
        if fresh:
            self.rows_kept.append(batch.take(pa.array([g["row"] for g in fresh.values()])))
            for place, group in enumerate(fresh.values()):
                group["row"] = (len(self.rows_kept) - 1, place)
            self.fresh = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, list] = {}
        for digest, found in self.by_digest.items():
            for variant, group in enumerate(found):
                batch, place = group["row"]
                pick = (place, digest, group["count"], variant, len(found))
                chosen.setdefault(batch, []).append(pick)
        for number, picks in chosen.items():
            places, digests, counts, variants, of = zip(*picks)
            batch = self.rows_kept[number].take(pa.array(places))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(digests, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(variants, pa.int32()),
                    pa.array(of, pa.int32()),
                ],
                names=[*batch.schema.names, "_digest", "_count", "_variant", "_variants"],
            )
        self.clear()


@released
def _combine(
    batches: Iterator[pa.RecordBatch], digest, by_group: bool, limit: int
) -> Iterator[pa.RecordBatch]:
    """Winners of the rows read. ``by_group``: rows come sorted by digest and groups stay whole."""
    groups = _Groups()
    for batch in batches:
        payload = batch.select(["_row", "_order"])
        ids = batch.column("_order").to_pylist()
        digests = batch.column("_digest").to_pylist() if by_group else None
        counts = batch.column("_count").to_pylist() if by_group else None
        for row, data in enumerate(texts(batch.column("_row").field("text"))):
            plain = normal(data)
            key = digests[row] if by_group else digest(plain)
            if groups.held > limit and not (by_group and key in groups.by_digest):
                groups.end_of_batch(payload)
                yield from groups.rows()
            count = counts[row] if by_group else 1
            groups.add(key, plain, (-code_points(data), ids[row]), count, row)
        groups.end_of_batch(payload)
    yield from groups.rows()


def survivors(
    docs: DataFrame,
    digest: Callable[[bytes], bytes] = sha256,
    salts: int = SALTS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per group: ``_row`` (the whole winning row), _digest, _count, _variant, _variants."""
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    source = small_batches(docs).select(payload.alias("_row"), order.alias("_order"))
    schema = T.StructType(
        [
            *source.schema.fields,
            T.StructField("_digest", T.BinaryType()),
            T.StructField("_count", T.LongType()),
            T.StructField("_variant", T.IntegerType()),
            T.StructField("_variants", T.IntegerType()),
        ]
    )

    def step(frame: DataFrame, by_group: bool) -> DataFrame:
        def run(batches):
            return _combine(batches, digest, by_group, chunk_bytes)

        return frame.mapInArrow(run, schema)

    local = step(source, False).withColumn("_salt", F.spark_partition_id() % salts)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = step(
        local.repartition(n, "_digest", "_salt").sortWithinPartitions("_digest"), True
    )
    return step(salted.repartition(n, "_digest").sortWithinPartitions("_digest"), True)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return survivors(docs, **options).select("_row.*")


def groups(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    winners = written(
        survivors(plain, digest=digest, **options).select(
            F.col("_row.doc_id").alias("keep_id"),
            F.when(F.col("_variants") > 1, F.col("_row.text")).alias("_shared"),
            "_digest",
            F.col("_count").alias("group_size"),
            "_variants",
        )
    )
    members = plain.mapInArrow(
        lambda batches: _digests(batches, digest),
        "doc_id long, _digest binary, _chars long, text_sha256 string",
    )
    # rows that repeat doc_id and text: the first of them may stay
    repeat = Window.partitionBy("_digest", "doc_id", "text_sha256").orderBy(F.desc("_chars"))
    members = members.withColumn("_repeat", F.row_number().over(repeat))
    joined = members.join(winners.where("_variants = 1"), "_digest")
    if winners.where("_variants > 1").limit(1).count():
        # different texts with one digest: tell them apart by the normalised text itself
        def named(batches):
            for batch in batches:
                plain_texts = [normal(x) for x in texts(batch.column("_shared"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("keep_id", "_digest", "group_size")),
                        pa.array([hashlib.sha256(x).hexdigest() for x in plain_texts]),
                    ],
                    names=["keep_id", "_digest", "group_size", "text_sha256"],
                )

        shared = winners.where("_variants > 1").mapInArrow(
            named, "keep_id long, _digest binary, group_size long, text_sha256 string"
        )
        columns = ["doc_id", "keep_id", "group_size", "_repeat", "text_sha256"]
        joined = joined.select(columns).unionByName(
            members.join(shared, ["_digest", "text_sha256"]).select(columns)
        )
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_repeat") == 1)).alias("kept"),
        "text_sha256",
    )
