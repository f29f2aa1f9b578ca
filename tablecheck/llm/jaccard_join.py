"""N-gram Jaccard join by a token-group matrix, as components of near-equal documents.

Documents with equal shingle sets collapse to one set. The tokens of a set are its ``k`` smallest
shingle hashes; a smaller set is all tokens. Linked sets have at least ``must`` tokens in common, so
each set lists all but its ``must - 1`` most widely held tokens and two linked sets list one in common.

1. Groups: each set belongs to one group, that of the pivot it meets most. The pivots are the
   most central set of each listed token, so copies of one text, and texts about one passage, are few
   groups whatever their number.
2. Matrix: for every listed token the groups whose union holds it, with the range of their sets' sizes.
3. Bound: a set can have at most its listed tokens in a group's union and the ``must - 1`` others in
   common with a member. Groups that reach ``must`` and hold a fitting size are opened, of two groups
   the one with more members by the sets of the other.
4. Opened: the set is compared with the group's pivot in whole. It may link with another member
   only if both share most of their differences from the pivot, so lists of the rarest differences
   lead to the few pairs that are compared too, of which one is the group's own. A group that is its
   pivot alone needs no lists.

Only the choice of tokens can miss a link: at ``k = 64`` a pair at the threshold is lost with a
probability below 1e-9, a closer one with less, and sets of up to ``k`` shingles never. All else is
exact, and every comparison is of the whole sets. Shingles are compared as 64-bit hashes.

Defined cases: null text and text without words has the empty set and is linked with nothing; fewer
words than a shingle count as one shingle. Null ids sort last, each such row is a document of its own;
rows that repeat id and text are one set. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm import bottom_k
from tablecheck.llm.common import NO_ID, drop_written, identity, released, small_batches, written
from tablecheck.llm.shingles import components

SIZE, PERCENT, K = 3, 90, 64
BROADCAST_IDS = 500_000  # ids of texts to read again that are sent to all tasks; more go by shuffle


def _partition(listed: DataFrame) -> DataFrame:
    """(sid, grp): each set that lists a token with another one, and the pivot that it meets most."""
    pivots = written(
        listed.groupBy("value")
        .agg(F.max(F.struct("weight", "sid"))["sid"].alias("p"), F.count("*").alias("holders"))
        .where("holders > 1")
        .select("value", "p")
    )
    met = listed.join(pivots, "value").groupBy("sid", "p").agg(F.count("*").alias("hits"))
    return met.groupBy("sid").agg(F.max(F.struct("hits", "p"))["p"].alias("grp"))


def _qualifying(listed: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, p): sets and the pivots of other groups that can hold a partner of theirs."""
    crowds = members.groupBy("grp").agg(F.count("*").alias("crowd"))
    placed = written(
        listed.select("sid", "value")
        .join(members.join(crowds, "grp").join(sets.select("sid", "n"), "sid"), "sid")
    )
    matrix = placed.groupBy("value", F.col("grp").alias("p"), F.col("crowd").alias("larger")).agg(
        F.min("n").alias("low"), F.max("n").alias("high")
    )
    apart = matrix.groupBy("value").agg(F.count("*").alias("groups")).where("groups > 1")
    matrix = written(matrix.join(apart.select("value"), "value"))
    found = written(
        placed.join(matrix, "value")
        .where("larger > crowd or larger = crowd and p > grp")
        .where(f"100 * high >= {percent} * n and 100 * n >= {percent} * low and sid <> p")
        .select("sid", "p")
        .distinct()
    )
    drop_written(placed)
    return found


@released
def _compared(batches, k: int, percent: int, floor_: int) -> Iterator[pa.RecordBatch]:
    """Pairs (sid, p) with ``linked``, and the differences of both sets where the group has members."""
    nothing = np.zeros(0, np.int64)
    for batch in batches:
        found, more, less, sizes = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("x", "y", "wide"))
        for x, y, wide in zip(*columns):
            a, b = bottom_k.hashes(x), bottom_k.hashes(y)
            found.append(bottom_k.linked(a, b, k, percent, floor_))
            more.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64) if wide else nothing)
            less.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64) if wide else nothing)
            sizes.append(len(b))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("sid", "p", "wide")),
                pa.array(sizes, pa.int64()),
                pa.array(found, pa.bool_()),
                pa.array(more, pa.list_(pa.int64())),
                pa.array(less, pa.list_(pa.int64())),
            ],
            names=["sid", "p", "wide", "n_p", "linked", "more", "less"],
        )


def _whole(source: DataFrame, sets: DataFrame, sids: DataFrame, size: int) -> DataFrame:
    """(sid, members): the whole sets of the given sids, from their texts."""
    needed = written(sids.distinct().join(sets, "sid").select("sid", "_id", "_tag"))
    few = needed.count() <= BROADCAST_IDS
    return written(
        source.join(F.broadcast(needed) if few else needed, ["_id", "_tag"])
        .dropDuplicates(["sid"])
        .select("sid", "text")
        .mapInArrow(lambda batches: bottom_k._whole_sets(batches, size), "sid long, members binary")
    )


def near_equal(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, k: int = K
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, _id, _tag."""
    floor_ = bottom_k.least_shared(k, percent)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    scanned = written(
        source.mapInArrow(
            lambda batches: bottom_k._scanned(batches, size, percent, k),
            "doc_id long, _id long, _tag long, n long, digest binary, sketch array<long>, must int",
        )
    )
    full = scanned.where("n > 0")
    one = full.groupBy("digest", "n").agg(F.min(F.struct("_id", "_tag", "sketch", "must")).alias("m"))
    sets = written(
        one.select("digest", "n", "m.*").withColumn("sid", F.monotonically_increasing_id())
    )
    listed = written(bottom_k._listed(sets))
    members = written(_partition(listed))
    opened = _qualifying(listed, members, sets, percent)
    drop_written(listed)
    own = members.where("sid <> grp").select("sid", F.col("grp").alias("p"))
    wide = own.select("p").distinct().withColumn("wide", F.lit(True))
    pairs = written(
        own.union(opened).join(wide, "p", "left")
        .select("sid", "p", F.coalesce("wide", F.lit(False)).alias("wide"))
    )
    whole = _whole(source, sets, pairs.select("sid").union(pairs.select("p")), size)
    compared = written(
        bottom_k._with_sets(pairs, whole, "sid", "p").mapInArrow(
            lambda batches: _compared(batches, k, percent, floor_),
            "sid long, p long, wide boolean, n_p long, linked boolean, more array<long>, less array<long>",
        )
    )
    links = written(compared.where("linked").select(F.col("sid").alias("a"), F.col("p").alias("b")))
    roots = components(links)
    # linked sets of two groups: the set of one was opened with the group of the other
    met = compared.where("wide").join(members, "sid").withColumn("own", F.col("p") == F.col("grp"))
    crossing = written(bottom_k._crossing(met, sets, roots, percent))
    drop_written(compared)
    more = bottom_k._with_sets(crossing, whole, "a", "b").mapInArrow(
        lambda batches: bottom_k._verified(batches, k, percent, floor_), "a long, b long"
    )
    roots = components(written(links.union(more)))
    drop_written(whole)
    placed = sets.join(roots, F.col("sid") == F.col("node"), "left").select(
        "digest", "n", "_id", F.coalesce("root", "sid").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = written(placed.join(smallest, "root").select("digest", "n", "component_id"))
    found = full.join(named, ["digest", "n"]).unionByName(
        scanned.where("n = 0").withColumn("component_id", F.col("_id"))
    )
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
        "_id", "_tag",
    )


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; null ids all stay alone."""
    dropped = (
        near_equal(docs, **options).where("_id <> component_id").select("_id", "_tag").distinct()
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *identity())
    return rows.join(dropped, ["_id", "_tag"], "left_anti").select("_row.*")
