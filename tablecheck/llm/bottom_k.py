"""MinHash near-duplicates by bottom-k sketches from one hash function.

The sketch of a set of word shingles is its ``k`` smallest hashes; a smaller set is its own sketch.
Documents with equal sets are one class, and all steps work on classes.

1. Inverted lists. Linked sets share at least ``floor_`` of their sketches (:func:`least_shared`),
   so of each sketch all but the most frequent ``floor_ - 1`` values go into lists: two linked sets
   meet in one. A passage that much of a corpus holds stays out of the lists, unless it is most of
   a document.
2. Groups. The class of a list whose sketch is held most widely is its pivot, in a crowd of near
   copies one from its middle. Every member of a list is compared with the pivot alone, so a crowd
   costs one comparison each. What links is a component.
3. Members of one group in different components may still link with each other. A member is now the
   set of its differences from the pivot. Linked members differ by little, thus share most of their
   differences, and inverted lists of the rarest differences, cut by the same argument and by
   position, lead to the few pairs left. Edits of their own keep unlinked copies of one text apart.
4. A pair is estimated from the union sketch, the ``k`` smallest hashes of both, and what passes is
   compared on the full sets.

Only sketches can miss a link: at ``k = 64`` a pair at the threshold is lost with a probability
below 1e-9, a closer one with less, and sets of up to ``k`` shingles never. Steps 3 and 4 are exact
otherwise. Shingles are compared as 64-bit hashes.

Defined cases: null text and text without words has the empty set and is linked with nothing; fewer
words than a shingle are one shingle. Null ids sort last, and each such row is a document of its own
with a null component unless linked to a row with an id; of these none is kept that a link leads
away from. Rows that repeat id and text share a class and one verdict. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import NO_ID, identity, released, small_batches, texts, written
from tablecheck.llm.shingles import Shingles, components

SIZE, PERCENT, K = 3, 85, 64
LOSS = 1e-9
HELD = ["p", "value", "of_pivot", "holders", "own", "low", "high"]
COMMON = 4  # a group's array has the differences that one in so many of its members has
MEMBER = ["p", "sid", "own", "n", "n_p", "d", "root"]
BROADCAST_IDS = 500_000  # ids of texts to read again that are sent to all tasks; more go by shuffle


def least_shared(k: int, percent: int) -> int:
    """How many of the ``k`` values of a union sketch linked sets have in common, but for LOSS.

    At the threshold their number is at least as concentrated as a binomial one.
    """
    share, tail = percent / 100, 0.0
    for count in range(k + 1):
        tail += math.comb(k, count) * share**count * (1 - share) ** (k - count)
        if tail > LOSS:
            return max(count, 1)
    return k


def must_share(n: int, k: int, percent: int) -> int:
    """How many sketch values a set of ``n`` shares with any linked one."""
    needed = -(-percent * n // 100)
    # a linked set has at most 100 / percent * n shingles: with as many as k both are whole
    return needed if 100 * n <= percent * k else min(needed, least_shared(k, percent))


def blob(found: np.ndarray) -> bytes:
    return found.tobytes()


def hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def passes_estimate(a: np.ndarray, b: np.ndarray, k: int, floor_: int) -> bool:
    """Does the sketch of the union leave a link possible? Sorted sets; small unions are exact."""
    low = np.union1d(a[:k], b[:k])[:k]
    if len(low) < k:
        return True
    both = np.intersect1d(np.intersect1d(a[:k], b[:k], assume_unique=True), low, assume_unique=True)
    return len(both) >= floor_


def linked(a: np.ndarray, b: np.ndarray, k: int, percent: int, floor_: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if not passes_estimate(a, b, k, floor_):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@released
def _scanned(batches, size: int, percent: int, k: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingles(size)
    for batch in batches:
        counts, digests, low, must = [], [], [], []
        for text in texts(batch.column("text")):
            found = shingles.of(text)
            counts.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            low.append(found[:k].view(np.int64))
            must.append(must_share(len(found), k, percent))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "_id", "_tag")),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(low, pa.list_(pa.int64())),
                pa.array(must, pa.int32()),
            ],
            names=["doc_id", "_id", "_tag", "n", "digest", "sketch", "must"],
        )


@released
def _whole_sets(batches, size: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingles(size)
    for batch in batches:
        sets = [blob(shingles.of(text)) for text in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sid"), pa.array(sets, pa.binary())], names=["sid", "members"]
        )


@released
def _compared(batches, k: int, percent: int, floor_: int) -> Iterator[pa.RecordBatch]:
    """Pairs (sid, p) with ``linked`` and what each of both sets has that the other has not."""
    for batch in batches:
        found, more, less = [], [], []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b = hashes(x), hashes(y)
            found.append(linked(a, b, k, percent, floor_))
            more.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64))
            less.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("sid", "p")),
                pa.array([len(x) // 8 for x in batch.column("y").to_pylist()], pa.int64()),
                pa.array(found, pa.bool_()),
                pa.array(more, pa.list_(pa.int64())),
                pa.array(less, pa.list_(pa.int64())),
            ],
            names=["sid", "p", "n_p", "linked", "more", "less"],
        )


@released
def _verified(batches, k: int, percent: int, floor_: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            linked(hashes(x), hashes(y), k, percent, floor_)
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _listed(sets: DataFrame) -> DataFrame:
    """(sid, weight, value): the values of each sketch that go into lists, if another set holds them
    too. The weight, all holders of a sketch's values, is greatest in the middle of a crowd."""
    values = sets.select("sid", "must", F.explode("sketch").alias("value"))
    shared = written(
        values.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    )
    ranked = (
        values.join(shared, "value")
        .groupBy("sid", "must")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("found"))
        # values without another holder come first, so of the rest all but must - 1 are listed
        .where(F.size("found") >= F.col("must"))
    )
    kept = F.slice("found", F.lit(1), F.size("found") - F.col("must") + 1)
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["holders"])
    return ranked.select("sid", weight.alias("weight"), F.explode(kept["value"]).alias("value"))


def _grouped(listed: DataFrame) -> DataFrame:
    """Distinct (sid, p): sets and the pivots of the lists that hold them."""
    pivots = written(
        listed.groupBy("value")
        .agg(F.max(F.struct("weight", "sid"))["sid"].alias("p"), F.count("*").alias("members"))
        .where("members > 1")
        .select("value", "p")
    )
    return listed.join(pivots, "value").where("sid <> p").select("sid", "p").distinct()


def _with_sets(pairs: DataFrame, whole: DataFrame, a: str, b: str) -> DataFrame:
    first = whole.select(F.col("sid").alias(a), F.col("members").alias("x"))
    second = whole.select(F.col("sid").alias(b), F.col("members").alias("y"))
    return pairs.join(first, a).join(second, b)


@released
def _held(batches) -> Iterator[pa.RecordBatch]:
    """Per batch, group and difference: its holders here, is one of them an own member, and their roots' range."""
    for batch in batches:
        parts = []
        for side in ("more", "less"):
            values = batch.column(side)
            rows = pc.list_parent_indices(values)
            names = ("p", "own", "root")
            parts.append(
                pa.table(
                    [*(batch.column(c).take(rows) for c in names), pc.list_flatten(values)], [*names, "value"]
                ).append_column("of_pivot", pa.array(np.full(len(rows), side == "less")))
            )
        met = pa.concat_tables(parts).group_by(["p", "value", "of_pivot"]).aggregate(
            [("root", "count"), ("own", "max"), ("root", "min"), ("root", "max")]
        )
        columns = ["p", "value", "of_pivot", "root_count", "own_max", "root_min", "root_max"]
        yield from met.select(columns).rename_columns(HELD).combine_chunks().to_batches()


@released
def _by_rarity(batches) -> Iterator[pa.RecordBatch]:
    """The differences of each member that another one shares, as ``found``, the rarest first."""
    for batch in batches:
        found = []
        names = ("rare", "rare_held", "common", "common_held", "more", "less")
        columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        for rare, rare_held, common, common_held, more, less in zip(*columns):
            rare, rare_held, common, common_held = (
                np.zeros(0, np.int64) if x is None else x for x in (rare, rare_held, common, common_held)
            )
            has = np.isin(common, np.concatenate([more, less]))
            values = np.concatenate([rare, common[has]])
            holders = np.concatenate([rare_held, common_held[has]])
            found.append(values[np.lexsort((values, holders))])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in MEMBER), pa.array(found, pa.list_(pa.int64()))],
            names=[*MEMBER, "found"],
        )


def _crossing(compared: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one group, in different components, that share as many differences from
    the pivot as a link needs.

    Linked sets of n and m shingles differ in at most ``away * (n + m)`` of them. If x and y differ
    from the pivot in d and e shingles, they share at least (d + e - away * (n + m)) / 2 of these,
    and one at least where a set is not linked with the pivot. All in integers.

    ``own``: two members that only visit the group (``own`` is false) need not meet in it. A difference
    counts only where an own member and a set of another component share it. Those of the pivot's
    shingles, or with a large part of the group, are few whatever its number of members: a group has one
    array of them with their holders, which goes to its members as it is. The others meet by join.
    """
    rest, whole = 100 - percent, 100 + percent
    placed = (
        compared.join(sets.select("sid", "n"), "sid")
        .join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        .select(
            "sid", "p", "own", "n", "n_p", "more", "less",
            (F.size("more") + F.size("less")).cast("long").alias("d"),
            F.coalesce("root", "sid").alias("root"),
        )
    )
    split = written(
        placed.groupBy("p")
        .agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("own"),
            F.count("*").alias("crowd"),
        )
        .where("low < high and own")
        .select("p", "crowd")
    )
    members = written(placed.join(split.select("p"), "p"))
    shared = written(
        members.select("p", "own", "root", "more", "less")
        .mapInArrow(
            _held,
            "p long, value long, of_pivot boolean, holders long, own boolean, low long, high long",
        )
        .groupBy("p", "value", "of_pivot")
        .agg(
            F.sum("holders").alias("holders"), F.max("own").alias("own"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        .where("own and low < high")
        .join(split, "p")
        .select("p", "value", "holders", F.expr(f"of_pivot or {COMMON} * holders >= crowd").alias("common"))
    )

    def together(frame, by, name):
        pairs = F.collect_list(F.struct("value", "holders"))
        return frame.groupBy(*by).agg(pairs.alias("pairs")).select(
            *by, F.col("pairs.value").alias(name), F.col("pairs.holders").alias(f"{name}_held")
        )

    common = together(shared.where("common"), ["p"], "common")
    members = members.join(common, "p", "left")
    others = F.array_except("more", F.coalesce("common", F.array().cast("array<long>")))
    rare = together(
        members.select("p", "sid", F.explode(others).alias("value"))
        .join(shared.where("not common").drop("common"), ["p", "value"]),
        ["p", "sid"], "rare",
    )
    found = written(
        members.join(rare, ["p", "sid"], "left")
        .mapInArrow(
            _by_rarity,
            "p long, sid long, own boolean, n long, n_p long, d long, root long, found array<long>",
        )
    )
    # differences that no member to meet has come first; they are counted in positions only
    single = F.col("d") - F.size("found")
    most = F.expr(f"n * {rest} div {percent}")  # differences from the largest linked set
    outside = F.expr(f"({rest} * ({percent} * n + 100 * n_p)) div (100 * {whole})")
    shorter = F.greatest(F.lit(1), F.ceil((F.col("d") + F.greatest("d", outside) - most) / 2))
    longer = F.greatest(F.lit(1), F.col("d") - most)

    def listed(least):
        count = F.greatest(F.lit(0), F.size("found") - least + 1)
        kept = F.slice("found", F.lit(1), count.cast("int"))
        return found.select(
            "p", "sid", "own", "n", "d", "root", single.alias("single"), F.posexplode(kept).alias("i", "value")
        ).withColumn("left", F.col("d") - F.col("single") - F.col("i"))

    x, y = written(listed(shorter)).alias("x"), written(listed(longer)).alias("y")
    needed = F.expr(f"{whole} * (x.d + y.d) - {rest} * (x.n + y.n)")
    close = F.expr(
        f"x.root <> y.root and (x.own or y.own) and (x.d < y.d or x.d = y.d and x.sid < y.sid)"
        f" and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    )
    same = (F.col("x.p") == F.col("y.p")) & (F.col("x.value") == F.col("y.value"))
    return (
        x.join(y, same & close & (2 * whole * F.least("x.left", "y.left") >= needed))
        .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, k: int = K
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, _id, _tag."""
    floor_ = least_shared(k, percent)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    scanned = written(
        source.mapInArrow(
            lambda batches: _scanned(batches, size, percent, k),
            "doc_id long, _id long, _tag long, n long, digest binary, sketch array<long>, must int",
        )
    )
    full = scanned.where("n > 0")
    one = full.groupBy("digest", "n").agg(F.min(F.struct("_id", "_tag", "sketch", "must")).alias("m"))
    sets = written(
        one.select("digest", "n", "m.*").withColumn("sid", F.monotonically_increasing_id())
    )
    groups = written(_grouped(written(_listed(sets))))
    needed = written(
        groups.select("sid").union(groups.select("p")).distinct()
        .join(sets, "sid").select("sid", "_id", "_tag")
    )
    few = needed.count() <= BROADCAST_IDS
    whole = written(
        source.join(F.broadcast(needed) if few else needed, ["_id", "_tag"])
        .dropDuplicates(["sid"])
        .select("sid", "text")
        .mapInArrow(lambda batches: _whole_sets(batches, size), "sid long, members binary")
    )
    compared = written(
        _with_sets(groups, whole, "sid", "p").mapInArrow(
            lambda batches: _compared(batches, k, percent, floor_),
            "sid long, p long, n_p long, linked boolean, more array<long>, less array<long>",
        )
    )
    links = compared.where("linked").select(F.col("sid").alias("a"), F.col("p").alias("b"))
    roots = components(links)
    crossing = written(_crossing(compared.withColumn("own", F.lit(True)), sets, roots, percent))
    more = _with_sets(crossing, whole, "a", "b").mapInArrow(
        lambda batches: _verified(batches, k, percent, floor_), "a long, b long"
    )
    roots = components(written(links.union(more)))
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
        (F.col("_id") == F.col("component_id")).alias("kept"), "_id", "_tag",
    )
