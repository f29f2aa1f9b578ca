"""Best-fit packing of tokenised documents, bulk-synchronous.

A worker tokenises word by word through a bounded cache (white space separates words for this
tokenizer, so a text's ids are those of its words). Longer documents are cut into full pieces; the
other pieces are packed in rounds. A round sorts pieces and gaps by size over ranges and sweeps each
range from large to small: a piece takes its successor among the gaps met so far, the smallest that
holds it, and what is left of that gap stays open in the range. What a range leaves over is matched
across ranges by rank: leftover gaps of earlier ranges hold every leftover piece of later ones, and
the counts and sizes per range (two rows each) say which ranks take which; a gap takes several pieces
in a row where it holds them for certain. Then gaps are updated and the round
repeats. When no piece fits any more, the largest pieces open as many sequences as their tokens need at least.

Defined cases: null and empty text is the single end id. Rows are told apart by a number, so
repeated rows and null ids are packed each for itself. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import drop_written, released, small_batches, texts, written
from tablecheck.session import small_frame

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 500_000
CACHED_LENGTH = 40
# fixed values: the split of that tokenizer, and the ASCII signs
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ROWS_PER_RANGE = 100_000
ROOM_PER_ROUND = 0.75  # of the room in leftover gaps, for pieces that share one

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """Ids of words as packed little-endian 32-bit numbers.

    Where the tokenizer splits letters from signs, a word of letters is one piece and signs after it are
    another: new words are then encoded as one line, cut where a token ends a piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        steps = (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = plan["model"].get("end_of_word_suffix")
        self.by_letters = bool(suffix) and any(
            x.get("pattern", {}).get("Regex") == LETTERS_APART for x in steps
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_letters:
            self.ends[[i for s, i in self.tokenizer.get_vocab().items() if s.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only."""
        line = self.encoded([" ".join(words)])[0]
        cuts = (np.flatnonzero(self.ends[np.frombuffer(line, "<u4")]) + 1) * 4
        if len(cuts) != len(words):  # a letter that becomes several characters in lower case
            return self.encoded(words)
        return [line[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def find(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known."""
        stems: list[tuple[bytes, bytes, bytes]] = []
        known, plain, fresh = self.known, set(), set()
        for word in words:
            stem = word.rstrip(SIGNS)
            signs = word[len(stem) :]
            stem = stem.lower()
            if self.by_letters and (stem.isalpha() or not stem.isascii() and stem.decode().isalpha()):
                stems.append((word, stem, signs))
                if stem not in known:
                    fresh.add(stem)
                if signs and signs not in known:
                    plain.add(signs)
            else:
                plain.add(word)
        found = {b"": b""}
        if fresh:
            found.update(zip(fresh, self.letters([x.decode() for x in fresh])))
        if plain:
            found.update(zip(plain, self.encoded([x.decode() for x in plain])))
        for word, stem, signs in stems:
            head = found[stem] if stem in found else known[stem]
            found[word] = head + (found[signs] if signs in found else known[signs]) if signs else head
        return found

    def ids(self, text: bytes) -> bytes:
        words = text.split()  # at ASCII white space only
        if len(self.known) > CACHED_WORDS:  # words that are not met again leave after two turns
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for word in set(words).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        if new:
            new = self.find(new)
            known.update(new)
        line = b"".join(map(known.__getitem__, words))
        for word in new:
            if len(word) > CACHED_LENGTH:
                del known[word]
        return line


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One tokenizer and its known words for all tasks of a Python worker."""
    return Words(path)


@released
def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int):
    words = words_of(path or tokenizer_path(TOKENIZER))
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows, numbers, starts, lengths, sums = [], [], [], [], []
        for row, text in enumerate(texts(batch.column("text"))):
            line = memoryview(words.ids(text) + end)
            for number, at in enumerate(range(0, len(line), 4 * capacity)):
                part = line[at : at + 4 * capacity]
                rows.append(row)
                numbers.append(number)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows, pa.int32())),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


# rows of a round. kind 0: gap (key: sequence), 1: piece that waits, 2: piece placed in _sequence
_STATE = "kind int, key long, size long, sequence long, offset long"
_SWEPT = _STATE + ", part int, place long"


@released
def _sweep(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces and gaps from large to small, gaps first; a piece takes the smallest gap open to it.

    Rows come range by range; small ranges may share a task, and each is swept for itself.
    """
    part, open_, waiting = -1, [], 0  # open_: (room, sequence, new)

    def rest() -> list[tuple]:
        # only gaps that came with this range are large enough for every piece of later ranges
        places = count()
        return [
            (0, key, room, None, None, part, next(places) if new else None)
            for room, key, new in open_
        ]

    def rows(found):
        kinds, keys, sizes, sequences, offsets, parts, places = zip(*found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (keys, sizes, sequences, offsets)),
                pa.array(parts, pa.int32()),
                pa.array(places, pa.int64()),
            ],
            names=["kind", "key", "size", "sequence", "offset", "part", "place"],
        )

    for batch in batches:
        found = []
        columns = (batch.column(c).to_pylist() for c in ("kind", "key", "size", "part"))
        for kind, key, size, at_part in zip(*columns):
            if at_part != part:
                found += rest()
                part, open_, waiting = at_part, [], 0
            at = bisect_left(open_, (size,))
            if kind == 0:
                open_.insert(at, (size, key, True))
            elif at < len(open_):
                room, sequence, _ = open_.pop(at)
                found.append((2, key, size, sequence, capacity - room, part, None))
                if room > size:
                    insort(open_, (room - size, sequence, False))
            else:
                found.append((1, key, size, None, None, part, waiting))
                waiting += 1
        if found:
            yield rows(found)
    left = rest()
    if left:
        yield rows(left)


def _by_rank(summary) -> list[dict]:
    """Which leftover pieces of a range take which leftover gaps of earlier ranges, newest first.

    A gap takes as many pieces in a row as the smallest gap of its range holds of the largest piece of
    theirs. Pieces beyond a share of the room wait, so that small ones are left for what remains of gaps.
    """
    pieces = {r["part"]: r for r in summary if r["kind"] == 1}
    left = {r["part"]: r for r in summary if r["kind"] == 0}
    room = ROOM_PER_ROUND * sum(r["total"] for r in left.values())
    gaps: list[list[int]] = []  # range, next place, count left, smallest size
    found = []
    for part in sorted(pieces.keys() | left.keys()):
        mine = pieces.get(part, {"n": 0})
        first, count = 0, mine["n"]
        while count and gaps:
            source, at, free, least = gaps[-1]
            each = max(1, least // mine["most"])
            if each > 1 and room <= 0:
                break
            taken = min(count, free * each)
            used = -(-taken // each)
            found.append(
                {"part": part, "first": first, "last": first + taken - 1, "source": source,
                 "shift": at, "each": each}
            )
            room -= taken * mine["total"] / mine["n"]
            first, count = first + taken, count - taken
            gaps[-1][1:3] = at + used, free - used
            if free == used:
                gaps.pop()
        if part in left:
            gaps.append([part, 0, left[part]["n"], left[part]["least"]])
    return found


def _round(state: DataFrame, rows: int, capacity: int) -> tuple[DataFrame, int, int]:
    """One sweep over the waiting pieces and the gaps; the new rows, how many pieces it placed and
    how many rows are left at most."""
    spark = state.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_RANGE))
    order = [F.desc("size"), F.asc("kind"), F.asc("key")]
    rows_ = state.select("kind", "key", "size")
    # few rows are one range, whatever the session's partitions: a piece that is alone in its range
    # would wait for a match by rank, and the last rounds would place two pieces each
    ranges = rows_.coalesce(1) if n == 1 else rows_.repartitionByRange(n, *order)
    swept = written(
        ranges.sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .coalesce(n)  # a session that makes more ranges of few rows has them share tasks and files
        .mapInArrow(lambda batches: _sweep(batches, capacity), _SWEPT)
    )
    counts = swept.groupBy("kind", "part", F.isnotnull("place").alias("over")).agg(
        F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.sum("size").alias("total"),
    )
    counts = counts.collect()  # a few rows per range
    placed = sum(r["n"] for r in counts if r["kind"] == 2)
    left = sum(r["n"] for r in counts if r["kind"] < 2)
    pairs = _by_rank([r for r in counts if r["over"]])
    if not pairs:
        return swept.selectExpr("kind", "key", "size", "sequence", "offset"), placed, left
    placed += sum(p["last"] - p["first"] + 1 for p in pairs)
    plan = small_frame(
        spark, pairs, "part int, first long, last long, source int, shift long, each long"
    )  # at most two rows per range
    last = {p["part"]: p["last"] for p in pairs}  # ranks of a range go up from pair to pair
    ends = small_frame(spark, [{"part": p, "last": x} for p, x in last.items()], "part int, last long")
    waiting = swept.where("kind = 1")
    in_gap = Window.partitionBy("part", "place").orderBy("_rank")  # at most a gap's tokens
    taken = (
        waiting.join(F.broadcast(plan), "part")
        .where(F.col("place").between(F.col("first"), F.col("last")))
        .select(
            F.col("key").alias("_key"),
            F.col("size").alias("_size"),
            F.col("source").alias("part"),
            (F.col("shift") + F.floor((F.col("place") - F.col("first")) / F.col("each"))).alias("place"),
            F.col("place").alias("_rank"),
        )
        .withColumn("_to", F.sum("_size").over(in_gap))
        .withColumn("_more", F.lead("_rank").over(in_gap).isNotNull())
    )
    untaken = waiting.join(F.broadcast(ends), "part", "left").where("last is null or place > last")
    columns = ["kind", "key", "size", "sequence", "offset"]
    # a gap's row once for each piece it takes; the last of them also leaves what remains of the gap
    filled = (
        swept.where("kind = 0 and place is not null")
        .join(taken, ["part", "place"], "left")
        .select(
            F.inline(
                F.array(
                    F.expr(
                        "named_struct('kind', 2, 'key', _key, 'size', _size, 'sequence', key,"
                        f" 'offset', {capacity} - size + _to - _size)"
                    ),
                    F.expr(
                        "named_struct('kind', 0, 'key', key, 'size', if(_more, 0L, size -"
                        " coalesce(_to, 0L)), 'sequence', cast(null as long), 'offset', cast(null as long))"
                    ),
                )
            )
        )
        .where("key is not null and size > 0")
    )
    both = written(
        swept.where("kind = 2 or (kind = 0 and place is null)")
        .select(columns)
        .unionAll(untaken.select(columns))
        .unionAll(filled.select(columns))
        .coalesce(max(n, spark.sparkContext.defaultParallelism))  # files of many rows
    )
    drop_written(swept)
    return both, placed, left


def _opened(state: DataFrame, sizes: dict[int, int], capacity: int) -> DataFrame:
    """The largest waiting pieces start sequences: all above half, and as many as the tokens need."""
    need = -(-sum(s * n for s, n in sizes.items()) // capacity)
    cut, share = 0, 0.0
    for size in sorted(sizes, reverse=True):
        cut = size
        if sizes[size] <= need or 2 * size > capacity:
            need -= sizes[size]
            share = 1.0
        else:
            share = need / sizes[size]
        if need <= 0 and 2 * size <= capacity or share < 1:
            break
    # of the last size a share by hash, the smallest key in any case
    dealt = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)
    lowest = state.where((F.col("kind") == 1) & (F.col("size") == cut)).agg(F.min("key")).first()[0]
    starts = (F.col("kind") == 1) & (
        (F.col("size") > cut) | ((F.col("size") == cut) & (dealt | (F.col("key") == lowest)))
    )
    marked = state.withColumn("_starts", starts)
    pieces = marked.where("_starts").select(
        F.lit(2).alias("kind"), "key", "size", F.col("key").alias("sequence"),
        F.lit(0).cast("long").alias("offset"),
    )
    gaps = marked.where(F.col("_starts") & (F.col("size") < capacity)).select(
        F.lit(0).alias("kind"), "key", (F.lit(capacity) - F.col("size")).alias("size"),
        F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("offset"),
    )
    return marked.where("not _starts").drop("_starts").unionAll(pieces).unionAll(gaps)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, sequence, offset) for rows (key, size); sizes are 1 to capacity."""
    state = pieces.selectExpr(
        "1 as kind", "key", "size", "cast(null as long) as sequence", "cast(null as long) as offset"
    )
    done: list[DataFrame] = []
    while True:
        sizes = {r["size"]: r["n"] for r in state.where("kind = 1").groupBy("size").agg(
            F.count("*").alias("n")).collect()}  # at most one row per size up to the capacity
        if not sizes:
            break
        state = written(_opened(state, sizes, capacity))
        done.append(state.where("kind = 2").select("key", "sequence", "offset"))
        waiting = state.where("kind = 1").agg(F.min("size"), F.count("*")).first()
        least, waits, rows = waiting[0], waiting[1], sum(sizes.values())
        while waits:
            # gaps below the smallest piece of this phase are closed
            usable = state.where((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("size") >= least)))
            state, placed, rows = _round(usable, rows, capacity)
            waits -= placed
            if not placed:
                break
            done.append(state.where("kind = 2").select("key", "sequence", "offset"))
    if not done:
        return pieces.selectExpr("key", "key as sequence", "cast(0 as long) as offset")
    found = done[0]
    for rows in done[1:]:
        found = found.unionAll(rows)
    return found


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(
        plain.mapInArrow(lambda batches: _pieces(batches, path, capacity), _PIECES).withColumn(
            "key", F.monotonically_increasing_id()
        )
    )
    short = pieces.where(F.col("length") < capacity)
    placed = place(short.selectExpr("key", "length as size"), capacity)
    columns = [*(c.split()[0] for c in _PIECES.split(", ")), "sequence_id", "offset"]
    full = pieces.where(F.col("length") == capacity)
    return (
        full.selectExpr("*", "key as sequence_id", "cast(0 as long) as offset")
        .select(columns)
        .unionAll(
            short.join(placed.withColumnRenamed("sequence", "sequence_id"), "key").select(columns)
        )
    )
