"""Personal data: fixed patterns, and terms that give away what the patterns found.

Base spans come from four patterns. The values they match are the protected entities. Over the whole
corpus the documents are counted that hold a term besides an entity, those that hold the entity and
those that hold the term anywhere. How far a term discloses an entity is their pointwise mutual
information as a share of the entity's information content:
``log(co * N / (df_term * df_entity)) / log(N / df_entity)``; 1 means that the term occurs only with
the entity. Most entities occur once, so ``co`` is smoothed and not cut: each shared document counts
as an accident at even odds, which leaves ``co * (1 - 2 ** -co)``. Terms at ``REMOVE`` or more are
removed, terms at ``GENERALISE`` or more are replaced by a class, wherever they stand in a document
that holds the entity.

The counts of terms need a second pass over all texts. It is narrowed by a bit map of the candidate
terms of fixed size (``SLOTS`` longs); false hits go in the exact join that follows.

Defined cases: null and empty text has no spans. Rows are told apart by a number given when the
first pass is written, so repeated rows and null ids keep their own spans. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import written

KINDS = ("email", "ip", "card", "phone", "term")
# fixed values: the patterns of the contract
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]+")

GENERALISE, REMOVE = 0.8, 0.95
SLOTS = 1 << 16
FLUSH = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base span, sorted."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """Digests of the distinct values that the spans hold."""
    values = {f"{KINDS[kind]}:{text[start:end].lower()}" for start, kind, end in spans}
    return sorted(hashlib.md5(v.encode()).hexdigest() for v in values)


def places(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of every occurrence of each term outside all spans; none without spans."""
    found: dict[str, list[tuple[int, int]]] = {}
    if not spans:
        return found
    covered = bytearray(len(text))
    for start, _, end in spans:
        covered[start:end] = b"\1" * (end - start)
    for m in TERM.finditer(text):
        if not any(covered[m.start() : m.end()]):
            found.setdefault(m.group().lower(), []).append(m.span())
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


PLACES = "array<struct<term: string, at: array<struct<start: int, stop: int>>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, entities and places of terms of each text; the other columns go along."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "text"]
        counts: list[list[int]] = [[], [], [], []]
        digests, spans, held, near = [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            found = base_spans(text)
            for kind in range(4):
                counts[kind].append(sum(1 for x in found if x[1] == kind))
            line = joined(found)
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            spans.append(line)
            held.append(entities(text, found))
            near.append(
                [
                    {"term": term, "at": [{"start": a, "stop": b} for a, b in at]}
                    for term, at in places(text, found).items()
                ]
            )
        place = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        term = pa.struct([("term", pa.string()), ("at", pa.list_(place))])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keys),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.string()),
                pa.array(held, pa.list_(pa.string())),
                pa.array(near, pa.list_(term)),
            ],
            names=[
                *keys, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
                "_entities", "_near",
            ],
        )


def _bit(term: str) -> int:
    return zlib.crc32(term.encode()) % (64 * SLOTS)


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each term that hits the bit map."""
    wanted: dict[str, bool] = {}
    counts: dict[str, int] = {}

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["term", "documents"],
        )

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for term in {x.lower() for x in set(TERM.findall(text or ""))}:
                hit = wanted.get(term)
                if hit is None:
                    place = _bit(term)
                    hit = bool((int(bits[place >> 6]) >> (place & 63)) & 1)
                    if len(wanted) < FLUSH:
                        wanted[term] = hit
                if hit:
                    counts[term] = counts.get(term, 0) + 1
        if len(counts) > FLUSH:
            yield rows()
            counts.clear()
    yield rows()


def _smoothed(count):
    """Shared documents, each an accident at even odds."""
    return count * (1 - F.pow(F.lit(2.0), -count))


def disclosures(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(_row, term, disclosure): terms from GENERALISE on, the most over the row's entities.

    A term in ``df_term`` documents can reach GENERALISE for an entity in ``df_entity`` only up to
    ``smoothed(df_entity) * (N / df_entity) ** (1 - GENERALISE)``, as if it stood in all of these.
    Terms over that bound for all entities of a row go as soon as they meet their count, before terms
    and entities are paired. Places of terms stay where they are, in ``scanned``.
    """
    total = max(scanned.count(), 1)
    holders = scanned.where(F.size("_entities") > 0)
    held = written(holders.select("_row", F.explode("_entities").alias("entity")))
    entities = held.groupBy("entity").agg(F.count("*").alias("df_entity"))
    share = F.pow(F.lit(float(total)) / F.col("df_entity"), F.lit(1 - GENERALISE))
    bound = _smoothed(F.col("df_entity")) * share
    reach = held.join(entities, "entity").groupBy("_row").agg(F.max(bound).alias("reach"))
    met = holders.select("_row", F.explode(F.col("_near")["term"]).alias("term"))
    place = f"crc32(encode(term, 'UTF-8')) % {64 * SLOTS}"
    slots = met.groupBy(F.expr(f"shiftright({place}, 6)").alias("slot")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias("bits")
    )
    bits = np.zeros(SLOTS, np.int64)
    for row in slots.collect():  # at most SLOTS rows
        bits[row["slot"]] = row["bits"]
    bits = bits.view(np.uint64)
    terms = written(
        docs.select("text")
        .mapInArrow(lambda batches: _counted(batches, bits), "term string, documents long")
        .groupBy("term")
        .agg(F.sum("documents").alias("df_term"))
    )
    rare = written(
        met.join(reach, "_row").join(terms, "term")
        .where("df_term <= reach * 1.000001")  # room for rounding, the exact test follows
        .select("_row", "term", "df_term")
    )
    pairs = written(rare.join(held, "_row"))
    information = F.log(F.lit(float(total)) / F.col("df_entity"))
    mutual = F.log(
        _smoothed(F.col("co")) * F.lit(float(total)) / (F.col("df_term") * F.col("df_entity"))
    )
    scored = written(
        pairs.groupBy("entity", "term", "df_term")
        .agg(F.count("*").alias("co"))
        .join(entities, "entity")
        .where(f"df_entity < {total}")
        .select("entity", "term", (mutual / information).alias("disclosure"))
        .where(F.col("disclosure") >= GENERALISE)
    )
    return (
        pairs.join(scored, ["entity", "term"])
        .groupBy("_row", "term")
        .agg(F.max("disclosure").alias("disclosure"))
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, _terms.

    ``spans`` holds base and term spans; ``_terms`` the term spans with their disclosure.
    """
    return _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _found(plain: DataFrame) -> DataFrame:
    """``personal_data`` of text and long columns, which all go along."""
    keys = [c for c in plain.columns if c != "text"]
    scanned = written(
        plain.mapInArrow(
            _scan,
            "".join(f"{c} long, " for c in keys) + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
            f" spans string, _entities array<string>, _near {PLACES}",
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    strengths = (
        disclosures(plain, scanned)
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_strength"))
    )

    def placed(near):
        strength = F.try_element_at("_strength", near["term"])
        return F.transform(
            near["at"],
            lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), strength.alias("disclosure")),
        )

    known = F.filter("_near", lambda near: F.map_contains_key("_strength", near["term"]))
    terms = F.when(F.col("_strength").isNotNull(), F.array_sort(F.flatten(F.transform(known, placed))))
    return scanned.join(strengths, "_row", "left").withColumn("_terms", terms).select(
        *keys, "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        _merged(F.col("spans"), F.col("_terms")).alias("spans"),
        "_terms",
    )


def _merged(spans, terms):
    """Base spans and term spans as text, by start, then kind as listed."""
    base = F.filter(F.split(spans, ","), lambda x: x != "")
    parts = F.transform(base, lambda x: F.split(x, ":"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    first = F.transform(
        parts,
        lambda p: F.struct(
            p[1].cast("int").alias("start"),
            F.array_position(kind, p[0]).cast("int").alias("kind"),
            p[2].cast("int").alias("stop"),
        ),
    )
    extra = F.transform(
        terms,
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["stop"].alias("stop")
        ),
    )
    every = F.array_sort(F.concat(first, extra))
    line = F.array_join(
        F.transform(
            every,
            lambda s: F.concat_ws(":", F.element_at(kind, s["kind"]), s["start"], s["stop"]),
        ),
        ",",
    )
    return F.when(terms.isNull(), spans).otherwise(line)


def _hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean = []
        for text, line, terms in zip(
            batch.column("text").to_pylist(),
            batch.column("spans").to_pylist(),
            batch.column("_terms").to_pylist(),
        ):
            text, strength = text or "", {t["start"]: t["disclosure"] for t in terms or ()}
            parts, at = [], 0
            for span in (line or "").split(",") if line else ():
                kind, start, end = span.split(":")
                start, end = int(start), int(end)
                gone = kind == "term" and strength[start] >= REMOVE
                if end > at:
                    parts += [text[at : max(at, start)], "" if gone else f"[{kind}]"]
                    at = end
            clean.append("".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(clean, pa.string())], names=["doc_id", "sanitised"]
        )


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and the text with base spans and generalised terms as ``[kind]``, removed terms gone.

    Rows are matched to their spans by doc_id and a hash of the text, so rows that repeat both share
    them and rows with one id, or none, and different texts do not.
    """
    from tablecheck.llm.common import identity

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    spans = (
        _found(keyed.select("_id", "_tag", "text"))
        .select("_id", "_tag", "spans", "_terms")
        .dropDuplicates(["_id", "_tag"])
    )
    return keyed.join(spans, ["_id", "_tag"], "left").mapInArrow(_hidden, "doc_id long, sanitised string")
