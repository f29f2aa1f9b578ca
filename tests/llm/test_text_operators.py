"""Operators over single texts and exact copies, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablecheck.llm import exact_dedup, line_dedup, private_data, quality_rules

SPACES = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(row):
    return repr(tuple(row))


def same(found, wanted):
    assert sorted(map(key_of, found)) == sorted(map(key_of, wanted))


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def plain_line_dedup(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACES).translate(LOW)].add(order(doc_id))
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(SPACES).translate(LOW)
            if len(key) < 10 or len(holders[key]) < 2 or order(doc_id) == min(holders[key]):
                kept.append(line)
        yield doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))


def test_line_dedup(odd):
    found = line_dedup.drop_repeated_lines(odd).collect()
    same(found, plain_line_dedup([(r[0], r[1]) for r in odd.rows]))


def test_line_dedup_with_text_and_threshold(odd):
    found = line_dedup.drop_repeated_lines(odd, min_documents=3, with_text=True)
    texts = {r["doc_id"]: r["kept_text"] for r in found.collect()}
    assert texts[0] == "same line of text here\nother one\n\n"
    assert texts[1] == "second thing to say" and texts[None] == "without an id"


def plain_rules(doc_id, text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_quality_rules(odd):
    found = quality_rules.quality_verdicts(odd)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same(
        found.select(*columns, "base_failed").collect(),
        [plain_rules(r[0], r[1]) for r in odd.rows],
    )
    assert not found.where("kept and base_failed").count()


def test_order_of_rules_changes_no_verdict(odd):
    rules = quality_rules.default_rules()
    base = quality_rules.base_figures(odd)
    one = base.select("doc_id", quality_rules.cascade(rules).isNull().alias("kept"))
    two = base.select("doc_id", quality_rules.cascade(rules[::-1]).isNull().alias("kept"))
    same(one.collect(), two.collect())


def test_rules_are_ordered_by_rejections(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('One two three !!! ', 5) as text")
    rules = [
        quality_rules.Rule("never", F.lit(False)),
        quality_rules.Rule("always", F.col("n_words") >= 0),
    ]
    assert [r.name for r in quality_rules.ordered_by_gain(docs, rules)] == ["always", "never"]


def plain_groups(rows):
    members = defaultdict(list)
    for doc_id, text in rows:
        members["".join(c for c in text or "" if c not in SPACES)].append(
            (-len(text or ""), order(doc_id), doc_id)
        )
    for plain, found in members.items():
        keep = min(found)
        done = False
        for one in sorted(found):
            kept = one[2] == keep[2] and not done
            done = done or kept
            yield one[2], keep[2], len(found), kept, sha(plain)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 10}, {"salts": 2, "digest": lambda x: x[:1]}])
def test_exact_dedup(odd, options):
    found = exact_dedup.groups(odd, **options).collect()
    same(found, plain_groups([(r[0], r[1]) for r in odd.rows]))


def test_exact_dedup_keeps_whole_rows(odd):
    found = exact_dedup.deduplicated(odd)
    assert found.columns == odd.columns
    kept = [(r[0], r[1]) for r in odd.rows]
    wanted = [g for g in plain_groups(kept) if g[3]]
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(str(g[0]) for g in wanted)


def plain_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odds = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) + sum(digits[-1::-2])
        if 14 <= len(digits) <= 19 and odds % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_personal_data_base(odd):
    wanted = []
    for r in odd.rows:
        spans = plain_spans(r[1])
        kinds = Counter(s[1] for s in spans)
        line = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted.append((r[0], kinds[0], kinds[1], kinds[2], kinds[3], sha(line), line))
    found = private_data.personal_data(odd).drop("_terms").collect()
    same(found, wanted)
    assert sum(w[1] + w[2] + w[3] + w[4] for w in wanted) == 4


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, "Write to the Quaxolin office, quax@mail.example.com please") for i in range(4)]
    rows += [(i, "please write to the office today") for i in range(4, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in private_data.personal_data(docs).collect()}
    assert found[0] == "term:13:21,email:30:51" and found[7] == ""
    clean = {r["doc_id"]: r["sanitised"] for r in private_data.sanitised(docs).collect()}
    assert clean[0] == "Write to the  office, [email] please" and clean[7] == rows[7][1]


def test_terms_of_an_entity_in_one_document(spark):
    far = "common words " * 30
    rows = [(0, f"Quaxolin {far}Ng quax@mail.example.com {far}ask quaxolin")]
    rows += [(i, f"{far}ask") for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in private_data.personal_data(docs).collect()}
    # once in the corpus, farther than any window, again after the entity, and of two letters
    text = rows[0][1]
    terms = [(m.start(), m.end()) for m in re.finditer("Quaxolin|Ng|quaxolin", text)]
    spans = [f"term:{a}:{b}" for a, b in terms]
    start = text.index("quax@")
    spans.insert(2, f"email:{start}:{start + 21}")
    assert found[0] == ",".join(spans) and not any(found[i] for i in range(1, 60))


def test_rows_with_one_id_keep_their_own_spans(spark):
    rows = [(None, "one@mail.example.com is the first"), (None, "this second row has two@mail.example.com"),
            (5, "three@mail.example.com"), (5, "to four@mail.example.com")]
    rows += [(i, "is the first this second row has to") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sorted(r["sanitised"] for r in private_data.sanitised(docs).collect() if r["doc_id"] in (None, 5))
    assert clean == ["[email]", "[email] is the first", "this second row has [email]", "to [email]"]


@pytest.mark.parametrize(
    "operator",
    [line_dedup.drop_repeated_lines, quality_rules.quality_verdicts, exact_dedup.groups,
     private_data.personal_data],
)
def test_empty_table(none, operator):
    assert operator(none).collect() == []


def test_places_of_terms_are_not_moved_to_find_disclosures(spark, monkeypatch):
    far = "common words " * 3
    rows = [(i, f"Quaxolin {far}quaxolin quax@mail.example.com {far}") for i in range(4)]
    rows += [(i, far) for i in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = []

    def written(frame):
        tables.append(frame.columns)
        return frame.localCheckpoint()

    monkeypatch.setattr(private_data, "written", written)
    found = {r["doc_id"]: r["spans"] for r in private_data.personal_data(docs).collect()}
    at = rows[0][1].index("quaxolin")
    assert found[59] == "" and found[0] == f"term:0:8,term:{at}:{at + 8},email:{at + 9}:{at + 30}"
    assert tables and not [t for t in tables if "at" in t]
