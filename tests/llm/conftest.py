from __future__ import annotations

import pytest

WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x" for i in range(20_000))
    rows = [
        (0, "same line of text here\nother one\n\n", "en", "a", 1, "t0"),
        (1, "  SAME line of text here\t\nsecond thing to say", "en", "a", 2, "t1"),
        (1, "  SAME line of text here\t\nsecond thing to say", "en", "a", 2, "t1"),
        (2, None, None, None, None, None),
        (3, "", "de", "b", 0, "t3"),
        (4, "\n", "de", "b", 0, None),
        (5, long, "en", "a", len(long), "t5"),
        (6, long + " end", "en", "a", len(long), "t5"),
        (None, "same line of text here\nwithout an id", "fr", "c", 3, "t6"),
        (7, "Größe größe GRÖSSE ist hier\nGRÖSSE IST HIER ÄÖ", "de", "b", 5, ""),
        (8, "größe ist hier äö\nGRÖSSE ist hier ÄÖ", "de", "b", 5, ""),
        (9, "a b c d e a b c d e " * 30, "en", "a", 5, ""),
        (10, "other one", None, "a", 9, ""),
        (11, "otherone", "en", "a", 9, ""),
        (12, " ".join(f"k{i}" for i in range(60)), "en", "d", 9, ""),
        (13, " ".join(f"K{i}" for i in range(60)) + " tail", "en", "d", 9, ""),
        (14, " ".join(f"k{i}" for i in range(59)) + " other", "en", "d", 9, ""),
        (15, "mail me at some.one@mail.example.com or +49 (30) 123-4567 from 10.0.0.255", "en", "e", 9, ""),
        (16, "4111 1111 1111 1111 and 4111 1111 1111 1112 and 300.1.1.1 x@y", "en", "e", 9, ""),
        (17, "Zz<|endoftext|>é don't stop 'll a b\x85c 漢字", "en", "e", 9, ""),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string"
    frame = spark.createDataFrame(rows, schema)
    frame.rows = rows
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
