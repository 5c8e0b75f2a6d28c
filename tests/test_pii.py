"""Spans and redaction on hand-computed cases, and against Python's matcher."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.pii import pii_spans, redact_display, replace_values

CASES = [
    ("4111 1111 1111 1111", [("credit_card", 0, 19), ("aadhaar", 0, 14)], "[CREDIT_CARD]"),
    ("Card 4111 1111 1111 1111 end", [("credit_card", 5, 25), ("aadhaar", 5, 19)], "Card [CREDIT_CARD]end"),
    ("+91 90000 12345", [], "+91 90000 12345"),
    ("919876543210", [], "919876543210"),
    ("1234567890", [], "1234567890"),
    ("12345678901234567890", [], "12345678901234567890"),
    ("a@b.c", [], "a@b.c"),
    ("9876543210 9876543210", [("phone", 0, 10), ("phone", 11, 21)], "[PHONE] [PHONE]"),
    ("user9876543210@x.com", [("email", 0, 20), ("phone", 4, 14)], "[EMAIL]"),
    ("1234 5678 9012 1234 5678 9012", [("credit_card", 0, 19), ("aadhaar", 0, 14), ("aadhaar", 15, 29)],
     "[CREDIT_CARD] 5678 9012"),
    ("😀 abcde1234f", [("pan", 2, 12)], "😀 [PAN]"),
    (None, [], ""),
    ("", [], ""),
]


def _spans(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    found = rows.select("i", "s", pii_spans("s").alias("f")).withColumn("clean", replace_values("s", F.col("f")))
    return sorted(found.collect(), key=lambda r: r.i)


def test_known_cases(spark):
    rows = _spans(spark, [c[0] for c in CASES])
    for row, (_, spans, clean) in zip(rows, CASES):
        assert [(f.type, f.start, f.end) for f in row.f] == spans
        assert row.clean == clean


def _by_hand(text):
    found = []
    for number, (name, pattern) in enumerate(fixed.PII_PATTERNS):
        for m in re.finditer(pattern, text):
            found.append((m.start(), number, name, m.group(), m.end()))
    return sorted(found)


PIECES = st.sampled_from(
    ["9876543210", "+91", "+91-", " ", "-", "1234", "5678 9012", "4111", "a@b.co", "x.y@", "ABCDE1234F",
     "é", "😀", " ", "٣", "abc", "\n", ".", "1", "12345678901234567"]
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=40))
def test_spans_equal_python(spark, texts):
    for row, text in zip(_spans(spark, texts), texts):
        got = [(f.start, f.pattern_no, f.type, f.value, f.end) for f in row.f]
        assert got == _by_hand(text), repr(text)


def test_many_matches_in_one_text(spark):
    text = "a@b.co " * 1000
    row = _spans(spark, [text])[0]
    assert len(row.f) == 1000 and row.f[999].start == 6993 and row.f[999].end == 6999


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a@b.com now", "mail [EMAIL] now"),
        ("+91 9876543210", "[PHONE]"),
        ("4111 1111 1111 1111", "[CREDIT_CARD]"),
        ("1234 5678 9012!", "[AADHAAR]!"),
        ("abcde1234f", "[PAN]"),
        ("éa@b.com", "é[EMAIL]"),
    ],
)
def test_redact_display(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(redact_display("s")).first()[0] == want
