"""Reasons of bad lines, case by case and over a table."""

import pytest

from quellmark.operators.row_parsing import parse_line, parse_rows

CASES = [
    ("development\tclean\thello", None, "hello"),
    ('test\ttoxic\t"a\tb ""c"""', None, 'a\tb "c"'),
    ('test\ttoxic\ta "b" c', None, 'a "b" c'),
    ('test\tclean\t"open', "quoting", None),
    ('test\tclean\t"shut" more', "quoting", None),
    ('"test\tclean\tx', "quoting", None),
    ("test\tclean", "columns", None),
    ("test\tclean\tx\t", "columns", None),
    ("", "columns", None),
    (None, "columns", None),
    ("Test\tclean\tx", "split", None),
    ("﻿test\tclean\tx", "split", None),
    ("test\tclean \tx", "label", None),
    ("test\tclean\t  ", "text", None),
    ("test\tclean\ta\rb", "text", None),
    ("test\tclean\ta\nb", "text", None),
    ("test\tclean\ta\x00b", "text", None),
    ("test\tclean\ta\x85b", "text", None),
    ("test\tclean\ta�", "text", None),
    ('test\tclean\t"a\tb"', None, "a\tb"),
    ("test\tclean\t" + "x" * 300_000, None, "x" * 300_000),
]


@pytest.mark.parametrize(("line", "reason", "text"), CASES)
def test_line(line, reason, text):
    found, fields = parse_line(line)
    assert found == reason
    if reason is None:
        assert fields[2] == text


def test_table(spark):
    rows = [(k, line, "x", "y") for k, (line, _, _) in enumerate(CASES)] * 2 + [(None, "test\tclean\tx", "x", "y")]
    frame = spark.createDataFrame(rows, "raw_id long, line string, reason string, label string")
    found = parse_rows(frame).collect()
    assert len(found) == len(rows)
    by_id = {r["raw_id"]: r["reason"] for r in found}
    assert all(by_id[k] == c[1] for k, c in enumerate(CASES)) and by_id[None] is None
    assert parse_rows(frame.limit(0)).collect() == []


def test_private_characters_beside_breaks():
    for private in ("\U000f0001", "\U000f0000\U000f0001\U000f0002\U000f0003"):
        assert parse_line(f"development\tclean\ta\nb{private}")[0] == "text"
        reason, fields = parse_line(f'development\tclean\t"a\r{private}"')
        assert reason == "text" and fields[2] == f"a\r{private}"
