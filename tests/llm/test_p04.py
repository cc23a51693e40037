"""Groups of copies against a dictionary, with small buckets, and edge cases."""

from collections import defaultdict

import pytest

from quellmark.llm import p04_duplicates as P
from quellmark.llm.forms import canonical

SCHEMA = "row_id long, split string, label string, text string, c string, b int"
TEXTS = ["Hello, World!", "hello world", "HELLO\n world", "hello @world", "a: x; b: y; c: z", "C: z | a: x|b: y", "a: x; b: y", "ＡＢ", "ab", "", " . ", "straße", "STRASSE", "x" * 50_000, "X" * 50_000]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("capacity", [1, 3, 20_000])
def test_groups(spark, capacity):
    rows = [(k, ("development", "test")[k % 2 if k < 30 else 0], "clean", TEXTS[k % len(TEXTS)]) for k in range(90)]
    rows += [(900, None, "clean", "hello world"), (901, "test", None, "hello world"), (902, "test", "clean", None), (None, "test", "clean", "ab")]
    groups = defaultdict(list)
    for i, s, b, t in rows:
        if None not in (i, s, b, t):
            groups[s, b, canonical(t)].append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    for room in (200, P.ROOM):
        found = [tuple(r) for r in P.copies(frame(spark, rows), capacity, room).collect()]
        assert len(found) == len(want) and set(found) == want


def test_hot_group_and_empty(spark):
    assert P.copies(frame(spark, [])).collect() == []
    rows = [(k, "test", "clean", "copy " if k % 3 else f"other {k}") for k in range(300)]
    found = P.copies(frame(spark, rows), 20).collect()
    assert len(found) == 300 and sum(r["copies"] == 200 and r["first_row_id"] == 1 for r in found) == 200


def test_buckets_fit_at_any_size(spark, monkeypatch):
    """The most rows that meet in one trie stay within the capacity, however many rows there are."""
    sizes = spark.sparkContext.accumulator(0)
    plain = P._count

    def watched(batches):
        yield from plain(_largest(batches, sizes))

    def _largest(batches, most):
        current, n = None, 0
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = n + 1 if b == current else 1
                current = b
                if n > 40:
                    most.add(1)
            yield batch

    monkeypatch.setattr(P, "_count", watched)
    for many in (500, 4000):
        rows = [(k, "test", "clean", f"the same beginning of every text and then {k % (many // 2)}") for k in range(many)]
        found = P.copies(frame(spark, rows), 40).collect()
        assert len(found) == many and all(r["copies"] == 2 for r in found) and sizes.value == 0


def test_fields_in_any_order():
    assert canonical("a: x; b: y; c: z") == canonical("c: Z | a:x|b: y ")
    assert canonical("one; two") != canonical("two; one")
    assert canonical("a_b") != canonical("ab")


def test_trie():
    trie = P.Trie()
    for k, key in enumerate([b"", b"ab", b"abc", b"ab", b"b", b"abd", b""]):
        trie.add(key, k)
    assert sorted(map(sorted, trie.terminals())) == [[0, 6], [1, 3], [2], [4], [5]]
