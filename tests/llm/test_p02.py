"""Near-equal pairs against a full comparison, and edge cases."""

import random

import numpy as np

from quellmark.llm import p02_overlap as P
from quellmark.llm.forms import words

SCHEMA = "row_id long, split string, text string, g long, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pairs_equal_full_comparison(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(0, 150, 3):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 10, 14, 19, 20, 33]))]
        rows.append((k, "development", " ".join(base)))
        for j in (1, 2):
            ws = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(ws) + 1)
                ws[at : at + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
            rows.append((k + j, rng.choice(["validation", "test", "development"]), " ".join(ws).upper() if j == 1 else ",  ".join(ws) + "!"))
    rows += [(1000, "development", "same"), (1001, "test", "Same!"), (1002, "test", None), (1003, None, "same"), (None, "test", "same"), (1004, "development", ""), (1005, "validation", "...")]
    want = set()
    for i, s, a in rows:
        for j, t, b in rows:
            if s == "development" and t in P.EVALUATION and i is not None and j is not None and a is not None and b is not None:
                x, y = words(a), words(b)
                if plain(x, y) * 10 <= max(len(x), len(y)):
                    want.add((i, j))
    found = [(r["row_dev"], r["row_eval"]) for r in P.overlaps(frame(spark, rows)).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_long_text_and_empty_table(spark):
    assert P.overlaps(frame(spark, [])).collect() == []
    long = " ".join(f"word{k % 997}" for k in range(20_000))
    found = P.overlaps(frame(spark, [(1, "development", long), (2, "test", long.replace("word5 ", "other ", 3))])).collect()
    assert [(r["row_dev"], r["row_eval"], r["distance"]) for r in found] == [(1, 2, 3)]


def test_distance():
    assert P.distance_within(list("abcdef"), list("abxdef"), 1) == 1
    assert P.distance_within(list("abcdef"), list("bcdefa"), 1) is None
    assert P.distance_within([], [], 0) == 0


def copied_rows(rng, texts=60, copies=9):
    """Near-copies of texts, each in several rows of every split, and one N-gram that a third of all texts begin with."""
    vocabulary, rows = [f"w{k}" for k in range(300)], []
    for k in range(texts):
        base = [rng.choice(vocabulary) for _ in range(12)]
        if k % 3 == 0:
            base[:4] = ["rare", "words", "begin", "it"]
        near = [*base[:6], "other", *base[7:]]
        for ws, split in ((base, "development"), (near, "validation"), (near, "test"), (base, "test")):
            rows += [(len(rows) + j, split, " ".join(ws)) for j in range(rng.randrange(1, copies))]
    return rows


def test_entries_are_distinct_and_hot_ngrams_dealt(spark, monkeypatch):
    rows = copied_rows(random.Random(8))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        plain_pairs = {tuple(r)[:2] for r in P.overlaps(frame(spark, rows)).collect()}
        monkeypatch.setattr(P, "hot_grams", lambda grams: [r["g"] for r in grams.groupBy("g").count().where("count > 20").collect()])
        salted = [tuple(r)[:2] for r in P.overlaps(frame(spark, rows)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, j) for i, s, a in rows for j, t, b in rows if s == "development" and t != s and plain(words(a), words(b)) <= 1}
    assert plain_pairs == want and set(salted) == want and len(salted) == len(want)


def test_hot_grams(spark):
    grams = spark.createDataFrame([(7,)] * 5000 + [(k,) for k in range(100, 4000)], "g long")
    assert P.hot_grams(grams) == [7] and P.hot_grams(grams.limit(0)) == []


def test_report_counts_classes(spark):
    rows = copied_rows(random.Random(2), 20, 5)
    full = spark.createDataFrame([(*r, f"s{r[0]}") for r in rows], "row_id long, split string, text string, source_id string")
    datasets = spark.createDataFrame([(f"s{r[0]}", "even" if r[0] % 4 == 0 else "odd") for r in rows if r[0] % 2 == 0], "source_id string, dataset string")
    pairs = P.overlaps(full).toPandas()
    split, name = {r[0]: r[1] for r in rows}, {r[0]: ("even" if r[0] % 4 == 0 else "odd") if r[0] % 2 == 0 else None for r in rows}
    found = {(r["split"], r["dataset"]): tuple(r)[2:] for r in P.report(full, datasets).collect()}
    assert found
    for (s, n), (count, touched, equal, mean) in found.items():
        own = pairs[[split[e] == s and name[e] == n for e in pairs.row_eval]]
        assert (count, touched, equal) == (len(own), own.row_eval.nunique(), (own.distance == 0).sum()) and abs(mean - own.containment.mean()) < 1e-5
    assert sum(v[0] for v in found.values()) == len(pairs)
    assert P.report(full.limit(0), datasets).collect() == []


def test_one_sort_orders_as_three():
    rng = np.random.default_rng(5)
    doc, least, gram = rng.integers(0, 50, 4000), rng.integers(0, 9, 4000) * 10**9, rng.integers(-(2**63), 2**63, 4000)
    gram[1000:1100] = gram[0] + np.arange(100)
    for docs in (50, 2**36):
        order = P._in_order(doc, least, gram, docs)
        assert all(np.array_equal(x[order], x[np.lexsort((gram, least, doc))]) for x in (doc, least, gram))


def test_containment_alone_keeps_every_match(spark):
    full = frame(spark, copied_rows(random.Random(7), 40, 4))
    classes = {}
    for r in full.collect():
        classes.setdefault((r["split"] == "development", tuple(words(r["text"]))), []).append(r["row_id"])
    first = {i: min(g) for g in classes.values() for i in g}
    found = {(r["dev"], r["held"]): r["containment"] for r in P.containments(full).collect()}
    matched = {(first[r["row_dev"]], first[r["row_eval"]]): r["containment"] for r in P.overlaps(full).collect()}
    assert all(abs(found[pair] - c) < 1e-9 for pair, c in matched.items()) and all(0 < c <= 1 for c in found.values())
    assert P.containments(full.limit(0)).collect() == []
