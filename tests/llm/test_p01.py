"""Clusters against union-find, splits by cluster, and edge cases."""

import random

import pytest

from quellmark.llm import p01_splits as P
from quellmark.runtime import Workspace

SCHEMA = "record_id long, source_id string, representative_source_id string, canonical_group_id string, author_id string, detector_split string, text string, hub string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", "clash") for r in rows], SCHEMA)


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rid, src, rep, group, author, _ in rows:
        find(("r", rid))
        for key in (("s", src), ("s", rep), ("g", group), ("a", None if author is None or author.strip().lower() in P.NO_AUTHOR else author)):
            if key[1] and key[1].strip():
                parent[find(("r", rid))] = find(key)
    members = {}
    for r in rows:
        members.setdefault(find(("r", r[0])), []).append(r)
    return members.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_found_equals_union_find(spark, seed):
    rng = random.Random(seed)
    pick = lambda kind, n: rng.choice([None, "", *(f"{kind}{k}" for k in range(n))])
    rows = [(k, f"s{rng.randrange(80)}", pick("s", 80), rng.choice([None, "hot", *(f"g{k}" for k in range(60))]) if seed == 1 else pick("g", 60),
             rng.choice(["-", "Unknown ", None, *(f"a{k}" for k in range(70))]), rng.choice([None, "development", "test"])) for k in range(120)]
    want = {(r[0], min(x[0] for x in c)) for c in brute(rows) for r in c if len({x[5] for x in c} - {None}) > 1}
    assert {tuple(r) for r in P.broken_clusters(frame(spark, rows)).collect()} == want


def test_chain_and_hot_key(spark):
    chain = [(k, f"s{k}", f"s{k - 1}" if k else None, None, None, "test" if k == 59 else "development") for k in range(60)]
    hot = [(1000 + k, f"h{k}", None, "hot", "anonymous", "test" if k else "validation") for k in range(200)]
    found = {tuple(r) for r in P.broken_clusters(frame(spark, chain + hot)).collect()}
    assert found == {(k, 0) for k in range(60)} | {(1000 + k, 1000) for k in range(200)}


def test_nulls_repeats_and_empty(spark):
    assert P.broken_clusters(frame(spark, [])).collect() == []
    assert P.boruvka(P.tie_edges(frame(spark, [])), Workspace(spark, "t"))[0].collect() == []
    rows = [(1, None, None, None, None, "test"), (2, None, None, None, None, "development"), (3, "s", None, " ", "-", "test"), (3, "s", None, " ", "-", "test"), (None, "s", "s", "g", "a", "development")]
    assert P.broken_clusters(frame(spark, rows)).collect() == []


def test_splits_keep_clusters_and_ratios(spark):
    rng = random.Random(5)
    rows = [(k, f"s{k}", None, "hot" if k % 10 == 0 else None, f"a{rng.randrange(900)}", None) for k in range(3000)]
    dealt = P.deal_splits(frame(spark, rows)).toPandas()
    assert len(dealt) == 3000 and dealt.groupby("cluster_id").split.nunique().max() == 1
    share = dealt.split.value_counts(normalize=True)
    assert abs(share["development"] - 0.7) < 0.06 and abs(share["validation"] - 0.15) < 0.05 and abs(share["test"] - 0.15) < 0.05


def test_points_are_counted_exactly():
    rng = random.Random(3)
    for _ in range(50):
        n, bound = rng.randrange(1, 2000), rng.choice([0, P.CYCLE, rng.randrange(P.CYCLE)])
        assert P.points_below(n, bound) == sum((k * P.STEP + P.START) % P.CYCLE < bound for k in range(n))
    for n in (10**6, 10**13):
        assert abs(P.points_below(n, P.CYCLE * 7 // 10) - 0.7 * n) < 1e-5 * n


def test_padded_keys_are_other_keys(spark):
    rows = [(1, "s", None, None, None, "test"), (2, " s", None, None, None, "development")]
    assert P.broken_clusters(frame(spark, rows)).collect() == []


def test_forest_is_spanning(spark):
    rows = [(k, f"s{k}", None, f"g{k % 7}", None, None) for k in range(100)]
    labels, forest = P.boruvka(P.tie_edges(frame(spark, rows)), Workspace(spark, "t"))
    assert labels.select("root").distinct().count() == 7
    assert forest.distinct().count() == 100 - 7
