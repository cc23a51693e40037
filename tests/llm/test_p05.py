"""Consensus on votes of simulated annotators, and edge cases."""

import numpy as np

from quellmark.llm import p05_consensus as P

COLUMNS = ["item_id", *(f"{c}_{k}" for c in P.CATEGORIES for k in (1, 2, 3)), "annotator_1", "annotator_2", "annotator_3", "votes", "s0"]
SCHEMA = ", ".join(f"{c} " + ("long" if c == "item_id" else "string" if c[:4] == "anno" or c in ("votes", "s0") else "double") for c in COLUMNS)


def simulate(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    truth = rng.random((n, len(P.CATEGORIES))) < 0.3
    roles = {f"a{k}": ("good" if k > 7 else "inverted" if k < 3 else "yes" if k < 5 else "random") for k in range(40)}
    rows = []
    for i in range(n):
        names = rng.choice(list(roles), 3, replace=False)
        cells = []
        for c in range(len(P.CATEGORIES)):
            for name in names:
                t, r = truth[i, c], roles[name]
                v = {"good": t, "inverted": not t, "yes": True, "random": rng.random() < 0.5}[r]
                v = v if rng.random() > 0.05 else not v
                cells.append(None if rng.random() < 0.02 else float(v))
        rows.append((i, *cells, *(str(x) if rng.random() > 0.02 else None for x in names), "x", "y"))
    return truth, roles, rows


def test_consensus_beats_majority(spark):
    truth, roles, rows = simulate()
    found = P.consensus(spark.createDataFrame(rows, SCHEMA)).toPandas()
    index = {c: k for k, c in enumerate(P.CATEGORIES)}
    right = np.mean([truth[i, index[c]] == y for i, c, y in zip(found.item_id, found.category, found.consensus)])
    votes = np.array([[np.nanmean([np.nan if v is None else v for v in r[1 + 3 * c : 4 + 3 * c]]) > 0.5 for c in range(len(index))] for r in rows])
    assert right > 0.96 and right > np.mean(votes == truth) + 0.02
    fit = P.Fit(spark.createDataFrame(rows, SCHEMA)).tilts.toPandas().set_index("annotator")
    assert all((fit.s1[a] < fit.s0[a]) == (r == "inverted") for a, r in roles.items() if r in ("good", "inverted"))


def test_nulls_and_empty(spark):
    assert P.consensus(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = (1, *[None] * 18, "a", None, "b", "x", "y")
    odd = (2, *[7.0, 1.0, 1.0] * 6, None, None, None, "x", "y")
    found = P.consensus(spark.createDataFrame([nothing, odd, odd, (None, *odd[1:])], SCHEMA)).toPandas()
    assert set(found.item_id) == {2} and len(found) == 12 and (found.votes == 2).all() and (found.agreement == 1).all()


def test_dual_rises_to_its_top_by_lookup_and_by_join(spark):
    frame = spark.createDataFrame(simulate(300)[2], SCHEMA)
    looked, joined = P.Fit(frame), P.Fit(frame, bound=3)
    assert 3 < len(looked.duals) < P.PASSES and all(b > a - 1e-3 for a, b in zip(looked.duals, looked.duals[1:]))
    assert np.allclose(looked.duals, joined.duals, rtol=1e-5)
    a, b = (f.tilts.toPandas().set_index("annotator").sort_index() for f in (looked, joined))
    assert (a.index == b.index).all() and np.allclose(a, b, atol=1e-3)
    a, b = (f.labels().toPandas().sort_values(["item_id", "category"]) for f in (looked, joined))
    assert (a.consensus.to_numpy() == b.consensus.to_numpy()).all()
