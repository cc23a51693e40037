"""The fitted models against the conditions of their optimum, in plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quellmark.functions import features as X
from quellmark.functions.features import BINS
from quellmark.functions.text import nfkc_text
from quellmark.operators import linear_model as L
from quellmark.operators import logistic as G


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    labels = [rng.random() < 0.3 for _ in range(120)]
    return [("toxic" if x else "clean", sorted({rng.choice([0, 1, 2, 3, 65_535] if x else [2, 3, 4, 5]) for _ in range(3)})) for x in labels]


def gradient(data, w, cost, balanced, value):
    """Of 1/2 |w|^2 + C * sum of weighted log losses, over the bins in use and the bias."""
    bins = sorted({b for _, row in data for b in row})
    x = np.array([[value(b) if b in row else 0.0 for b in bins] + [1.0] for _, row in data])
    y = np.array([1.0 if label == "toxic" else -1.0 for label, _ in data])
    weight = np.array([len(y) / (2 * (y == v).sum()) if balanced else 1.0 for v in y])
    own = np.append(w[bins], w[BINS])
    return own - cost * x.T @ (weight * y / (1 + np.exp(y * (x @ own)))), own


@pytest.mark.parametrize("many", [False, True])
def test_optimum(spark, data, many):
    rows = spark.createDataFrame([*data, (None, [1]), ("toxic", None), ("odd", [2])], "label string, bins array<int>").repartition(3)
    ratios = np.zeros(BINS)
    ratios[[0, 1, 2, 3, 4, 5, 65_535]] = [1.5, 0.7, -0.2, 0.1, -1.1, -0.9, 2.0]
    settings = [G.Setting(1.0), G.Setting(0.15, True), G.Setting(2.0, False, True), G.Setting(0.05)]
    for setting in settings if not many else [None]:
        found = G.fit(rows, settings if many else [setting], ratios)
        for s, w in zip(settings if many else [setting], found):
            slope, own = gradient(data, w, s.cost, s.balanced, (lambda b: ratios[b]) if s.scaled else lambda b: 1.0)
            assert np.abs(slope).max() < 1e-5 and np.abs(own).max() > 0.01
            assert np.count_nonzero(w) <= 8


def test_one_bin_in_closed_form(spark):
    rows = spark.createDataFrame([("toxic", [7]), ("clean", [])], "label string, bins array<int>")
    (w,) = G.fit(rows, [G.Setting(1.0)])
    a, b = w[7], w[BINS]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    assert abs(a - sigmoid(-(a + b))) < 1e-6 and abs(b - (sigmoid(-(a + b)) - sigmoid(b))) < 1e-6


def test_blend():
    weights, ratios, active = np.zeros(BINS + 1), np.zeros(BINS), np.array([3, 9])
    weights[[3, 9, 11, BINS]], ratios[[3, 9, 11]] = [0.5, -1.5, 4.0, 0.25], [2.0, -1.0, 1.0]
    assert np.allclose(G.blended(weights, ratios, active)[[3, 9, 11, BINS]], [1.0, 1.5, 0, 0.25])
    assert np.allclose(G.blended(weights, ratios, active, 0.25)[[3, 9]], [(0.75 + 0.125) * 2, -(0.75 - 0.375)])
    assert not G.blended(weights, ratios, active[:0]).any() or G.blended(weights, ratios, active[:0])[BINS] == 0.25


def test_both_labels_are_needed(spark, data):
    rows = spark.createDataFrame(data, "label string, bins array<int>")
    for some in (rows.where("label = 'clean'"), rows.limit(0)):
        with pytest.raises(ValueError):
            G.fit(some, [G.Setting()])


@pytest.mark.parametrize("mounted", [True, False])
def test_rows_are_packed_once(spark, data, mounted, monkeypatch):
    if not mounted:
        monkeypatch.setattr(G, "_files", lambda spark, path: [])
    odd = [("toxic", []), ("clean", []), ("clean", list(range(65_536)))]
    rows = G.Rows(spark.createDataFrame([*data, *odd, (None, [1]), ("toxic", None), ("odd", [2])], "label string, bins array<int>").repartition(5))
    held = [*data, *odd]
    for label, name in enumerate(("clean", "toxic")):
        assert [rows.counts[label, b] for b in (0, 3, 65_535)] == [sum(x == name and b in own for x, own in held) for b in (0, 3, 65_535)]
        assert rows.counts[label, BINS] == sum(x == name for x, _ in held)
    (w,) = G.fit(rows, [G.Setting()])
    small = [r for r in held if len(r[1]) < 10]
    full = 1 / (1 + np.exp(w.sum()))  # the pull of the row that holds all bins
    slope = gradient(small, w, 1.0, False, lambda b: 1.0)[0] + (1 - full)
    assert np.abs(slope).max() < 1e-5
    rows.drop()


def test_passes_go_on_until_the_gradient_is_small(spark, data, monkeypatch):
    monkeypatch.setattr(G, "PASSES", 3, raising=False)  # a bound on passes would leave the fit half done
    (w,) = G.fit(spark.createDataFrame(data, "label string, bins array<int>"), [G.Setting()])
    assert np.abs(gradient(data, w, 1.0, False, lambda b: 1.0)[0]).max() < 1e-5


def test_blocks_of_words_say_the_same_as_bins():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["spoon", "Muppet", "garden", "a", "ｆork", "Forks", "window", "!"], k=12)) for _ in range(300)] + [None, "", "...", "spoon"]
    rows = [sorted(X.word_char_bins(nfkc_text(t).lower())) if t else [] for t in texts]
    rows[-1] = [1, 2]  # not what its text has
    lengths, bins = np.array([len(r) for r in rows]), np.array([b for r in rows for b in r])
    toxic, w, pull = np.arange(len(rows)) % 2 == 0, np.random.default_rng(1).normal(size=BINS + 1), np.random.default_rng(2).normal(size=len(rows))
    sums = np.zeros(BINS + 1)
    for p, r in zip(pull, rows):
        sums[r] += p
    sums[BINS] = pull.sum()
    for said in (None, texts):
        block = G.packed(lengths, bins, toxic, said)
        assert np.allclose(G.scored(block, w), [w[r].sum() + w[BINS] for r in rows]) and np.allclose(G.summed(block, pull), sums)
    assert len(block.entries) + len(block.spare) + len(block.word_bins) < len(bins) / 2


def test_all_models_are_calibrated_in_one_sweep(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, "toxic" if k % 3 else "clean", [3, 9] if k % 3 and k % 7 else [9] if k % 5 else []) for k in range(60)], "row_id long, label string, bins array<int>")
    models = [(rng.integers(-300, 300, BINS), int(b)) for b in (0, 40)] + [(np.zeros(BINS, np.int64), -5)]
    models[0][0][[3, 9]] = [200, 10]
    swept, plain = [], L.running
    monkeypatch.setattr(L, "running", lambda *a, **k: swept.append(1) or plain(*a, **k))
    found = {r["model"]: tuple(r)[1:] for r in L.grid_boundaries(L.grid_scores(rows, models), len(models), 0).collect()}
    assert len(swept) == 1 and 0 in found and 2 not in found
    for k, (lookup, base) in enumerate(models):
        weights = spark.createDataFrame([(b, int(lookup[b])) for b in (3, 9)], "bin long, weight long")
        alone = L.best_boundary(L.calibration_curve(L.raw_scores(rows, weights, spark.createDataFrame([(base,)], "bias long"), carry=("label",)), 0)).first()
        assert found.get(k) == (alone and tuple(alone))


def test_units_round_as_in_sql(spark):
    x = np.array([0.5, 1.5, -0.5, -2.5, 0.49999999999999994, 3.2, 1e9, -1e9]) / 256
    sql = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(L.quantize(F.col("x"))).collect()]
    assert L.quantized(x).tolist() == sql


ODD = [None, "", "...", "spoon", "a. b", "aaaaaaa aaaa", "ﬁne ΣΑΣ e\u0301t\u0301", "x\ny\u2028z", "_a_b", "\x02ab\x03 ab", "漢字かな 한국어", "de der des den. Der-des!"]


def told_bins(text):
    return sorted(X.word_char_bins(nfkc_text(text).lower())) if text else []


@pytest.mark.parametrize("letters", [0, 5000])
def test_blocks_are_written_from_texts_alone(letters):
    rng = random.Random(5)
    many = "".join(map(chr, range(0x4E00, 0x4E00 + letters)))  # too many letters to tell windows by a number
    texts = [" ".join(rng.choices(["spoon", "Muppet", "garden", "a", "Forks", "fork", "window!", ".", "spoons"], k=12)) for _ in range(600)] + ODD + [many]
    rows, toxic = [told_bins(t) for t in texts], np.arange(len(texts)) % 2 == 0
    w, pull = np.random.default_rng(1).normal(size=BINS + 1), np.random.default_rng(2).normal(size=len(rows))
    sums = np.zeros(BINS + 1)
    for p, r in zip(pull, rows):
        sums[r] += p
    sums[BINS] = pull.sum()
    block = G.told(texts, toxic)
    assert np.allclose(G.scored(block, w), [w[r].sum() + w[BINS] for r in rows]) and np.allclose(G.summed(block, pull), sums)
    if not letters:  # a word is written by the stems that it shares with others
        assert len(block.word_bins) < 0.6 * len(X.hashed_sets(list({w for t in texts for w in X.words(t)}), X.SHAPES["word_char_35"])[1])
    for none in ([], [None], ["", "."]):
        assert len(G.scored(G.told(none, np.zeros(len(none), bool)), w)) == len(none)


def test_rows_of_texts_are_rows_of_their_bins(spark):
    rng = random.Random(6)
    rows = [("toxic" if k % 3 else "clean", " ".join(rng.choices(["spoon", "muppet", "garden", "a"], k=3 + k % 3)) + str(k % 5)) for k in range(90)]
    rows += [("clean", t) for t in ODD] + [("odd", "spoon"), (None, "spoon")]
    texts = spark.createDataFrame(rows, "label string, text string").repartition(3)
    bins = spark.createDataFrame([(x, told_bins(t)) for x, t in rows], "label string, bins array<int>").repartition(3)
    told, plain = G.Rows(texts), G.Rows(bins)
    assert (told.counts == plain.counts).all()
    (a,), (b,) = G.fit(told, [G.Setting()]), G.fit(plain, [G.Setting()])
    assert np.abs(a - b).max() < 1e-6
    told.drop(), plain.drop()
