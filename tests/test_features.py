"""Fixed values of bins, the shape of n-grams, and side-by-side hashing against plain Python."""

import random

import numpy as np
import pytest

from quellmark.functions import features as X
from quellmark.functions.text import fnv64, fnv64_all

#: Bins that every implementation of these features must give.
CASES = [
    (X.spanish_bins, "tox", [1722, 1731, 8133, 26526, 42498, 44885, 64854]),
    (X.word_char_bins, "ab cd. ef", [3680, 10476, 13789, 21170, 23008, 35036, 36904, 36952, 40269, 43645, 45500, 45548, 59368]),
    (X.char25_bins, "你 去死。", [1283, 1579, 15489, 22698, 26691, 32640, 47167, 50706, 51814, 59498]),
    (X.turkish_bins, "aptal", [14770, 22416, 23221, 23671, 24107, 32100, 32515, 39396, 39410, 42525, 63138, 63143]),
    (X.chinese_bins, "你a", [6375, 27751, 30612, 31883, 44600, 48369, 55720]),
]


@pytest.mark.parametrize(("make", "text", "bins"), CASES)
def test_bins(make, text, bins):
    assert sorted(make(text)) == bins


def test_empty_token_has_no_grams():
    assert X.grams("", 3, 5) == []


def test_sixteen_bits_suffice():
    state = 0xCBF29CE484222325
    for byte in b"any bytes at all":
        state = ((state ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    assert X.fnv16(b"any bytes at all") == state & 0xFFFF


@pytest.mark.parametrize("profile", list(X.SHAPES))
def test_side_by_side_equals_one_by_one(profile, monkeypatch):
    rng = random.Random(4)
    pieces = ["a", "be", "straße", "你好", "ж", "é", "\u0301", "1", "_", " ", ". ", "\n", ", ", "! ", "x" * 70, "🙂"]
    texts = ["", ".", "a", *("".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(150)), "word " * 3000]
    monkeypatch.setattr(X, "BLOCK", 500)
    sizes, bins = zip(*(X.hashed_sets(block, X.SHAPES[profile]) for block in X._blocks(texts)))
    found = np.split(np.concatenate(bins), np.cumsum(np.concatenate(sizes))[:-1])
    assert [f.tolist() for f in found] == [sorted(X.PROFILES[profile](t)) for t in texts]
    assert X.hashed_sets([], X.SHAPES[profile])[1].tolist() == []


def test_hashes_of_many_equal_single_ones():
    rng = random.Random(9)
    blobs = [rng.randbytes(rng.choice([0, 1, 7, 300])) for _ in range(200)] + [rng.randbytes(5000)]
    assert fnv64_all(blobs).tolist() == [fnv64(b) for b in blobs] and fnv64_all([]).tolist() == []
