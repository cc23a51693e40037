"""Features at their byte borders, and languages of texts that no profile has seen."""

import random

import pytest
from pyspark.sql import functions as F

from quellmark.operators import language as L

TALK = {
    "DE": "der die das und ist nicht ein wir haben gestern über schöne bücher gesprochen während draußen niemand wartete",
    "EN": "the and is not what we talked about yesterday while nobody was waiting outside with their lovely new books",
    "RU": "мы вчера говорили о хороших книгах пока никто не ждал на улице и было очень тихо потом",
}


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("12 ! _", []), ("Cat cat", [b" cat "]), ("abcdef", [b" abcdef "]), ("abcdefg", [b" abcdef", b"bcdefg "]),
    ("abcdefghijkl", [b" abcdef", b"ghijkl "]), ("abcdefghijklm", [b" abcdef", b"ghijkl", b"hijklm "]), ("don't 'so'", [b" don't ", b" so "]),
    ("我a", [" 我 ".encode(), b" a "]), ("İΣ", [" iσ ".encode()]), ("ab\0cd", [b" ab "]),
])
def test_features(text, want):
    assert L.features(text) == want


def test_only_whole_characters_of_the_opening_are_read():
    assert L.opening("é" * 600) == "é" * 500 and L.opening("x" + "é" * 600) == "x" + "é" * 499
    assert L.opening("x" * 250) == "x" * 250 and len(L.features(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)))) <= 250
    assert len({L.key(f) for f in L.features("a b c abcdef abcdefgh")}) == len(L.features("a b c abcdef abcdefgh"))


def test_detection_and_routes(spark):
    rng = random.Random(1)
    line = lambda lang, n=12: " ".join(rng.choice(TALK[lang].split()) for _ in range(n))
    taught = [(f"t{k}{lang}", lang, line(lang)) for k in range(60) for lang in TALK] + [("n", None, "x"), (None, "DE", "x"), ("m", "DE", None), ("o", "XX", "x")]
    profiles = L.fit(spark.createDataFrame(taught, "key string, lang string, text string"))
    rows = [(f"j{k}{lang}", lang, line(lang)) for k in range(40) for lang in TALK] + [("empty", "DE", ""), ("short", "DE", "der"), ("other", "xx", "zzz qqq www vvv"), (None, "DE", "der"), ("null", "DE", None)]
    frame = spark.createDataFrame(rows, "key string, expected string, text string")
    found = L.detect(frame, profiles)
    got = {r["key"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows} - {None, "null"}
    assert all(got[k]["lang"] == lang and got[k]["reliable"] for k, lang, _ in rows[:120])
    assert not any(got[k]["reliable"] for k in ("empty", "short", "other")) and got["empty"]["lang"] is None and got["other"]["lang"] is None
    routed = {r["expected"]: r for r in L.routes(found.join(frame.select("key", "expected"), "key"), F.col("expected")).collect()}
    assert routed["DE"]["rows"] == 42 and routed["DE"]["correct"] == 40 and routed["DE"]["known_route_precision"] == 1
    assert routed["unsupported"]["unsupported_rejection_rate"] == 1 and routed["unsupported"]["known_route_precision"] == 0 and routed["EN"]["unsupported_rejection_rate"] is None
    assert L.detect(frame.limit(0), profiles).collect() == []
    nothing = L.fit(frame.limit(0).select("key", frame["expected"].alias("lang"), "text"))
    assert {r["lang"] for r in L.detect(frame, nothing).collect()} == {None}
