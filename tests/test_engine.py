"""The judge end to end, streams against tables, importers, and order-independent helpers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quellmark.api import Judge, NotReady
from quellmark.functions import text as X
from quellmark.operators import linear_model as L
from quellmark.operators.context import RULE_QUOTES, quote_ranges, tokens
from quellmark.operators.lexicon import view_matches
from quellmark.operators.ordering import nearest_rank, running
from quellmark.runtime import median_seconds
from quellmark.sources import sinks

WORDS = "room poll garden report friend train picture rule page soup story lunch".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for k in range(900):
        toxic = k % 3 == 0
        text = " ".join(rng.choice(WORDS) for _ in range(8)) + (" you " + rng.choice(["spoon", "muppet", "turnip"]) if toxic else "")
        out.append((k, ("development", "validation", "test")[rng.choice([0, 0, 1, 2])], "toxic" if toxic else "clean", text))
    return spark.createDataFrame(out, "row_id long, split string, label string, text string")


def test_judge(spark, rows, tmp_path):
    judge = Judge.train(rows)
    found = judge.judge(rows).join(rows, "row_id").where("split = 'test'").toPandas()
    assert ((found.label == "toxic") == ~found.safe).mean() > 0.97
    judge.save(str(tmp_path / "model"))
    again = Judge.load(spark, str(tmp_path / "model"))
    assert sorted(map(tuple, again.judge(rows).collect())) == sorted(map(tuple, judge.judge(rows.repartition(7)).collect()))
    rows.write.parquet(str(tmp_path / "in"))
    stream = again.judge(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("judged").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("judged").collect())) == sorted(map(tuple, judge.judge(rows).collect()))
    extra = spark.createDataFrame([(1, "you are such a muppet"), (2, ""), (3, None)], "row_id long, text string")
    assert {r["row_id"] for r in judge.judge_with_rules(extra).collect()} == {1, 2}
    with pytest.raises(NotReady):
        Judge.train(rows.where("label = 'clean'"))


def test_scaled_edges(spark):
    frame = spark.createDataFrame([(999,), (1000,), (1001,), (-99999,), (99999,)], "raw long")
    got = [r[0] for r in frame.select(L.scaled(F.col("raw"), F.lit(1000), F.lit(10000))).collect()]
    assert got == [49, 50, 50, 0, 100]


def test_running_and_ranks(spark):
    values = [random.Random(k).randrange(50) for k in range(500)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long").repartition(6)
    got = running(frame, [F.col("v"), F.col("k")], total=F.col("v")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [r["v"] for r in got] == sorted(values) and got[-1]["total"] == sum(values)
    assert {r["percent"]: r["value"] for r in nearest_rank(frame, "v", (50, 95), 500).collect()} == {50: sorted(values)[249], 95: sorted(values)[474]}


def test_escapes(spark):
    texts = ["a\tb", "back\\slash", "\\t", "line\nend\r", "\\\\n", "plain", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(X.unescape(X.escape(F.col("t")))).collect()] == texts
    assert frame.select(X.unescape(F.lit("\\q\\"))).first()[0] == "\\q\\"


def test_hash_split_examples(spark):
    rows = [("you are an idiot", "development"), ("message 1", "validation"), ("message 14", "test")]
    from quellmark.operators.dedupe import hash_split

    frame = spark.createDataFrame(rows, "t string, want string")
    got = frame.select(hash_split(X.group_hash(F.lit("EN"), X.normalize_text(F.col("t")))), "want").collect()
    assert all(a == b for a, b in got)


def test_views_and_tokens(spark):
    frame = spark.createDataFrame([("1d10t",), ("101",), ("word",)], "t string")
    assert [r[0] for r in frame.select(X.unleet(F.col("t"))).collect()] == ["idiot", "101", "word"]
    assert quote_ranges('a "b" c') == [(2, 5)] and quote_ranges('open "b') == []
    assert quote_ranges("„a“ “b” «c» »d« 「e」") == [(0, 3), (4, 7), (8, 11)] and quote_ranges("«a «b»") == [(3, 6)]
    assert quote_ranges("»a« «b» 「c」 『d』", RULE_QUOTES) == [(0, 3), (4, 7), (8, 11), (12, 15)]
    assert quote_ranges('«a "b" c»', RULE_QUOTES) == [(3, 6), (0, 9)] and quote_ranges("«a «b»", RULE_QUOTES) == [(0, 6)]
    assert [(t[0], t[3], t[4], t[5]) for t in tokens("Hi @you, all. Bye")] == [("hi", 0, 0, False), ("you", 0, 0, True), ("all", 0, 1, False), ("bye", 1, 2, False)]


def test_lexicon_views(spark):
    lexicon = spark.createDataFrame([("a", "Murmelkopf"), ("b", "idiot"), ("c", "Möhre"), ("d", "alter Hut"), (None, "x")], "id string, lemma string")
    texts = ["ein murmelkopf", "ein Μurmelkоpf", "murmel\u200bkopf, mur\u00admelkopf", "du 1d10t", "i.d.i.o.t!", "Mo\u0308hre alter  Hut", "Murmelkopfs", "", None]
    found = view_matches(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), lexicon).collect()
    assert sorted(map(tuple, found)) == [
        (0, "a", "Normalized", 4, 14), (1, "a", "Confusable", 4, 14), (2, "a", "Confusable", 0, 11), (2, "a", "Confusable", 13, 24), (3, "b", "Evasion", 3, 8),
        (4, "b", "Evasion", 0, 9), (5, "c", "Normalized", 0, 6), (5, "d", "Normalized", 7, 17)]


def test_lookalike_lemmas_match_plain_texts():
    from quellmark.operators.lexicon import lookups, matches

    tables = lookups([("a", "murmеl"), ("b", "zwei wörter"), ("c", "x")])  # the first has a Cyrillic letter
    assert matches("a murmel", tables) == [("a", "Confusable", 2, 8)] and matches("zwei  W\u00f6rter", tables) == [("b", "Normalized", 0, 12)]
    assert matches("zw\u200bei w0rt3r", tables) == [] and matches("m u r m \u0435 l", tables) == [("a", "Evasion", 0, 11)] and matches("", tables) == []


def test_hindi_joiners(spark):
    texts = ["क्\u200dष", "क\u200d क", "a\u200db", "\u200dक", "क\u200cख a1"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(X.hindi_words(F.col("t"))).collect()] == [["क्\u200dष"], ["क", "क"], ["a", "b"], ["क"], ["क\u200cख", "a1"]]


def test_verdict_line(spark):
    line = spark.range(1).select(sinks.verdict_line(F.lit(True), F.lit(0.0), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0]
    assert line == '{"safe":true,"score":0.0,"locale":null,"grawlix":null}'


def test_median_of_runs():
    import time

    waits = iter([0.0, 0.05, 0.001])
    assert median_seconds(lambda: time.sleep(next(waits)), 3) < 0.04
    with pytest.raises(ValueError):
        median_seconds(lambda: None, 4)
