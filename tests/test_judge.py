"""Verdicts: routing, fusion, masks, locales, and what fails open."""

import random

import numpy as np
import pytest

from quellmark.api import NotReady
from quellmark.functions.features import BINS, word_bin
from quellmark.judge import MessageJudge, Model, chosen, lines
from quellmark.operators import language as L
from quellmark.operators.masking import masked

TALK = {
    "DE": "der die das und ist nicht ein wir haben gestern über schöne bücher gesprochen während draußen niemand wartete",
    "EN": "the and is not what we talked about yesterday while nobody was waiting outside with their lovely new books",
}


@pytest.fixture(scope="module")
def profiles(spark):
    rng = random.Random(1)
    taught = [(f"t{k}{lang}", lang, " ".join(rng.choice(talk.split()) for _ in range(12))) for k in range(60) for lang, talk in TALK.items()]
    return L.fit(spark.createDataFrame(taught, "key string, lang string, text string"))


@pytest.fixture(scope="module")
def models():
    weights = np.zeros(BINS, np.int64)
    weights[word_bin("grumpf")] = 100
    return {"EN": Model(weights, 0, 60, 80), "DE": Model(np.zeros(BINS, np.int64), 0, 1, 1), "ES": Model(weights, 10, 60, 80, "spanish")}


def test_model_scores(models):
    assert models["EN"].scores(["", "grumpf", "Grumpf grumpf", "other"]).tolist() == [12, 75, 75, 12]


def test_verdicts(profiles, models):
    judge = MessageJudge(models, profiles, lexicons={"EN": [("e1", "murmel kopf")], "DE": [("d1", "murmelkopf")]}, grawlix=True)
    end = " while nobody was waiting outside with their lovely new books"
    cases = [
        ("grumpf" + end, (False, 0.75, "EN", None)), ("we talked about books" + end, (True, 0.12, "EN", None)), ("", (True, 0.0, None, None)), ("zzz qqq", (True, 0.0, None, None)),
        ("you fool" + end, (False, 0.70, "EN", "@#$ &!@#" + end)), ('we talked about "you fool grumpf"' + end, (True, 0.49, "EN", None)),
        ("the Murmel Kopf" + end, (True, 0.30, "EN", None)), ("what we talked about yesterday is not the murmel kopf. you fool." + end, (False, 0.70, "EN", "what we talked about yesterday is not the @#$%&! #$%&. @#$ &!@#." + end)),
        ("wir haben gestern über schöne bücher gesprochen während draußen niemand wartete", (True, 0.0, "DE", None)),
    ]
    got = judge.verdicts([text for text, _ in cases])
    for (text, want), found in zip(cases, got):
        assert found[:3] == want[:3] and (want[3] is None or found[3] == want[3]), (text, found)


def test_masks():
    assert masked("ab cd ef", [(0, 5), (3, 5), (6, 8)]) == "@# %& @#" and masked("abc", [(1, 9)]) == "a@#" and masked("abcd", [(0, 2), (2, 4)]) == "@#$%" and masked("x", []) == "x"


def test_without_detection_the_worst_locale_counts(models):
    judge = MessageJudge(models, detect=False)
    assert judge.loaded == ["EN", "ES", "DE"]
    assert judge.verdicts(["grumpf"])[0] == (False, 0.81, "ES", None)
    assert MessageJudge({c: models["EN"] for c in ("EN", "DE")}, detect=False).verdicts(["grumpf"])[0][2] == "DE"


def test_locales(models, profiles):
    there = ["EN", "DE", "ID"]
    assert chosen(" de, EN,de", there) == ["EN", "DE"] and chosen(["ms"], there) == ["ID"] and chosen("all", there) == ["EN", "ID", "DE"]
    for bad in ("xx", "FR", "all,en", ["all", "en"]):
        with pytest.raises(ValueError):
            chosen(bad, there)
    only = MessageJudge(models, profiles, locales="de")
    assert only.verdicts(["grumpf while nobody was waiting outside with their lovely new books"])[0] == (True, 0.0, None, None)
    with pytest.raises(ValueError):
        MessageJudge(models)


def test_tables_streams_and_closing(spark, models, profiles, tmp_path):
    judge = MessageJudge(models, profiles)
    end = " while nobody was waiting outside with their lovely new books"
    frame = spark.createDataFrame([(1, "grumpf" + end, "a"), (1, "grumpf" + end, "a"), (2, None, "b"), (3, "", "c")], "row_id long, text string, judge string")
    found = judge.judge(frame)
    assert [(r["row_id"], r["judgement"]["safe"], r["judgement"]["locale"]) for r in found.orderBy("row_id").collect()] == [(1, False, "EN"), (1, False, "EN"), (2, True, None), (3, True, None)]
    assert lines(found).where("row_id = 1").first()["line"] == '{"safe":false,"score":0.75,"locale":"EN","grawlix":null}'
    assert judge.judge(frame.limit(0)).collect() == []
    frame.write.parquet(str(tmp_path / "in"))
    stream = judge.judge(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("judged_messages").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("judged_messages").count() == 4
    judge.close()
    assert not judge.ready() and judge.verdicts(["grumpf"]) == [(True, 0.0, None, None)]
    with pytest.raises(NotReady):
        judge.judge(frame)
