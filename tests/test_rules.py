"""Paired messages: what a rule must judge, and controls that it must not; edges of frames, packs and texts."""

import pytest

from quellmark.operators import rules as R
from quellmark.operators.rule_pack import MESSAGES, default_pack

PACKS = R.packs(default_pack())


def found(text, lang="EN", reply=False, pack=None):
    return R.analyze(text, pack or PACKS[lang], reply)


@pytest.mark.parametrize(("lang", "text", "want"), [m[1:] for m in MESSAGES])
def test_messages(lang, text, want):
    got = found(text, lang)
    words = (want or "").split()
    names = [w.replace("implicit_", "") for w in words if w.replace("implicit_", "") in R.POINTS]
    assert [e.event for e in got if e.suppressor is None or len(words) == 2 and words[1] == e.suppressor] == names
    if len(words) == 2 and words[1] not in R.POINTS:
        assert {e.suppressor for e in got} == {words[1]}


def test_places_are_characters_of_the_text():
    text = "Oh, I will not ever hit YOU."
    (event,) = found(text)
    assert text[event.raw_first : event.raw_last] == "hit YOU" or text[event.raw_first : event.raw_last] == "will not ever hit YOU"
    assert text[event.by_raw_first : event.by_raw_last] == "not" and event.suppressor == "negated"
    text = "他说 你是 笨蛋。"
    (event,) = found(text, "ZH")
    assert text[event.raw_first : event.raw_last] == "你是 笨蛋" and text[event.by_raw_first : event.by_raw_last] == "他说"


def test_gaps_and_clauses():
    assert [e.event for e in found("I will surely hit you")] == ["threat"]
    assert found("I will most certainly hit you") == [] and found("I will. Hit the gong") == []
    assert found("You are, by all accounts of them, a fool") == [] and [e.event for e in found("fool you")] == []
    assert [e.event for e in found("hope but you fall")] == [] and found("I hope the others fall while you watch") == []


def test_reply_stands_for_a_target():
    assert found("a fool") == [] and [e.event for e in found("a fool", reply=True)] == ["insult"]
    assert [e.event for e in found("I will punch", reply=True)] == ["threat"] and found("punch", reply=True) == []


def test_negators_keep_to_clause_and_scope():
    assert found("no, you are a fool")[0].suppressor is None and found("you are no fool")[0].suppressor == "negated"
    assert found("no. you fool")[0].suppressor is None


def test_compact_targets():
    assert [e.event for e in found("打你", "ZH")] == ["threat"] and found("打你的门", "ZH") == []
    assert [e.event for e in found("我要打,你", "ZH")] == ["threat"] and found("打你?", "ZH") == []


def test_packs():
    with pytest.raises(ValueError):
        R.Pack("EN", [("odd role", "x")])
    own = R.Pack("EN", [("insult", "Noodle Head"), ("insult", "noodle head"), ("target", "you"), ("target", " ")])
    assert [e.event for e in found("you NOODLE head", pack=own)] == ["insult"]


def test_listed_threats():
    pack = R.Pack("ES", [("harm", "pegar"), ("benign", "pegar el papel"), ("target", "te"), ("target", "usted"), ("intent", "voy a")])
    assert R.listed_threats("te voy a pegar", pack) == [(3, 4)] and R.listed_threats("te voy a pegar el papel", pack) == []
    assert R.listed_threats("pegar a usted", pack) == [(0, 1)] and R.listed_threats("te gusta pegar", pack) == []
    assert R.listed_threats("", pack) == []


def test_tables(spark):
    rows = [(1, "EN", "you fool", "x"), (1, "EN", "you fool", "x"), (2, "EN", None, "x"), (3, None, "you fool", "x"), (4, "XX", "you fool", "x"), (5, "EN", "", "x"), (None, "EN", "you fool", "x"), (6, "EN", "you are a fool. " * 4000, "x")]
    frame = spark.createDataFrame(rows, "row_id long, lang string, text string, event string")
    counts = {r["row_id"]: r["count"] for r in R.events(frame).groupBy("row_id").count().collect()}
    assert counts == {1: 2, 6: 4000}
    assert R.events(frame.limit(0)).collect() == [] and R.scored(R.events(frame)).where("row_id = 6").first()["rule"] == 70
    assert R.phrase_hits(frame).where("row_id = 1").count() == 4 and R.propositions(frame).where("row_id = 1").count() == 2
    frames = R.harm_frames(spark.createDataFrame([(1, "EN", "Will you go? I will hit you")], "row_id long, lang string, text string"))
    assert [tuple(r) for r in frames.collect()] == [(1, 5, 4, 6)]


def test_long_texts_cost_in_proportion():
    import time

    begun = time.process_time()
    assert len(found("you fool " * 30_000)) == 1
    assert time.process_time() - begun < 20
