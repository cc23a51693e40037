"""Problems 6 to 10: against plain versions, on edge cases and on held-out or simulated data."""

import random
import re

import numpy as np
import pytest

from quellmark.llm import p06_lookalikes as P6
from quellmark.llm import p07_languages as P7
from quellmark.llm import p08_packing as P8
from quellmark.llm import p09_leakage as P9
from quellmark.llm import p10_truncation as P10
from quellmark.llm.forms import words

SAME = [("murmelkopf", "murmel​kopf"), ("Größe", "Größe"), ("Ｂａｒ", "Bar"), ("bar baz", "bar baz"), ("сосед", "coceд"), ("ﬁsch", "fisch"), ("filz", "fі­lz"), ("إلى", "إلى"), ("ö", "ӧ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_one_form(a, b):
    assert P6.one_form(a) == P6.one_form(b) == P6.one_form(P6.one_form(b))


@pytest.mark.parametrize(("a", "b"), [("Kopf", "kopf"), ("uber", "über"), ("a  b", "a b"), ("l", "1")])
def test_visible_differences_stay(a, b):
    assert P6.one_form(a) != P6.one_form(b)


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setitem(P6.LOOKALIKES, "а", "b")
    with pytest.raises(ValueError):
        P6._characters()


def test_lookalike_pairs(spark):
    rows = [(k, t, "x") for k, t in enumerate(["bar", "Ｂar", "bаr", "bar", "b​ar", None, "", "​", "other " * 20_000])] + [(None, "bar", "x")]
    frame = spark.createDataFrame(rows, "key long, text string, looks string")
    assert {tuple(r) for r in P6.lookalike_pairs(frame).collect()} == {(0, 2), (2, 3), (0, 4), (3, 4), (2, 4), (6, 7)}
    assert P6.lookalike_pairs(frame.limit(0)).collect() == []


TALK = {
    "DE": "der die das und ist nicht ein wir haben gestern über schöne bücher gesprochen während draußen niemand wartete",
    "EN": "the and is not what we talked about yesterday while nobody was waiting outside with their lovely new books",
    "ES": "el la los y no es que hablamos ayer sobre libros hermosos mientras nadie esperaba afuera con nosotros",
    "RU": "мы вчера говорили о хороших книгах пока никто не ждал на улице и было очень тихо потом",
}


def talk(lang, rng, n=14):
    ws = TALK[lang].split()
    return " ".join(rng.choice(ws) for _ in range(n))


def test_languages_of_mixed_texts(spark):
    rng = random.Random(4)
    labelled = [(f"k{i}", lang.lower() if i % 9 else "xx", talk(lang, rng), 1) for i in range(150) for lang in TALK]
    profiles = P7.fit(spark.createDataFrame(labelled, "key string, code string, text string, lang int"), 400)
    rows, want = [], {}
    for i in range(120):
        langs = rng.sample(list(TALK), rng.choice([1, 1, 2]))
        rows.append((f"m{i}", " \n".join(talk(x, rng) for x in langs)))
        want[f"m{i}"] = set(langs)
    edges = [("empty", ""), ("none", None), (None, "the and is"), ("marks", "@you #tag https://a.b 123 !?"), ("long", talk("DE", rng, 20_000))]
    found = P7.segment_languages(spark.createDataFrame(rows + edges, "key string, text string"), profiles, True).toPandas()
    assert found.confidence.between(0, 1).all()
    got = found.groupby("key").lang.agg(set).to_dict()
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert set(got) - set(want) == {"long"} and got["long"] == {"DE"}
    assert P7.segment_languages(spark.createDataFrame([], "key string, text string"), profiles).collect() == []


def test_ideographs_after_mentions_and_short_sentences(spark):
    assert P7.tokens("我们问@nixqua6822为什么 #tag好 @müller x https://a.b/c看这里") == list("我们问为什么好") + ["x"] + list("看这里")
    rng = random.Random(9)
    chinese = "我们昨天晚上和朋友一起谈论了那些很有意思的新书当时外面没有人在等也非常安静"
    labelled = [(f"k{i}{lang}", lang, talk(lang, rng)) for i in range(60) for lang in TALK] + [(f"z{i}", "ZH", "".join(rng.sample(chinese, 20))) for i in range(60)]
    profiles = P7.fit(spark.createDataFrame(labelled, "key string, code string, text string"))
    rows = [
        ("mention", "@nixqua6822" + chinese[:20] + "。", {"ZH"}), ("mixed", talk("EN", rng) + ". 我们问@dorbim_398" + chinese[2:22] + "!", {"EN", "ZH"}),
        ("short", talk("DE", rng) + ". Nobody was waiting outside yesterday.", {"DE", "EN"}), ("name", talk("DE", rng) + ". Outside!", {"DE"}),
    ]
    found = P7.segment_languages(spark.createDataFrame([r[:2] for r in rows], "key string, text string"), profiles, True).toPandas()
    assert found.groupby("key").lang.agg(set).to_dict() == {k: langs for k, _, langs in rows}


def test_products_are_the_vectors_products():
    profiles = P7.Profiles([["der", "die"], ["the", "and"]], [1, 2])
    scores, count = profiles.scores(["derand"])
    grams, _ = P7._trigrams(["derand"])
    whole = P7._vectors(grams).astype(np.float32).sum(0) @ profiles.prototypes
    assert count[0] == len(grams) and np.allclose(scores[0], whole, atol=1e-2)


def test_cosines_of_bundled_segments(monkeypatch):
    profiles = P7.Profiles([["der", "die", "das"], ["the", "and", "they"]], [1, 2])
    words, codes, cut = np.array(["der", "and", "they", "das"], dtype=object), np.array([0, 3, 0, 1, 2, 2, 1, 2, 0, 3, 3]), np.array([0, 3, 8])
    want = []
    for a, b in ((0, 3), (3, 8), (8, 11)):
        vector = sum(P7._vectors(P7._trigrams([words[c]])[0]).astype(float).sum(0) for c in codes[a:b])
        want.append(vector @ profiles.prototypes / np.linalg.norm(vector))
    for block in (2, 4, 30_000):
        monkeypatch.setattr(P7, "BLOCK", block)
        assert np.allclose(P7.cosines(words, codes, cut, profiles.prototypes), want, atol=1e-4)
    long = P7.cosines(words, np.zeros(70_000, int), np.array([0]), profiles.prototypes)
    assert np.allclose(long, P7.cosines(words, np.zeros(1, int), np.array([0]), profiles.prototypes), atol=1e-4)


def test_codes(spark):
    rows = [("de-AT", "DE"), (" en ", "EN"), ("xx", None), ("?", None), ("", None), (None, None), ("UND", None), ("zh_CN", "ZH")]
    frame = spark.createDataFrame(rows, "code string, want string")
    assert [r[0] == r[1] or r[0] is r[1] for r in frame.select(P7.named(frame["code"]), "want").collect()] == [True] * len(rows)


def plain_best_fit(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


@pytest.mark.parametrize("capacity", [7, 100, 512])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    rows = [(k, rng.choice([0, 1, 3, rng.randrange(1, 90), rng.randrange(1, 1500)]), "x") for k in range(400)] + [(5000, 77, "x")] * 3 + [(None, 5, "x"), (7000, None, "x")]
    sizes = spark.createDataFrame(rows, "doc_id long, tokens long, part string").where("doc_id is not null and tokens is not null")
    targets = spark.createDataFrame([("t", capacity), ("t", capacity + 99), ("none", 0), (None, 9)], "target_name string, capacity_tokens int")
    found = P8.pack(sizes, targets).toPandas()
    used = found[found.tokens > 0].groupby("container_id").tokens.sum()
    assert used.max() <= capacity and set(found.target_name) == {"t"}
    totals = found.groupby("doc_id").tokens.sum()
    assert all(totals[d] == n * (3 if d == 5000 else 1) for d, n, _ in rows if d is not None and n is not None)
    assert all(len(g) == max(1, -(-n // capacity)) for d, n, _ in rows[:400] for g in [found[found.doc_id == d]])
    assert len(used) == plain_best_fit([t for t in found.tokens if t], capacity)
    assert P8.pack(sizes.limit(0), targets).collect() == []


def test_every_target_is_packed(spark):
    sizes = spark.createDataFrame([(k, 5) for k in range(4)], "doc_id long, tokens long")
    targets = spark.createDataFrame([(f"t{k}", 10) for k in range(1500)], "target_name string, capacity_tokens int")
    found = P8.pack(sizes, targets).toPandas()
    assert found.target_name.nunique() == 1500 and len(found) == 6000 and found.container_id.max() == 1


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (None, "x", 9)], "doc_id long, text string, tokens int")
    assert {r["doc_id"]: r["tokens"] for r in P8.token_counts(frame).collect()} == {1: len(P8.encoder().encode_ordinary("hello world")), 2: 0}


def test_leaks_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(P9, "SHARD", 500)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 10, 30]))), 1) for k in range(30)] + [(100, None, 1), (101, "", 1)]
    docs = []
    for k in range(60):
        text = [rng.choice([*vocabulary, "out"]) for _ in range(rng.randrange(120))]
        part = items[rng.randrange(30)][1].split()
        cut = rng.choice([8, 9, 10, 11, 30])
        text[len(text) // 2 : len(text) // 2] = part[:cut]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(text).upper(), 1))
    docs += [(500, None, 1), (501, "", 1), (502, docs[0][1], 1), (502, docs[0][1], 1)]
    want = set()
    for i, t, _ in items:
        ws = words(t)
        grams = {tuple(ws[k : k + 10]) for k in range(len(ws) - 9)}
        for d, x, _ in docs:
            ys = words(x)
            if any(tuple(ys[k : k + 10]) in grams for k in range(len(ys) - 9)):
                want.add((i, d))
    frames = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, doc_id int")
    found = [tuple(r) for r in P9.leaks(*frames).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert P9.leaks(frames[0].limit(0), frames[1]).collect() == [] and P9.leaks(frames[0], frames[1].limit(0)).collect() == []
    spans = P9.removal_spans(*frames).where("doc_id < 500").collect()
    assert {r["doc_id"] for r in spans} == {d for _, d in want if d < 500} and all(r["end_word"] - r["first_word"] >= 10 for r in spans)


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 3000), 0)
    index = P9.FMIndex(text, 3)
    phrases = np.array([text[k : k + 5] for k in range(0, 2900, 97)])
    which, low, high = index.search(phrases)
    assert len(which) == len(phrases)
    for p, a, b in zip(phrases[which], low, high):
        want = [k for k in range(len(text) - 5) if (text[k : k + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_truncation(spark):
    rng = random.Random(8)
    ws = "the garden report was moved by our neighbour before lunch and nobody in the room asked why it happened".split()
    rows, cut = [], set()
    for k in range(400):
        body = " ".join(" ".join(rng.choice(ws) for _ in range(8)) + rng.choice(".!?") for _ in range(6))
        if k % 8 == 0:
            body = body[: rng.randrange(60, 110)].rstrip(".!? ") + rng.choice(["", "&#82", "�"])
            cut.add(k)
        elif k % 8 == 1:
            body += rng.choice([" #tag", " https://a.example/t/1", " \U0001f642", ' ("Ann")', "\n-- Ann, the host", "  \n"])
        rows.append((k, body, "s1" if k % 2 else "s2", "x"))
    rows += [(900, "", "s1", "x"), (901, None, "s1", "x"), (None, "cut of", "s1", "x"), (902, "the garden report was mo", None, "x"), (0, rows[0][1], "s2", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, line string")
    found = P10.truncation(frame).toPandas()
    assert set(found[found.cut].doc_id) == cut | {902} and len(found) == 403
    assert P10.truncation(frame.limit(0)).collect() == []
    assert set(found[found.cut].decided_by) <= {"trigram", "endings", "ending", "rare ending"} and (found[found.decided_by == "trigram"].inside > 0).all()
    assert re.match(r"\S+\s", found.final_trigram[0])


def test_truncation_of_copies(spark):
    rng = random.Random(12)
    ws = "the garden report was moved by our neighbour before lunch and nobody in the room asked why it happened".split()
    whole = [(k, " ".join(" ".join(rng.choice(ws) for _ in range(8)) + "." for _ in range(6)), "s1") for k in range(400)]
    ends = [(500 + k, whole[k][1] + " we asked", "s1") for k in range(8)]
    copies = [(1000 + k, whole[9][1] + " our neighbour", "s1") for k in range(204)]
    words = [(2000, "word " * 60 + "a" * 300 + " " + "b" * 300 + " the", "s1")]
    found = P10.truncation(spark.createDataFrame(whole + ends + copies + words, "doc_id long, text string, source string")).toPandas()
    assert set(found[found.cut].doc_id) >= {d for d, *_ in ends + copies} and not set(found[found.cut].doc_id) & {d for d, *_ in whole}
    assert found[found.doc_id == 2000].final_trigram.item() == "a" * 300 + " " + "b" * 300 + " the"
    assert set(found[found.doc_id.between(1000, 1999)].terminal) == {1}
