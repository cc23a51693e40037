"""Every importer on a small file of its format: what it gives, and what it refuses."""

import json

import pytest

from quellmark.sources import importers as I
from quellmark.sources import sinks as K


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def fails(make, said):
    with pytest.raises(Exception, match=said):
        make().collect()


def test_corpus(spark, tmp_path):
    good = put(tmp_path / "a.tsv", "split\tlabel\ttext\ndevelopment\tclean\ta\\tb \\\\ \"q\n\ntest\ttoxic\t  x\\\\n\\q\\\n")
    assert got(I.corpus(spark, good)) == [("development", "clean", 'a\tb \\ "q'), ("test", "toxic", "  x\\n\\q\\")]
    for name, text, said in (
        ("b", "split\ttext\tlabel\ndevelopment\tclean\tx\n", "header"), ("c", "split\tlabel\ttext\ndevelopment\tclean\n", "MALFORMED"),
        ("d", "split\tlabel\ttext\ndevelopment\tclean\tx\ty\n", "MALFORMED"), ("e", "split\tlabel\ttext\ndev\tclean\tx\n", "unknown split"),
        ("f", "split\tlabel\ttext\ntest\tok\tx\n", "unknown label"), ("g", "split\tlabel\ttext\ntest\tclean\tx\ry\n", "carriage return"),
    ):
        fails(lambda: I.corpus(spark, put(tmp_path / name, text)), said)


def test_corpus_writer_round_trip(spark, tmp_path):
    rows = [("test", "clean", t) for t in ["b", "a\tb\nc\r", ' "quoted" ', "\\", "", "ä", "é", "Z"]]
    frame = spark.createDataFrame(rows, "split string, label string, text string")
    path = str(tmp_path / "out")
    K.write_corpus(frame.repartition(3), path)
    assert got(I.corpus(spark, path)) == sorted(rows)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n")[1:] if x]
    assert lines == sorted(lines, key=str.encode) and len(lines) == len(rows)
    with pytest.raises(Exception, match="exists"):
        K.write_corpus(frame, path)


def test_lexicon(spark, tmp_path):
    head = "\t".join(I.LEXICON) + "\n"
    good = put(tmp_path / "a", head + " DE00001 \tn\tan\tyes\t murmel kopf \tConservative\n")
    assert got(I.lexicon(spark, good, "de")) == [("DE00001", "DE", "n", "an", True, "murmel kopf", "conservative")]
    for k, (line, said) in enumerate((("FR1\tn\tan\tno\tx\tinclusive", "another language"), ("DE1\tn\tan\tmaybe\tx\tinclusive", "yes or no"), ("DE1\tn\tan\tno\tx\thigh", "unknown level"))):
        fails(lambda: I.lexicon(spark, put(tmp_path / f"b{k}", head + line + "\n"), "DE"), said)
    fails(lambda: I.lexicon(spark, put(tmp_path / "c", head + "DE1\tn\tan\tno\tx\tinclusive\nDE1\tn\tan\tno\ty\tinclusive\n"), "DE"), "repeated id")


def test_pairs(spark, tmp_path):
    head = "\t".join(I.PAIRS) + "\n"
    good = put(tmp_path / "a", head + 'a1\ten\t1\t"two\nlines ""so"""\na2\ten\t0\tplain\n')
    assert got(I.pairs_tsv(spark, good)) == [("a1", 'two\nlines "so"', "toxic", None), ("a2", "plain", "clean", None)]
    fails(lambda: I.pairs_tsv(spark, put(tmp_path / "b", head + "a1\ten\t2\tx\n")), "0 or 1")
    fails(lambda: I.pairs_tsv(spark, put(tmp_path / "c", head + "a1\ten\t1\tx\na1\ten\t0\ty\n")), "repeated source_id")
    fails(lambda: I.pairs_tsv(spark, put(tmp_path / "d", head + " \ten\t1\tx\n")), "blank source_id")
    assert got(I.pairs_tsv(spark, put(tmp_path / "e", head))) == []


def test_pages(spark, tmp_path):
    def page(name, total, *rows):
        return put(tmp_path / name, json.dumps({"num_rows_total": total, "rows": [{"row_idx": i, "row": {"text": t, "toxic": x}} for i, t, x in rows]}, indent=1))

    assert got(I.pages_json(spark, page("a", 3, (0, "x", 1), (2, "y", 0)), "d@1/en")) == [("d@1/en/000000", "x", "toxic", None), ("d@1/en/000002", "y", "clean", None)]
    fails(lambda: I.pages_json(spark, page("b", 2, (2, "x", 1)), "d"), "beyond num_rows_total")
    fails(lambda: I.pages_json(spark, page("c", 3, (1, "x", 1), (1, "y", 0)), "d"), "repeated row_idx")
    fails(lambda: I.pages_json(spark, page("d", 3, (1, "x", 5)), "d"), "0 or 1")


def test_parquet(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("x", 1), ("y", 0)], "text string, toxic long").coalesce(1).write.parquet(str(tmp_path / "a"))
    assert got(I.pairs_parquet(spark, str(tmp_path / "a"), "d")) == [("d/000000", "x", "toxic", None), ("d/000001", "y", "clean", None)]
    spark.createDataFrame([("x", 1, 2)], "text string, toxic long, more long").write.parquet(str(tmp_path / "b"))
    fails(lambda: I.pairs_parquet(spark, str(tmp_path / "b"), "d"), "columns are not")
    monkeypatch.setattr(I, "PARQUET_ROWS", 1)
    fails(lambda: I.pairs_parquet(spark, str(tmp_path / "a"), "d"), "more than 1 rows")


def test_coarse_fine(spark, tmp_path):
    good = put(tmp_path / "a", 'says "so\tOTHER\tOTHER\n\nx\tOFFENSE\tABUSE\n')
    assert got(I.coarse_fine(spark, good, "d")) == [("d/000000", 'says "so', "clean", None), ("d/000002", "x", "toxic", None)]
    fails(lambda: I.coarse_fine(spark, put(tmp_path / "b", "x\tOFFENSE\tOTHER\n"), "d"), "illegal pair")
    fails(lambda: I.coarse_fine(spark, put(tmp_path / "c", "x\tOTHER\n"), "d"), "three columns")


def test_flags(spark, tmp_path):
    head = ",".join(I.FLAGS) + "\n"
    line = lambda text, *ones: f"{text}," + ",".join("1" if k in ones else "0" for k in range(12)) + "\n"
    found = I.flags(spark, put(tmp_path / "a", head + line('"a, b"', 0) + line("c", 1, 5) + line("d") + line("e", 7)), "d")
    assert [(r["text"], r["label"]) for r in found.orderBy("text").collect()] == [("a, b", "toxic"), ("c", "toxic"), ("d", "clean"), ("e", "clean")]
    fails(lambda: I.flags(spark, put(tmp_path / "b", head + line("x", 3).replace("0,0,1", "0,0,2")), "d"), "0 or 1")


def test_codes(spark, tmp_path):
    found = I.codes(spark, put(tmp_path / "a", "document\tlabel\na\t8\nb\t7,0,7\n"), "d")
    assert sorted((r["text"], r["label"]) for r in found.collect()) == [("a", "clean"), ("b", "toxic")]
    for k, bad in enumerate(("8,1", "", "9", "x")):
        fails(lambda: I.codes(spark, put(tmp_path / f"b{k}", f"document\tlabel\na\t{bad}\n"), "d"), "illegal codes")


def test_spans(spark, tmp_path):
    found = I.spans(spark, put(tmp_path / "a", 'id,content,index_spans\n1,abc,[]\n2,"a,b","[0, 2]"\n'), "d")
    assert got(found) == [("d/1", "abc", "clean", None), ("d/2", "a,b", "toxic", None)]
    fails(lambda: I.spans(spark, put(tmp_path / "b", "id,content,index_spans\n1,abc,[3]\n"), "d"), "beyond the text")


def test_joined(spark, tmp_path):
    texts = put(tmp_path / "t", 'id\ttweet\n1\tsays "so\n2\ty\n')
    assert got(I.joined(spark, texts, put(tmp_path / "a", "1,OFF\n2,NOT\n"), "d")) == [("d/1", 'says "so', "toxic", None), ("d/2", "y", "clean", None)]
    for name, labels, said in (("b", "1,OFF\n", "missing label 2"), ("c", "1,OFF\n2,NOT\n3,OFF\n", "unused label 3"), ("e", "1,OFF\n2,ODD\n", "OFF or NOT"), ("f", "1,OFF\n1,OFF\n2,NOT\n", "repeated id")):
        fails(lambda: I.joined(spark, texts, put(tmp_path / name, labels), "d"), said)


def test_votes_and_community(spark, tmp_path):
    def vote(text, *ones):
        return f"{text}," + ",".join("1.0" if k in ones else "0.0" for k in range(18)) + ",0,0,0\n"

    found = I.votes(spark, put(tmp_path / "a", ",".join(I.VOTES) + "\n" + vote("none") + vote("one", 4) + vote("same", 0, 3) + vote("two", 0, 4)), "d")
    assert sorted((r["text"], r["label"], r["exclusion_reason"]) for r in found.collect()) == [("none", "clean", None), ("one", None, "ambiguous"), ("same", None, "ambiguous"), ("two", "toxic", None)]
    fails(lambda: I.votes(spark, put(tmp_path / "b", ",".join(I.VOTES) + "\n" + vote("x", 1).replace("1.0", "3")), "d"), "0 or 1")
    head = "native_id\tlabel\ttext\n"
    assert got(I.community(spark, put(tmp_path / "c", head + "n1\ttoxic\tx\nn2\tclean\t\n"), "f")) == [("f/n1", "x", "toxic", None), ("f/n2", "", "clean", "empty_text")]
    fails(lambda: I.community(spark, put(tmp_path / "d", head + "n1\tunsure\tx\n"), "f"), "clean or toxic")


def test_parallel(spark, tmp_path):
    texts = put(tmp_path / "t", "a\n\nc\n")
    assert got(I.parallel(spark, texts, put(tmp_path / "l", "EN\nDE\nFR\n"))) == [(0, "a", "EN"), (1, "", "DE"), (2, "c", "FR")]
    fails(lambda: I.parallel(spark, texts, put(tmp_path / "m", "EN\nDE\n")), "one file only")
    fails(lambda: I.parallel(spark, texts, put(tmp_path / "n", "EN\n \nFR\n")), "empty label")


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for name in "ab":
        put(tmp_path / name, "".join(f"{name}{k}\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        found = got(I._lines(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(k, f"{'ab'[k // 3000]}{k % 3000}") for k in range(6000)]


def test_canonical_json():
    value = {"b": [1, 1.0, 1e21, 1.5e-7, 0.000001, 123456789.25, -0.0], "a": {"\u20ac": None, "\r": True, "\U0001f600": "\"\n\u00e9"}}
    assert K.canonical_json(value).decode() == '{"a":{"\\r":true,"\u20ac":null,"\U0001f600":"\\"\\n\u00e9"},"b":[1,1,1e+21,1.5e-7,0.000001,123456789.25,0]}'
    with pytest.raises(I.Refused):
        K.canonical_json([float("nan")])


def test_publication(spark, tmp_path):
    types = {"acquired_at_unix_seconds": "long", "upstream_lineage": "array<string>"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in K.PROVENANCE)

    def row(split, label, status="included"):
        given = {"acquired_at_unix_seconds": 7, "upstream_lineage": ["a", "b"], "detector_split": split, "detector_label": label, "inclusion_status": status, "exclusion_reason": None if status == "included" else "duplicate", "dataset": "d"}
        return tuple(given.get(c, "x\ty") for c in K.PROVENANCE)

    provenance = spark.createDataFrame([row("test", "clean"), row("test", "toxic"), row(None, None, "excluded")], schema)
    prepared = spark.createDataFrame([("EN", "clean", "s1", "a\nb")], "detector_language string, label string, source_id string, text string")
    path = str(tmp_path / "out")
    found = K.write_prepared(prepared, provenance, path)
    assert found["counts"] == {"development": 0, "validation": 0, "test": 2, "duplicates": 1, "conflicts": 0, "excluded": 1}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]
    lines = next((tmp_path / "out/provenance").glob("part-*")).read_text().split("\n")
    assert lines[0].split("\t") == K.PROVENANCE and len(lines[1].split("\t")) == 27 and '["a","b"]' in lines[1]
    fails(lambda: K.write_prepared(prepared, provenance, path), "exists")
    fails(lambda: K.write_prepared(prepared, provenance.where("detector_label = 'clean'"), path + "2"), "both labels")
    listed = spark.createDataFrame([("prepared/none", "00", 1)], "path string, sha256 string, length long")
    problems = {r["problem"] for r in K.verify_files(listed, path).collect()}
    assert problems == {"missing", "not listed"}
