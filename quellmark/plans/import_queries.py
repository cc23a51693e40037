"""Importers and writers over whole tables: each table is written in the format's files, read back and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellmark.runtime import Workspace, table
from quellmark.sources import importers as I
from quellmark.sources import sinks as K

_QUOTED = {"quote": '"', "escape": '"', "quoteAll": True, "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
#: One-line texts for the formats that can't hold breaks.
_FLAT = "translate(text, chr(9) || chr(10) || chr(13), '   ')"


def _rows(s, d) -> DataFrame:
    return table(s, d, "corpus_rows").where("row_id is not null and text is not null and label is not null")


def _toxic() -> Column:
    return F.col("label") == "toxic"


def _folder(s, name: str) -> str:
    return Workspace(s, name).root


def _corpus(s, d):
    path = _folder(s, "corpus")
    K.write_corpus(_rows(s, d).where("split is not null"), path)
    return I.corpus(s, path)


def _lexicon(s, d):
    path = _folder(s, "lexicon")
    rows = table(s, d, "lexicon_de").where("level is not null").select(*I.LEXICON)
    rows.write.options(**{**K._RAW, "nullValue": ""}).csv(path)
    return I.lexicon(s, path, "de")


def _pairs_tsv(s, d):
    path = _folder(s, "pairs")
    rows = _rows(s, d).select("source_id", F.lit("en").alias("language"), _toxic().cast("int").alias("toxic"), "text")
    rows.write.options(sep="\t", **_QUOTED).csv(path)
    return I.pairs_tsv(s, path).select("source_id", "text", "label")


def _pages(s, d):
    """Pages of a hundred entries, one a line."""
    path = _folder(s, "pages")
    rows = _rows(s, d)
    total = rows.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("t")).scalar()
    entry = F.struct(F.col("row_id").alias("row_idx"), F.struct("text", _toxic().cast("int").alias("toxic")).alias("row"))
    pages = rows.groupBy((F.col("row_id") / 100).cast("long").alias("page")).agg(F.collect_list(entry).alias("rows"))
    pages.select(total.alias("num_rows_total"), "rows").write.json(path)
    return I.pages_json(s, path, "set@1/en", one_per_file=False).select("source_id", "text", "label")


def _parquet(s, d):
    path = _folder(s, "parquet")
    table(s, d, "eval_items").where("text is not null and label is not null").orderBy("item_id").coalesce(1).select("text", _toxic().cast("long").alias("toxic")).write.parquet(path)
    return I.pairs_parquet(s, path, "set@1/en").select("source_id", "text", "label")


def _coarse_fine(s, d):
    path = _folder(s, "coarse")
    fine = F.when(_toxic(), F.element_at(F.array(*map(F.lit, ("INSULT", "ABUSE", "PROFANITY"))), (F.col("row_id") % 3 + 1).cast("int"))).otherwise("OTHER")
    lines = _rows(s, d).orderBy("row_id").select(F.concat_ws("\t", F.expr(_FLAT), F.when(_toxic(), "OFFENSE").otherwise("OTHER"), fine))
    lines.write.text(path)
    return I.coarse_fine(s, path, "set@1").select("source_id", "text", "label")


def _flags(s, d):
    path = _folder(s, "flags")
    hate, abuse = _toxic() & (F.col("row_id") % 2 == 0), _toxic() & (F.col("row_id") % 2 == 1)
    columns = [F.col("text").alias("Tweet"), hate.cast("int").alias("HS"), abuse.cast("int").alias("Abusive"), *(F.lit(0).alias(c) for c in I.FLAGS[3:])]
    _rows(s, d).select(*columns).write.options(**_QUOTED).csv(path)
    return I.flags(s, path, "set@1").groupBy("source_id", "label").agg(F.count(F.lit(1)).alias("rows"))


def _codes(s, d):
    path = _folder(s, "codes")
    code = F.when(_toxic(), F.concat((F.col("row_id") % 8).cast("string"), F.lit(",0,"), (F.col("row_id") % 8).cast("string"))).otherwise("8")
    _rows(s, d).select(F.expr(_FLAT).alias("document"), code.alias("label")).write.options(**K._RAW).csv(path)
    return I.codes(s, path, "set@1").groupBy("source_id", "label").agg(F.count(F.lit(1)).alias("rows"))


def _spans(s, d):
    path = _folder(s, "spans")
    places = F.when(_toxic() & (F.length("text") > 0), F.concat(F.lit("[0, "), (F.length("text") - 1).cast("string"), F.lit("]"))).otherwise("[]")
    _rows(s, d).select(F.col("row_id").cast("string").alias("id"), F.col("text").alias("content"), places.alias("index_spans")).write.options(**_QUOTED).csv(path)
    return I.spans(s, path, "set@1").select("source_id", "text", "label")


def _joined(s, d):
    path = _folder(s, "joined")
    _rows(s, d).select(F.col("row_id").alias("id"), F.expr(_FLAT).alias("tweet")).write.options(**K._RAW).csv(f"{path}/texts")
    _rows(s, d).select(F.col("row_id").alias("id"), F.when(_toxic(), "OFF").otherwise("NOT").alias("label")).write.csv(f"{path}/labels")
    return I.joined(s, f"{path}/texts", f"{path}/labels", "set@1").select("source_id", "text", "label")


def _community(s, d):
    path = _folder(s, "community")
    _rows(s, d).select(F.col("row_id").alias("native_id"), "label", F.expr(_FLAT).alias("text")).write.options(**K._RAW).csv(path)
    return I.community(s, path, "file").select("source_id", "text", "label", "exclusion_reason")


def _parallel(s, d):
    path = _folder(s, "parallel")
    rows = _rows(s, d).orderBy("row_id")
    rows.select(F.expr(_FLAT)).write.text(f"{path}/texts")
    rows.select("label").write.text(f"{path}/labels")
    return I.parallel(s, f"{path}/texts", f"{path}/labels")


def _published(s, d):
    """The prepared rows as they are published, read back, with the split of their provenance."""
    path = _folder(s, "published")
    provenance = table(s, d, "provenance")
    K.write_prepared(table(s, d, "prepared_rows"), provenance, path)
    rows = I.columns(s, f"{path}/provenance", K.PROVENANCE)
    return rows.groupBy("dataset", "detector_split", "inclusion_status").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("exclusion_reason") != "").alias("with_reason"))


def _manifest_json(s, d):
    """The count maps of the manifest as canonical JSON, with its digest."""
    body, digest = K.evidence(K.manifest(table(s, d, "provenance"))["maps"]["dataset"])
    return s.createDataFrame([(body.decode(), digest)], "body string, sha256 string")


def _manifest_files(s, d):
    """A published folder against a list of its files with one digest wrong, one length wrong, one file missing and one not listed."""
    path = _folder(s, "files")
    table(s, d, "eval_items").select(F.col("suite"), F.coalesce("text", F.lit("")).alias("text")).repartition("suite").write.partitionBy("suite").text(path)
    there = s.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suite = F.regexp_extract("path", "suite=([^/]+)", 1)
    listed = there.select(F.regexp_extract("path", "(suite=.*)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"), "length", suite.alias("suite"))
    listed = listed.where("suite <> 'gold-1'").select(
        F.when(F.col("suite") == "gold-2", "suite=gold-2/none").otherwise(F.col("path")).alias("path"), F.when(F.col("suite") == "panel-1", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("suite") == "panel-2", F.col("length") + 1).otherwise(F.col("length")).alias("length"))
    return K.verify_files(listed, path).groupBy(F.regexp_extract("path", "suite=([^/]+)", 1).alias("suite"), "problem").agg(F.count(F.lit(1)).alias("files"))


def _lexicon_written(s, d):
    path = _folder(s, "lexicon-out")
    entries = table(s, d, "lexicon_de").where("level is not null and lemma is not null").dropDuplicates(["category", "lemma"])
    K.write_lexicon(entries, "de", path, {"table": "lexicon_de"})
    return I.lexicon(s, f"{path}/lexicon", "de").select("id", "category", "lemma")


QUERIES = {
    "corpus_scan": _corpus, "lexicon_scan": _lexicon, "adapter_textdetox": _pairs_tsv, "adapter_textdetox_json": _pages, "adapter_parquet": _parquet,
    "adapter_germeval": _coarse_fine, "adapter_hs_abusive": _flags, "adapter_multilabel": _codes, "adapter_span_json": _spans,
    "adapter_label_join": _joined, "adapter_community": _community, "parallel_files": _parallel, "published_provenance": _published,
    "manifest_json": _manifest_json, "manifest_files": _manifest_files, "lexicon_written": _lexicon_written,
}

_ROWS = "from corpus_rows where row_id is not null and text is not null and label is not null"
_NUMBER = "(row_number() over (order by row_id) - 1)"
SQL = {
    "corpus_scan": f"select split, label, text {_ROWS} and split is not null",
    "lexicon_scan": "select trim(id) as id, regexp_extract(id, '^[A-Za-z]+') as language, coalesce(trim(pos), chr(0)[:0]) as pos, coalesce(trim(category), chr(0)[:0]) as category, stereotype = 'yes' as stereotype, coalesce(trim(lemma), chr(0)[:0]) as lemma, lower(trim(level)) as level from lexicon_de where level is not null",
    "adapter_textdetox": f"select source_id, text, label {_ROWS}",
    "adapter_textdetox_json": f"select format('set@1/en/{{:06d}}', row_id) as source_id, text, label {_ROWS}",
    "adapter_parquet": "select format('set@1/en/{:06d}', row_number() over (order by item_id) - 1) as source_id, text, label from eval_items where text is not null and label is not null",
    "adapter_germeval": f"select format('set@1/{{:06d}}', {_NUMBER}) as source_id, {_FLAT} as text, label {_ROWS}",
    "adapter_hs_abusive": f"select 'set@1/' || substr(sha256(text), 1, 12) as source_id, label, count(*) as rows {_ROWS} group by all",
    "adapter_multilabel": f"select 'set@1/' || substr(sha256({_FLAT}), 1, 12) as source_id, label, count(*) as rows {_ROWS} group by all",
    "adapter_span_json": f"select 'set@1/' || row_id as source_id, text, case when length(text) = 0 then 'clean' else label end as label {_ROWS}",
    "adapter_label_join": f"select 'set@1/' || row_id as source_id, {_FLAT} as text, label {_ROWS}",
    "adapter_community": f"select 'file/' || row_id as source_id, {_FLAT} as text, label, case when trim({_FLAT}) = chr(0)[:0] then 'empty_text' end as exclusion_reason {_ROWS}",
    "parallel_files": f"select {_NUMBER} as line, {_FLAT} as text, label {_ROWS}",
    "published_provenance": "select coalesce(dataset, chr(0)[:0]) as dataset, coalesce(detector_split, chr(0)[:0]) as detector_split, coalesce(inclusion_status, chr(0)[:0]) as inclusion_status, count(*) as rows, count(*) filter (coalesce(exclusion_reason, chr(0)[:0]) <> chr(0)[:0]) as with_reason from provenance group by all",
    "manifest_json": "with c as (select coalesce(dataset, 'none') as k, count(*) as n from provenance group by 1), b as (select '{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}' as body from c) select body, sha256(body) as sha256 from b",
    "manifest_files": "with s as (select distinct suite from eval_items where suite in ('gold-1', 'gold-2', 'panel-1', 'panel-2')) select suite, case suite when 'gold-1' then 'not listed' when 'panel-1' then 'digest' when 'panel-2' then 'length' else 'missing' end as problem, 1::bigint as files from s union all select suite, 'not listed', 1::bigint from s where suite = 'gold-2'",
    "lexicon_written": "with e as (select distinct category, lemma from lexicon_de where level is not null and lemma is not null) select format('DE{:05d}', row_number() over (order by category, lemma)) as id, category, trim(lemma) as lemma from e",
}
