"""Writers: corpus files in byte order, prepared corpora with provenance and manifest, lexicons, canonical JSON, verdict lines."""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions.text import escape
from quellmark.sources.importers import CORPUS, LEXICON, Refused, refuse

#: The columns of a provenance file, in its order.
PROVENANCE = [
    "dataset", "source_file_id", "source_id", "immutable_source_url", "archive_member", "revision", "file_path", "file_sha256",
    "acquired_at_unix_seconds", "license_id", "license_url", "citation", "upstream_lineage", "lineage_status", "source_language_code",
    "detector_language_code", "source_label", "detector_label", "label_conversion_version", "split_version", "normalization_version",
    "canonical_group_id", "representative_source_id", "source_split", "detector_split", "inclusion_status", "exclusion_reason",
]
#: The columns of a prepared file.
PREPARED = ["detector_language", "label", "source_id", "text"]
_RAW = {"sep": "\t", "header": True, "quote": "\0", "escape": "\0", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escapeQuotes": False, "lineSep": "\n"}


def corpus_lines(rows: DataFrame) -> DataFrame:
    """value: escaped lines of (split, label, text), range-sorted by their bytes; partitions hold consecutive ranges."""
    return rows.select(F.concat_ws("\t", "split", "label", escape(F.col("text"))).alias("value")).orderBy("value")


def write_corpus(rows: DataFrame, path: str) -> None:
    """Text files with the corpus header, sorted in order of their names; an existing path is an error."""
    sorted_rows = rows.select("split", "label", escape(F.col("text")).alias("text")).orderBy(F.concat_ws("\t", *CORPUS))
    sorted_rows.write.mode("errorifexists").options(**_RAW).csv(path)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def canonical_json(value) -> bytes:
    """One spelling of a JSON value: keys by their UTF-16 units, no blanks, numbers as ECMAScript writes them; NaN and infinities are refused."""

    def number(x: float) -> str:
        if math.isnan(x) or math.isinf(x):
            raise Refused(f"not a JSON number: {x!r}")
        if x == 0:
            return "0"
        sign, x = ("-", -x) if x < 0 else ("", x)
        digits, _, power = f"{x!r}".partition("e")
        whole, _, part = digits.partition(".")
        part = "" if part == "0" else part
        point = len(whole) + int(power or 0)
        line = (whole + part).lstrip("0")
        point -= len(whole + part) - len(line)
        line = line.rstrip("0")
        if 0 < point <= 21:
            out = line + "0" * (point - len(line)) if len(line) <= point else f"{line[:point]}.{line[point:]}"
        elif -6 < point <= 0:
            out = f"0.{'0' * -point}{line}"
        else:
            out = f"{line[0]}{'.' + line[1:] if len(line) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
        return sign + out

    def text(v) -> str:
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return number(v)
        if isinstance(v, dict):
            keys = sorted(v, key=lambda k: k.encode("utf-16-be"))
            return "{" + ",".join(f"{text(str(k))}:{text(v[k])}" for k in keys) + "}"
        return "[" + ",".join(map(text, v)) + "]"

    return text(value).encode()


def evidence(value) -> tuple[bytes, str]:
    """Canonical bytes and their SHA-256."""
    found = canonical_json(value)
    return found, hashlib.sha256(found).hexdigest()


def manifest(provenance: DataFrame) -> dict:
    """Counts of splits, duplicates, conflicts and exclusions, and one count map per dimension; bounded by the distinct values."""
    dims = ["detector_split", "detector_label", "inclusion_status", "exclusion_reason", "dataset", "detector_language_code"]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("none")).alias("value")) for c in dims)))
    maps: dict[str, dict[str, int]] = {c: {} for c in dims}
    for r in provenance.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n")).collect():
        maps[r["dimension"]][r["value"]] = r["n"]
    included = F.col("inclusion_status") == "included"
    sums = {s: F.count_if(included & (F.col("detector_split") == s)) for s in ("development", "validation", "test")}
    sums |= {"duplicates": F.count_if(F.col("exclusion_reason") == "duplicate"), "conflicts": F.count_if(F.col("exclusion_reason") == "label_conflict"), "excluded": F.count_if(~included)}
    return {"counts": provenance.agg(*(c.alias(k) for k, c in sums.items())).first().asDict(), "maps": maps}


def write_prepared(prepared: DataFrame, provenance: DataFrame, path: str) -> dict:
    """A folder of prepared rows, 27-column provenance and manifest, published whole or not at all.

    Everything is written to a folder beside `path`, which is then renamed to it; an existing path is an error, and so are a split without
    both labels and missing columns. Lists are written as JSON, texts escaped.
    """
    spark = prepared.sparkSession
    target, files = _files(spark, path)
    if files.exists(target):
        raise Refused(f"{path!r} exists")
    for rows, names in ((prepared, PREPARED), (provenance, PROVENANCE)):
        if missing := [n for n in names if n not in rows.columns]:
            raise Refused(f"columns are missing: {missing!r}")
    kept = provenance.where("inclusion_status = 'included' and detector_split is not null")
    refuse(kept.groupBy("detector_split").agg(F.count_distinct("detector_label").alias("n")).where("n < 2").select("detector_split"), "a split without both labels")
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    columns = [F.to_json(c).alias(c) if dict(provenance.dtypes)[c].startswith("array") else escape(F.col(c).cast("string")).alias(c) for c in PROVENANCE]
    try:
        prepared.select(*(escape(F.col(c)).alias(c) for c in PREPARED)).write.options(**_RAW).csv(f"{staged}/prepared")
        provenance.select(*columns).write.options(**_RAW).csv(f"{staged}/provenance")
        found = manifest(provenance)
        body, digest = evidence(found)
        spark.createDataFrame([(body.decode(), digest)], "body string, sha256 string").coalesce(1).write.json(f"{staged}/manifest")
        if files.exists(target) or not files.rename(_files(spark, staged)[0], target):
            raise Refused(f"{path!r} exists")
    finally:
        files.delete(_files(spark, staged)[0], True)
    return found


def numbered_lexicon(entries: DataFrame, language: str) -> DataFrame:
    """The entries with ids counted over (category, lemma); a lexicon is small, so one task numbers it."""
    from pyspark.sql import Window

    order = Window.orderBy("category", "lemma")
    return entries.select(F.format_string(f"{language.upper()}%05d", F.row_number().over(order)).alias("id"), "pos", "category", "stereotype", "lemma", "level")


def write_lexicon(entries: DataFrame, language: str, path: str, sources: dict) -> str:
    """A lexicon file and, beside it, its provenance as canonical JSON; returns the digest of the latter."""
    spark = entries.sparkSession
    rows = numbered_lexicon(entries, language).withColumn("stereotype", F.when(F.col("stereotype").cast("string").isin("true", "yes"), "yes").otherwise("no"))
    rows.select(*LEXICON).coalesce(1).write.mode("errorifexists").options(**_RAW).csv(f"{path}/lexicon")
    body, digest = evidence({"language": language.upper(), "entries": entries.count(), "sources": sources})
    spark.createDataFrame([(body.decode(),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/provenance")
    return digest


def verify_files(listed: DataFrame, folder: str) -> DataFrame:
    """path, problem of each file whose digest or length isn't that of the list (path, sha256, length), or that only one of them has."""
    spark = listed.sparkSession
    base = F.lit(_files(spark, folder)[0].toUri().getPath().rstrip("/") + "/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    there = there.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//)?", ""), F.concat(F.lit("^"), base), F.lit("")).alias("path"), F.sha2("content", 256).alias("has"), F.col("length").alias("size"))
    both = listed.select("path", F.col("sha256"), F.col("length").alias("said")).join(there, "path", "full")
    problem = F.when(F.col("has").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("said") != F.col("size"), "length").when(F.lower("sha256") != F.col("has"), "digest")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def verdict_line(safe: Column, score: Column, locale: Column, masked: Column) -> Column:
    """One JSON object per message, keys in this order, nulls kept."""
    return F.to_json(F.struct(safe.alias("safe"), score.alias("score"), locale.alias("locale"), masked.alias("grawlix")), {"ignoreNullFields": "false"})
