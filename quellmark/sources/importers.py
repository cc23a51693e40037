"""Importers of labelled files: exact columns, checked values, and an error instead of a guess.

Every importer gives source_id, text, label and exclusion_reason. What a single row shows (an illegal label, a place
beyond its text) fails the task that reads it, with the reason; what only the whole input shows (repeated or unmatched ids) is
checked by one aggregate or join before the table is returned, and raises Refused. Nulls in a column that must be
filled are errors, empty files give no rows, further columns are refused where the format fixes its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions.text import unescape
from quellmark.sources import adapters as A

#: The columns of the formats.
CORPUS = ["split", "label", "text"]
LEXICON = ["id", "pos", "category", "stereotype", "lemma", "level"]
PAIRS = ["source_id", "language", "toxic", "text"]
COMMUNITY = ["native_id", "label", "text"]
FLAGS = ["Tweet", "HS", "Abusive", "HS_Individual", "HS_Group", "HS_Religion", "HS_Race", "HS_Physical", "HS_Gender", "HS_Other", "HS_Weak", "HS_Moderate", "HS_Strong"]
CATEGORIES = ["homophobia", "obscene", "insult", "racism", "misogyny", "xenophobia"]
VOTES = ["text", *(f"{c}_{k}" for c in CATEGORIES for k in (1, 2, 3)), "obs_1", "obs_2", "obs_3"]
#: Most rows and bytes of text of one Parquet import.
PARQUET_ROWS, PARQUET_BYTES = 100_000, 64 * 2**20


class Refused(ValueError):
    """The input as a whole breaks a rule of its format."""


def must(condition: Column, value: Column, message: str) -> Column:
    """The value, or an error of the task where the condition isn't true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def refuse(found: DataFrame, message: str) -> None:
    rows = found.limit(1).collect()
    if rows:
        raise Refused(f"{message}: {rows[0][0]!r}")


def unique(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """The rows, if no key occurs twice and none is blank."""
    refuse(rows.where(F.coalesce(F.trim(key), F.lit("")) == "").select(F.coalesce(key, F.lit(""))), f"blank {key}")
    refuse(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), f"repeated {key}")
    return rows


def columns(spark: SparkSession, path: str, names: list[str], sep: str = "\t", quoted: bool = False, header: bool = True, trim: bool = False) -> DataFrame:
    """Exactly these columns as strings, empty fields as empty strings; another header or number of columns fails."""
    quote = {"quote": '"', "escape": '"', "multiLine": True} if quoted else {"quote": "\0", "escape": "\0", "lineSep": "\n"}
    read = spark.read.options(
        sep=sep, header=header, enforceSchema=not header, mode="FAILFAST", columnPruning=False, maxCharsPerColumn=-1,
        ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, encoding="UTF-8", **quote,
    )
    rows = read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return rows.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names))


def _out(rows: DataFrame, source_id: Column, text: Column, label: Column, reason: Column | None = None) -> DataFrame:
    return rows.select(source_id.alias("source_id"), text.alias("text"), label.alias("label"), (F.lit(None).cast("string") if reason is None else reason).alias("exclusion_reason"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """split, label, text of a corpus file: known splits and labels, escapes undone, no raw carriage return."""
    rows = columns(spark, path, CORPUS)
    split = must(F.col("split").isin("development", "validation", "test"), F.col("split"), "unknown split")
    label = must(F.col("label").isin("clean", "toxic"), F.col("label"), "unknown label")
    text = must(~F.col("text").contains("\r"), unescape(F.col("text")), "raw carriage return in a text")
    return rows.select(split.alias("split"), label.alias("label"), text.alias("text"))


def lexicon(spark: SparkSession, path: str, language: str) -> DataFrame:
    """id, language, pos, category, stereotype, lemma, level: fields trimmed, ids of the requested language, known levels."""
    rows = columns(spark, path, LEXICON, trim=True)
    rows = rows.select(*(F.trim(c).alias(c) for c in LEXICON))
    own = F.upper(F.regexp_extract("id", "^[A-Za-z]+", 0))
    return unique(rows, "id").select(
        must(own == language.upper(), F.col("id"), "an id of another language").alias("id"), own.alias("language"), "pos", "category",
        must(F.col("stereotype").isin("yes", "no"), F.col("stereotype") == "yes", "stereotype is yes or no").alias("stereotype"), "lemma",
        must(F.lower("level").isin("conservative", "inclusive"), F.lower("level"), "unknown level").alias("level"),
    )


def pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """source_id, language, toxic, text: toxic is 0 or 1, ids are unique and not blank."""
    rows = unique(columns(spark, path, PAIRS, quoted=True))
    label = must(F.col("toxic").isin("0", "1"), F.when(F.col("toxic") == "1", "toxic").otherwise("clean"), "toxic is 0 or 1")
    return _out(rows, F.col("source_id"), F.col("text"), label)


def pages_json(spark: SparkSession, path: str, prefix: str, one_per_file: bool = True) -> DataFrame:
    """Pages (one a file or one a line) of {rows: [{row_idx, row: {text, toxic}}], num_rows_total}: indexes are unique and below the total."""
    schema = "num_rows_total long, rows array<struct<row_idx: long, row: struct<text: string, toxic: int>>>"
    entries = spark.read.json(path, schema=schema, multiLine=one_per_file, mode="FAILFAST").select("num_rows_total", F.explode("rows").alias("r"))
    refuse(entries.where(~F.coalesce((F.col("r.row_idx") >= 0) & (F.col("r.row_idx") < F.col("num_rows_total")), F.lit(False))).select("r.row_idx"), "row_idx beyond num_rows_total")
    refuse(entries.groupBy("r.row_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_idx"), "repeated row_idx")
    toxic = F.col("r.row.toxic")
    return _out(entries, F.format_string(f"{prefix}/%06d", "r.row_idx"), F.col("r.row.text"), must(toxic.isin(0, 1), A.binary_label(toxic), "toxic is 0 or 1"))


def pairs_parquet(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """text, toxic and nothing else, at most PARQUET_ROWS rows and PARQUET_BYTES bytes of text; ids count rows in order.

    The bound on the rows is the format's, so numbering them in one task is no harm.
    """
    rows = spark.read.parquet(path)
    if [(f.name, f.dataType.simpleString()) for f in rows.schema] not in ([("text", "string"), ("toxic", "bigint")], [("toxic", "bigint"), ("text", "string")]):
        raise Refused(f"columns are not text string, toxic bigint: {rows.schema.simpleString()!r}")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["rows"] > PARQUET_ROWS or size["bytes"] > PARQUET_BYTES:
        raise Refused(f"more than {PARQUET_ROWS} rows or {PARQUET_BYTES} bytes: {size.asDict()!r}")
    numbered = rows.coalesce(1).withColumn("k", F.monotonically_increasing_id())
    return _out(numbered, F.format_string(f"{prefix}/%06d", "k"), F.col("text"), must(F.col("toxic").isin(0, 1), A.binary_label(F.col("toxic")), "toxic is 0 or 1"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line number (from 0) of line files in order of their names; one count per block of a file is all that reaches the driver."""
    rows = spark.read.text(path, lineSep="\n").select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("file", "block").collect()
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["file"], r["block"], before - r["first"]))
        before += r["n"]
    shifts = spark.createDataFrame(offsets, "file string, block long, shift long")
    return rows.join(F.broadcast(shifts), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("line"), "value")


def parallel(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """line, text, label of two line files: as many lines in both, no empty label."""
    both = A.by_line(_lines(spark, texts), _lines(spark, labels))
    refuse(both.where("text is null or label is null").select("line"), "a line of one file only")
    refuse(both.where("trim(label) = ''").select("line"), "an empty label")
    return both


def coarse_fine(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """text, coarse, fine without header or quoting; only listed pairs of labels are legal; ids count lines."""
    rows = _lines(spark, path).where("value <> ''").withColumn("p", F.split("value", "\t", -1))
    whole = must(F.size("p") == 3, F.col("p"), "a line hasn't three columns")
    parts = rows.select("line", whole.alias("p")).select("line", *(F.col("p")[k].alias(c) for k, c in enumerate(("text", "coarse", "fine"))))
    label = A.coarse_fine_label(F.trim("coarse"), F.trim("fine"))
    return _out(parts, F.format_string(f"{prefix}/%06d", "line"), F.col("text"), must(label.isNotNull(), label, "an illegal pair of labels"))


def flags(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A text and twelve flags, all 0 or 1; toxic where hate speech or abuse is flagged; ids count rows by text digest."""
    rows = columns(spark, path, FLAGS, sep=",", quoted=True)
    legal = F.forall(F.array(*FLAGS[1:]), lambda v: v.isin("0", "1"))
    label = F.when((F.col("HS") == "1") | (F.col("Abusive") == "1"), "toxic").otherwise("clean")
    return _out(rows, F.concat(F.lit(f"{prefix}/"), F.substring(F.sha2("Tweet", 256), 1, 12)), F.col("Tweet"), must(legal, label, "a flag is 0 or 1"))


def codes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """document, label: a comma list of 0 to 8; 8 alone is clean; 8 beside others, none and other codes are errors."""
    rows = columns(spark, path, ["document", "label"])
    label = A.code_list_label(F.col("label"))
    return _out(rows, F.concat(F.lit(f"{prefix}/"), F.substring(F.sha2("document", 256), 1, 12)), F.col("document"), must(label.isNotNull(), label, "illegal codes"))


def spans(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """id, content, index_spans: a JSON list of character places within the content; none is clean."""
    rows = unique(columns(spark, path, ["id", "content", "index_spans"], sep=",", quoted=True), "id")
    label = A.span_label(F.col("content"), F.col("index_spans"))
    return _out(rows, F.concat(F.lit(f"{prefix}/"), "id"), F.col("content"), must(label.isNotNull(), label, "a place beyond the text"))


def joined(spark: SparkSession, texts: str, labels: str, prefix: str) -> DataFrame:
    """id, tweet (TSV, no quoting) and id, label (CSV without header) by id: neither side may lack one; OFF is toxic, NOT clean."""
    left = unique(columns(spark, texts, ["id", "tweet"]), "id").withColumnRenamed("tweet", "text")
    right = unique(columns(spark, labels, ["id", "label"], sep=",", header=False), "id")
    both = A.label_join(left, right)
    refuse(both.where("problem is not null").select(F.concat_ws(" ", "problem", "id")), "ids don't match")
    label = F.when(F.col("label") == "OFF", "toxic").when(F.col("label") == "NOT", "clean")
    return _out(both, F.concat(F.lit(f"{prefix}/"), "id"), F.col("text"), must(label.isNotNull(), label, "label is OFF or NOT"))


def votes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A text, three votes on each of six categories and three remarks: an annotator's vote is any of theirs; one vote alone is excluded as ambiguous."""
    rows = columns(spark, path, VOTES, sep=",", quoted=True)
    legal = F.forall(F.array(*VOTES[1:19]), lambda v: v.try_cast("double").isin(0.0, 1.0))
    each = [F.greatest(*(F.col(f"{c}_{k}").try_cast("double") for c in CATEGORIES)).cast("int") for k in (1, 2, 3)]
    label, reason = A.vote_label(each)
    return _out(rows, F.concat(F.lit(f"{prefix}/"), F.substring(F.sha2("text", 256), 1, 12)), F.col("text"), must(legal, label, "a vote is 0 or 1"), reason)


def community(spark: SparkSession, path: str, name: str) -> DataFrame:
    """native_id, label, text: label is clean or toxic, empty texts are excluded, ids unique."""
    rows = unique(columns(spark, path, COMMUNITY), "native_id")
    label = must(F.col("label").isin("clean", "toxic"), F.col("label"), "label is clean or toxic")
    return _out(rows, F.concat(F.lit(f"{name}/"), "native_id"), F.col("text"), label, F.when(F.trim("text") == "", "empty_text"))
