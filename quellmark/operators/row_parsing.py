"""Problem 3: corpus lines that fail to parse, parted from the valid rows with the reason.

Each line is parsed by Python's csv reader in strict mode, inside the partition that read it; what the reader raises
is the structural failure, the typed checks of the fields come after it.
"""

from __future__ import annotations

import csv
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.runtime import table

SPLITS = ("development", "validation", "test")
LABELS = ("clean", "toxic")
#: Line breaks end a record for the csv reader; within a line they are characters of the text, so they travel as private ones that the line hasn't.
_BREAKS = "\r\n\0"
_CONTROL = re.compile("[" + "".join(re.escape(chr(p)) for p in range(0xA0) if unicodedata.category(chr(p)) == "Cc" and p != 9) + "�]")


def parse_line(line: str | None) -> tuple[str | None, list[str]]:
    """(reason or None, fields) of one line; an empty or null line has no fields."""
    if not line:
        return "columns", []
    shown = {}
    if any(c in line for c in _BREAKS):
        free = (c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in line)
        shown = {ord(next(free)): c for c in _BREAKS}
        line = line.translate({ord(c): p for p, c in shown.items()})
    csv.field_size_limit(sys.maxsize)
    try:
        (fields,) = csv.reader([line], delimiter="\t", quotechar='"', doublequote=True, strict=True)
    except csv.Error:
        return "quoting", []
    if shown:
        fields = [f.translate(shown) for f in fields]
    if len(fields) != 3:
        return "columns", fields
    if fields[0] not in SPLITS:
        return "split", fields
    if fields[1] not in LABELS:
        return "label", fields
    if not fields[2].strip() or _CONTROL.search(fields[2]):
        return "text", fields
    return None, fields


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [parse_line(line) for line in batch.column(1).to_pylist()]
        good = [f if reason is None else (None, None, None) for reason, f in out]
        columns = [batch.column(0), pa.array([r for r, _ in out], pa.string())]
        columns += [pa.array([g[k] for g in good], pa.string()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["raw_id", "reason", "split", "label", "text"])


def parse_rows(lines: DataFrame) -> DataFrame:
    """raw_id, reason, split, label, text of each line of (raw_id, line): reason is null in valid rows, the rest in bad ones.

    The reason is the first that applies of quoting, columns, split, label, text. Null and empty lines lack columns;
    a null raw_id stays null; repeated lines give repeated rows; any length is parsed; other columns aren't read; an
    empty table gives no rows. No shuffle: a narrow step over the scan.
    """
    schema = "raw_id long, reason string, split string, label string, text string"
    return lines.select("raw_id", "line").mapInArrow(_parse, schema)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(table(spark, sf_dir, "corpus_raw")).where("reason is not null").select("raw_id", "reason")


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(table(spark, sf_dir, "corpus_raw")).where("reason is null").select("raw_id", "split", "label", "text")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per file by reason, valid ones under `valid`."""
    raw = table(spark, sf_dir, "corpus_raw")
    parsed = raw.select("raw_id", "file_name", "line").mapInArrow(_parse_named, "file_name string, reason string")
    return parsed.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def _parse_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reasons = [parse_line(line)[0] for line in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(reasons, pa.string())], ["file_name", "reason"])


QUERIES = {"p3_found": p3_found, "p3_valid": p3_valid, "p3_report": p3_report}

# A field is quoted only if it begins with `"`. The pattern takes one field and what ends it at a time.
_FIELDS = r"""
lines as (select raw_id, file_name, coalesce(line, '') as line from corpus_raw),
shaped as (select *, case
    when line = '' then 'columns'
    when not regexp_full_match(line, '(?s)(("([^"]|"")*"|([^"\t][^\t]*)?)\t)*("([^"]|"")*"|([^"\t][^\t]*)?)') then 'quoting'
    end as bad from lines),
parted as (select *, case when bad is null then regexp_extract_all(line || chr(9), '(?s)("(?:[^"]|"")*"|[^\t]*)\t', 1) end as raw from shaped),
cleaned as (select *, list_transform(raw, lambda f: case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end) as f from parted),
judged as (select raw_id, file_name, f, case
    when bad is not null then bad
    when len(f) <> 3 then 'columns'
    when f[1] not in ('development', 'validation', 'test') then 'split'
    when f[2] not in ('clean', 'toxic') then 'label'
    when regexp_full_match(f[3], '(?s)[\s\x{85}\x{1c}-\x{1f}\p{Z}]*') or regexp_matches(f[3], '[\x{0}-\x{8}\x{a}-\x{1f}\x{7f}-\x{9f}\x{fffd}]') then 'text'
    end as reason from cleaned)
"""
SQL = {
    "p3_found": f"with {_FIELDS} select raw_id, reason from judged where reason is not null",
    "p3_valid": f"with {_FIELDS} select raw_id, f[1] as split, f[2] as label, f[3] as text from judged where reason is null",
    "p3_report": f"with {_FIELDS} select file_name, coalesce(reason, 'valid') as reason, count(*) as rows from judged group by all",
}
