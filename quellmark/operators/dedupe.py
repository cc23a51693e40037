"""Corpus preparation: duplicate groups, label conflicts, splits, exclusions and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions import text as X
from quellmark.plans import sqlbits as B
from quellmark.runtime import Workspace, table

#: Order in which splits outrank each other within a group of duplicates.
PRIORITY = {"development": 0, "validation": 1, "test": 2}
#: In the queries: the dataset whose rows outrank all others, and the one whose rows only ever train.
BASELINE, TRAINING_ONLY = "lumen-board", "quill-notes"
#: In the queries: the dataset whose records may be of unresolved lineage, in these languages.
LINEAGE = ("mesa-forum", ("ZH", "FR"))
#: Fields in which a delivery must agree with the catalog.
FIELDS = ("dataset", "author_id", "canonical_group_id", "file_sha256", "revision", "license_id", "source_language_code", "source_label", "detector_split", "inclusion_status", "exclusion_reason")


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows with what their source says: dataset, native split, language, label and text."""
    rows = table(spark, sf_dir, "prepared_rows")
    code = F.upper(F.col("detector_language"))
    native = F.split_part("source_id", F.lit("/"), F.lit(2))
    return rows.select(
        "source_id", F.split_part("source_id", F.lit("@"), F.lit(1)).alias("dataset"), native.alias("native"),
        F.when(code.rlike("^[A-Z]{2}$") & (code != "XX"), code).otherwise("EN").alias("language"), "label", "text",
    )


def keyed(rows: DataFrame) -> DataFrame:
    """With normalized text (the trimmed text where no word is left) and the group hash; rows without text have none."""
    plain = X.normalize_text(F.col("text"))
    with_key = rows.withColumn("plain", plain)
    with_key = with_key.withColumn("normalized", F.when(F.col("plain") == "", F.trim("text")).otherwise(F.col("plain"))).drop("plain")
    return with_key.withColumn("group_id", F.when(F.col("normalized") != "", X.group_hash(F.col("language"), F.col("normalized"))))


def hash_split(group: Column) -> Column:
    bucket = X.hash_bucket(group)
    return F.when(bucket < 70, "development").when(bucket < 85, "validation").otherwise("test")


def policy_split(group: Column, training_only: str = TRAINING_ONLY) -> Column:
    """Training-only sources develop; Turkish keeps its official test and hashes the rest 85 to 15; Vietnamese keeps all; others hash."""
    official = F.when(F.col("native") == "test", "test").when(F.col("native") == "train", "development").otherwise("validation")
    turkish = F.when(F.col("native") == "test", "test").when(X.hash_bucket(group) < 85, "development").otherwise("validation")
    return (
        F.when(F.col("dataset") == training_only, "development").when(F.col("language") == "TR", turkish)
        .when(F.col("language") == "VI", official).otherwise(hash_split(group))
    )


def resolved(rows: DataFrame, baseline: str = BASELINE, training_only: str = TRAINING_ONLY) -> DataFrame:
    """Every row with group, conflict, representative, split and exclusion reason.

    A representative is the first by baseline dataset, then highest split, then smallest source_id; its split is that of
    all rows of its group. Groups are aggregated map-side and joined back, so a group of any size costs a row per task.
    """
    own = Workspace(rows.sparkSession, "resolved").keep(keyed(rows).withColumn("own_split", policy_split(F.col("group_id"), training_only)).withColumn("g", F.coalesce("group_id", F.lit(""))))
    rank = F.coalesce(*(F.when(F.col("own_split") == s, F.lit(k)) for s, k in PRIORITY.items()))
    first = F.min(F.struct((F.col("dataset") != baseline).alias("later"), (-rank).alias("rank"), "source_id", "own_split")).alias("first")
    both = F.coalesce(F.bool_or(F.col("label") == "toxic") & F.bool_or(F.col("label") == "clean"), F.lit(False)).alias("both")
    groups = own.groupBy("language", "g").agg(first, both)
    seen = own.join(groups, ["language", "g"]).withColumn("conflict", F.col("both") & F.col("group_id").isNotNull())
    reason = (
        F.when(F.col("label").isNull(), "unlabelled").when(F.coalesce("normalized", F.lit("")) == "", "empty_text").when(F.col("conflict"), "label_conflict")
        .when((F.col("source_id") != F.col("first.source_id")) & ~F.col("first.later") & (F.col("dataset") == training_only), "sealed_baseline_duplicate")
        .when(F.col("source_id") != F.col("first.source_id"), "duplicate")
    )
    return seen.select(
        "source_id", "language", "dataset", "label", "group_id", "conflict", reason.alias("reason"),
        F.when(~F.col("conflict"), F.col("first.source_id")).alias("representative"), F.col("first.own_split").alias("split"),
    )


def row_source_id(language: Column, text: Column) -> Column:
    return F.concat(language, F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))


def multiset_digest(text: Column) -> Column:
    """A digest of a group of rows that needs no order, so partial sums combine: the sum of 60-bit pieces of their SHA-256."""
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")


def _stats(spark, d):
    r = resolved(imported(spark, d))
    return r.groupBy("language").agg(
        F.count_if(F.col("reason").isin("duplicate", "sealed_baseline_duplicate")).alias("duplicates"),
        F.count_if(F.col("reason") == "label_conflict").alias("conflicts"), F.count_if(F.col("reason").isNotNull()).alias("excluded"),
    )


def _prep_counts(spark, d):
    p = table(spark, d, "provenance")
    dims = ["detector_split", "detector_label", "inclusion_status", "exclusion_reason", "dataset", "detector_language_code"]
    exploded = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("none")).alias("value")) for c in dims))).alias("x"))
    return exploded.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def _corpus_duplicates(spark, d):
    r = table(spark, d, "corpus_rows").select("row_id", "source_id", "text").withColumn("normalized", X.normalize_text(F.col("text")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.sha2(c, 256).alias("key")) for k, c in (("source_id", F.col("source_id")), ("text", F.col("text")), ("normalized", F.expr("nullif(normalized, '')")))))
    counted = r.select(F.explode(kinds).alias("x")).where("x.key is not null").groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").groupBy("kind").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))


def _audit(spark, d):
    """Ids of the audit list: excluded where the row would land in development; ids of other splits and of no row are named, as both are errors."""
    listed = table(spark, d, "provenance").where("exclusion_reason = 'audit_only'").select("source_id").union(table(spark, d, "behavior_audit").select("source_id")).where("source_id is not null").distinct()
    rows = keyed(imported(spark, d)).select("source_id", policy_split(F.col("group_id")).alias("split"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("split") == "development", "excluded").otherwise("not development")
    return listed.join(rows, "source_id", "left").select("source_id", status.alias("status"))


def _order_check(spark, d):
    """Lines of each file that come before the line above them in byte order; a join on line numbers, so no file meets in one task."""
    r = table(spark, d, "corpus_raw").select("file_name", "line_no", "line")
    above = r.select("file_name", (F.col("line_no") + 1).alias("line_no"), F.col("line").alias("before"))
    return r.join(above, ["file_name", "line_no"], "left").groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") < F.col("before")).alias("out_of_order"))


def _manifest(spark, d):
    """Recorded counts of each batch against the rows at hand."""
    have = table(spark, d, "corpus_rows").where("batch_id is not null").groupBy("batch_id").agg(*(F.count_if(F.col("split") == s).alias(f"have_{s}") for s in PRIORITY))
    said = table(spark, d, "prepared_counts").groupBy("batch_id").agg(*(F.max(s).alias(s) for s in PRIORITY))
    both = said.join(have, "batch_id", "full")
    return both.select("batch_id", *(F.coalesce(F.col(f"have_{s}") - F.col(s), F.lit(-1)).alias(f"{s}_more") for s in PRIORITY))


def source_diff(catalog: DataFrame, observed: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """source_id, record_id, problem of every observed record that the catalog lacks or that differs from it (the fields are named), and of catalog entries nobody delivered."""
    known = catalog.select("source_id", F.lit(True).alias("listed"), *(F.col(f).alias(f"c_{f}") for f in fields))
    both = observed.select("source_id", "record_id", F.lit(True).alias("seen"), *fields).join(known, "source_id", "full")
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"c_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields))), ",")
    problem = F.when(F.col("listed").isNull(), "not in the catalog").when(F.col("seen").isNull(), "not delivered").otherwise(differs)
    return both.select("source_id", "record_id", problem.alias("problem")).where("problem <> ''")


def _source_diff(spark, d):
    """Every delivery of a provenance record against its first one, which stands for the catalog; records of datasets without a license aren't catalogued."""
    p = table(spark, d, "provenance").where("source_id is not null and record_id is not null")
    first = p.groupBy("source_id").agg(F.min("record_id").alias("record_id"))
    catalog = p.join(first, ["source_id", "record_id"], "left_semi").where("license_id is not null")
    return source_diff(catalog, p)


def lineage_problems(records: DataFrame, dataset: str, languages: tuple[str, ...]) -> DataFrame:
    """source_id, problem: ids of more than one record, and unresolved lineage outside of the dataset and languages that may have it."""
    code = F.upper(F.regexp_extract("source_language_code", "^([A-Za-z]+)", 1))
    may = F.coalesce((F.col("dataset") == dataset) & code.isin(*languages), F.lit(False))
    rows = records.where("source_id is not null")
    repeated = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_id", F.lit("repeated id").alias("problem"))
    return repeated.union(rows.where((F.col("lineage_status") == "unresolved") & ~may).select("source_id", F.lit("unresolved lineage")))


def _sealed(spark, d):
    """Validation and test texts against a lock of their digests that was written before one text of `test` was changed."""
    rows = table(spark, d, "corpus_rows").where("split in ('validation', 'test') and text is not null").select("row_id", "split", "text")
    work = Workspace(spark, "lock")
    lock = work.keep(rows.groupBy("split").agg(multiset_digest(F.col("text")).alias("locked")))
    changed = rows.where("split = 'test'").agg(F.min("row_id").alias("m")).scalar()
    now = rows.withColumn("text", F.when((F.col("split") == "test") & (F.col("row_id") == changed), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return lock.join(now.groupBy("split").agg(multiset_digest(F.col("text")).alias("found")), "split", "full").select("split", F.col("locked").eqNullSafe(F.col("found")).alias("sealed"))


_VALID = "record_id, not coalesce(case inclusion_status when 'included' then detector_label is not null and detector_split is not null and representative_source_id is not null when 'excluded' then exclusion_reason is not null end, false) as broken"

QUERIES = {
    "normalize_text": lambda s, d: table(s, d, "corpus_rows").select("row_id", X.normalize_text(F.col("text")).alias("normalized")),
    "group_id": lambda s, d: keyed(imported(s, d)).select("source_id", "group_id"),
    "hash_split": lambda s, d: keyed(imported(s, d)).select("source_id", hash_split(F.col("group_id")).alias("split")),
    "split_policy": lambda s, d: keyed(imported(s, d)).select("source_id", policy_split(F.col("group_id")).alias("split")),
    "dedupe_groups": lambda s, d: keyed(imported(s, d)).groupBy("language", "group_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == "toxic").alias("toxic"), F.count_if(F.col("label") == "clean").alias("clean")),
    "label_conflicts": lambda s, d: resolved(imported(s, d)).where("conflict").select("source_id", "group_id"),
    "dedupe_representative": lambda s, d: resolved(imported(s, d)).select("source_id", "representative", "split"),
    "exclusion_reason": lambda s, d: resolved(imported(s, d)).where("reason is not null").select("source_id", "reason"),
    "dedupe_stats": _stats,
    "corpus_duplicates": _corpus_duplicates,
    "prep_counts": _prep_counts,
    "prepare_union": lambda s, d: imported(s, d).select("source_id", "label", F.lit("prepared").alias("origin")).unionByName(table(s, d, "behavior_audit").select("source_id", "label", F.lit("audit").alias("origin"))),
    "audit_exclusion": _audit,
    "row_source_id": lambda s, d: imported(s, d).where("text is not null").select("source_id", row_source_id(F.col("language"), F.col("text")).alias("row_source_id")),
    "split_digest": lambda s, d: table(s, d, "corpus_rows").where("split is not null and text is not null").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), multiset_digest(F.concat(F.coalesce("label", F.lit("")), F.lit("\t"), "text", F.lit("\n"))).alias("digest")),
    "sealed_check": _sealed,
    "corpus_order_check": _order_check,
    "manifest_check": _manifest,
    "source_diff": _source_diff,
    "source_lineage": lambda s, d: lineage_problems(table(s, d, "provenance"), *LINEAGE),
    "provenance_validity": lambda s, d: table(s, d, "provenance").selectExpr(*_VALID.replace("record_id, ", "record_id;").split(";")).where("broken").select("record_id"),
}

_IMPORTED = rf"""
imported as (select source_id, split_part(source_id, '@', 1) as dataset, split_part(source_id, '/', 2) as native, label, text,
    case when regexp_full_match(upper(detector_language), '[A-Z]{{2}}') and upper(detector_language) <> 'XX' then upper(detector_language) else 'EN' end as language from prepared_rows)"""


def _plain(x: str) -> str:
    each = rf"case when regexp_full_match(w, '[\p{{Latin}}\p{{M}}\p{{N}}]+') then strip_accents(w) else w end"
    return f"array_to_string(list_transform(regexp_extract_all({B.clean(x)}, '{B.WORD}'), lambda w: {each}), ' ')"


_KEYED = f"""{_IMPORTED},
normal as materialized (select *, case when p = '' then trim(text) else p end as normalized from (select *, {_plain("text")} as p from imported)),
hashed as materialized (select k, list_reduce(list_concat([14695981039346656037::hugeint], list_transform({B.bytes_of("k")}, lambda b: b::hugeint)),
    lambda h, b: ((h - h % 256 + xor((h % 256)::int, b::int)) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as h
    from (select distinct language || chr(0) || normalized as k from normal where normalized <> '')),
keyed as materialized (select n.*, h, case when h is not null then lpad(format('{{:x}}', (h // 4294967296)::bigint), 8, '0') || lpad(format('{{:x}}', (h % 4294967296)::bigint), 8, '0') end as group_id, (h % 100)::int as bucket
    from normal n left join hashed on k = language || chr(0) || normalized)"""
_HASHED = "case when bucket < 70 then 'development' when bucket < 85 then 'validation' else 'test' end"
_POLICY = f"""case when dataset = '{TRAINING_ONLY}' then 'development' when language = 'TR' then case when native = 'test' then 'test' when bucket < 85 then 'development' else 'validation' end
    when language = 'VI' then case native when 'test' then 'test' when 'train' then 'development' else 'validation' end else {_HASHED} end"""
_RESOLVED = f"""{_KEYED}, own as (select *, {_POLICY} as own_split from keyed),
seen as (select *, first_value(source_id) over g as rep, first_value(own_split) over g as split, first_value(dataset) over g = '{BASELINE}' as base,
    group_id is not null and count(*) filter (label = 'toxic') over (partition by language, group_id) > 0 and count(*) filter (label = 'clean') over (partition by language, group_id) > 0 as conflict
    from own window g as (partition by language, group_id order by dataset <> '{BASELINE}', case own_split when 'test' then 0 when 'validation' then 1 else 2 end, source_id)),
resolved as (select *, case when label is null then 'unlabelled' when coalesce(normalized, '') = '' then 'empty_text' when conflict then 'label_conflict'
    when source_id <> rep and base and dataset = '{TRAINING_ONLY}' then 'sealed_baseline_duplicate' when source_id <> rep then 'duplicate' end as reason from seen)"""


def _digest_sql(x: str) -> str:
    return f"sum(('0x' || substr(sha256({x}), 1, 15))::bigint::hugeint)::varchar"


SQL = {
    "normalize_text": f"select row_id, {_plain('text')} as normalized from corpus_rows",
    "group_id": f"with {_KEYED} select source_id, group_id from keyed",
    "hash_split": f"with {_KEYED} select source_id, {_HASHED} as split from keyed",
    "split_policy": f"with {_KEYED} select source_id, {_POLICY} as split from keyed",
    "dedupe_groups": f"with {_KEYED} select language, group_id, count(*) as rows, count(*) filter (label = 'toxic') as toxic, count(*) filter (label = 'clean') as clean from keyed group by language, group_id",
    "label_conflicts": f"with {_RESOLVED} select source_id, group_id from resolved where conflict",
    "dedupe_representative": f"with {_RESOLVED} select source_id, case when not conflict then rep end as representative, split from resolved",
    "exclusion_reason": f"with {_RESOLVED} select source_id, reason from resolved where reason is not null",
    "dedupe_stats": f"with {_RESOLVED} select language, count(*) filter (reason in ('duplicate', 'sealed_baseline_duplicate')) as duplicates, count(*) filter (reason = 'label_conflict') as conflicts, count(*) filter (reason is not null) as excluded from resolved group by language",
    "corpus_duplicates": f"with x as (select unnest([{{'kind': 'source_id', 'key': source_id}}, {{'kind': 'text', 'key': text}}, {{'kind': 'normalized', 'key': nullif({_plain('text')}, '')}}]) as x from corpus_rows), c as (select x.kind as kind, x.key as key, count(*) as n from x where x.key is not null group by all having count(*) > 1) select kind, count(*) as values, sum(n)::bigint as rows from c group by kind",
    "prep_counts": "with x as (select unnest([" + ", ".join(f"{{'d': '{c}', 'v': coalesce({c}, 'none')}}" for c in ["detector_split", "detector_label", "inclusion_status", "exclusion_reason", "dataset", "detector_language_code"]) + "]) as x from provenance) select x.d as dimension, x.v as value, count(*) as rows from x group by all",
    "prepare_union": "select source_id, label, 'prepared' as origin from prepared_rows union all select source_id, label, 'audit' from behavior_audit",
    "audit_exclusion": f"""with {_KEYED}, listed as (select distinct source_id from provenance where exclusion_reason = 'audit_only' and source_id is not null union select source_id from behavior_audit where source_id is not null)
        select l.source_id, case when k.source_id is null then 'unknown' when {_POLICY} = 'development' then 'excluded' else 'not development' end as status from listed l left join keyed k on k.source_id = l.source_id""",
    "row_source_id": f"with {_IMPORTED} select source_id, language || ':' || substr(sha256(text), 1, 12) as row_source_id from imported where text is not null",
    "split_digest": f"select split, count(*) as rows, {_digest_sql('coalesce(label, chr(0)[:0]) || chr(9) || text || chr(10)')} as digest from corpus_rows where split is not null and text is not null group by split",
    "sealed_check": f"with r as (select * from corpus_rows where split in ('validation', 'test') and text is not null), m as (select min(row_id) as m from r where split = 'test'), n as (select split, case when split = 'test' and row_id = m then text || '!' else text end as text from r, m), a as (select split, {_digest_sql('text')} as x from r group by split), b as (select split, {_digest_sql('text')} as y from n group by split) select split, x = y as sealed from a join b using (split)",
    "corpus_order_check": "with r as (select *, lag(line) over (partition by file_name order by line_no, raw_id) as before from corpus_raw) select file_name, count(*) as lines, count(*) filter (line < before) as out_of_order from r group by file_name",
    "manifest_check": "with h as (select batch_id, " + ", ".join(f"count(*) filter (split = '{s}') as have_{s}" for s in PRIORITY) + " from corpus_rows where batch_id is not null group by 1), p as (select batch_id, " + ", ".join(f"max({s}) as {s}" for s in PRIORITY) + " from prepared_counts group by 1) select coalesce(h.batch_id, p.batch_id) as batch_id, " + ", ".join(f"coalesce(have_{s} - {s}, -1)::bigint as {s}_more" for s in PRIORITY) + " from p full join h on p.batch_id = h.batch_id",
    "source_diff": "with p as (select * from provenance where source_id is not null and record_id is not null), k as (select p.* from p join (select source_id, min(record_id) as record_id from p group by 1) using (source_id, record_id) where license_id is not null), j as (select p.source_id, p.record_id, case when k.source_id is null then 'not in the catalog' else array_to_string(list_filter([" + ", ".join(f"case when p.{f} is distinct from k.{f} then '{f}' end" for f in FIELDS) + "], lambda f: f is not null), ',') end as problem from p left join k on k.source_id = p.source_id) select * from j where problem <> chr(0)[:0]",
    "source_lineage": f"select source_id, 'repeated id' as problem from provenance where source_id is not null group by 1 having count(*) > 1 union all select source_id, 'unresolved lineage' from provenance where source_id is not null and lineage_status = 'unresolved' and not coalesce(dataset = '{LINEAGE[0]}' and upper(regexp_extract(source_language_code, '^([A-Za-z]+)', 1)) in ({', '.join(repr(c) for c in LINEAGE[1])}), false)",
    "provenance_validity": f"select record_id from (select {_VALID} from provenance) where broken",
}
