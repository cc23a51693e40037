"""Language identification of prepared rows by profiles of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellmark.operators import language as L
from quellmark.runtime import Workspace, table


def _labelled(s, d) -> DataFrame:
    """The documents that profiles are fitted on: none of them is judged."""
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), F.upper("lang").alias("lang"), "text")


def _judged(s, d) -> DataFrame:
    return table(s, d, "prepared_rows").select(F.col("source_id").alias("key"), "text")


def _profiles(s, d) -> L.Profiles:
    return L.fit(_labelled(s, d))


def _scored(s, d) -> DataFrame:
    return L.scores(_judged(s, d), _profiles(s, d)).select(F.col("key").alias("source_id"), "features", F.posexplode("scores").alias("k", "s"))


def _detected(s, d) -> DataFrame:
    return L.detect(_judged(s, d), _profiles(s, d))


def _routes(s, d) -> DataFrame:
    codes = table(s, d, "prepared_rows").select(F.col("source_id").alias("key"), F.upper("detector_language").alias("code"))
    return L.routes(_detected(s, d).join(codes, "key"), F.col("code"))


def _averages(s, d) -> DataFrame:
    found = _profiles(s, d).averages
    return s.createDataFrame([(c, round(float(a), 6)) for c, a in zip(L.LANGUAGES, found) if a], "lang string, average double")


#: Languages in registry order; of equal scores the last one wins where no language is detected.
REGISTRY = ("EN", "ZH", "ES", "AR", "ID", "PT", "FR", "HI", "RU", "JA", "DE", "TR", "VI", "KO", "IT")


def _highest(s, d) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, REGISTRY)), F.col("lang"))
    best = _scored(s, d).select("source_id", "s.lang", "s.raw").groupBy("source_id").agg(F.max_by("lang", F.struct("raw", place)).alias("lang"), F.max("raw").cast("long").alias("raw"))
    return best.select("source_id", "lang", "raw")


QUERIES = {
    "highest_locale": _highest,
    "lang_features": lambda s, d: L.feature_lists(_judged(s, d)).select(F.col("key").alias("source_id"), F.explode("features").alias("f")).select("source_id", F.hex("f").alias("feature")),
    "lang_profile_join": lambda s, d: L.profile_table(_labelled(s, d)).select("lang", F.hex("feature").alias("feature"), "weight"),
    "lang_averages": _averages,
    "lang_raw_scores": lambda s, d: _scored(s, d).select("source_id", "s.lang", F.col("s.raw").cast("long").alias("raw")),
    "lang_rank": lambda s, d: _scored(s, d).select("source_id", "s.lang", (F.col("k") + 1).cast("long").alias("rank"), F.round("s.score", 6).alias("score")),
    "lang_margin": lambda s, d: _detected(s, d).where("lang is not null").select(F.col("key").alias("source_id"), F.round(F.col("top") - F.col("second"), 6).alias("margin")),
    "lang_detect": lambda s, d: _detected(s, d).select(F.col("key").alias("source_id"), "lang", "reliable"),
    "route_rates": _routes,
}

_CUT = rf"""case when octet_length(encode(text)) <= {L.BYTES} then text else decode(unhex(regexp_replace(left(hex(encode(text)), {2 * L.BYTES}),
    case when regexp_matches(substr(hex(encode(text)), {2 * L.BYTES + 1}, 1), '[89AB]') then '[C-F][0-9A-F]([89AB][0-9A-F])*$' else '$^' end, chr(0)[:0]))) end"""


def _lists(name: str, source: str, columns: str) -> str:
    """(columns, f) of each distinct feature of the texts of `source`, as hexadecimal digits."""
    chunk, many = 2 * L.CHUNK, L.CHUNK
    return rf"""{name}_words as materialized (select {columns}, unnest(regexp_extract_all(lower(t), '{L._TOKEN.pattern.replace("(", "(?:", 1).replace("'", "''")}')) as w from (select *, {_CUT} as t from {source} where text is not null)),
{name}_bytes as materialized (select w, hex(encode(w)) as h, octet_length(encode(w)) as n from (select distinct w from {name}_words)),
{name}_parts as materialized (select w, unnest(case when n <= {many} then ['20' || h || '20'] else list_concat(['20' || left(h, {chunk})],
    list_transform(generate_series({many}, n - {many} - 1, {many}), lambda k: substr(h, (2 * k + 1)::int, {chunk})), [right(h, {chunk}) || '20']) end) as f from {name}_bytes),
{name} as materialized (select distinct {columns}, f from {name}_words join {name}_parts using (w))"""


_LANGS = ", ".join(f"'{c}'" for c in L.LANGUAGES)
_PROFILE = f"""train as (select doc_id, upper(lang) as lang, text from documents where upper(lang) in ({_LANGS}) and doc_id is not null and text is not null),
{_lists("taught", "train", "doc_id, lang")},
totals as (select lang, count(*) as total from train group by lang), counts as (select lang, f, count(*) as n from taught group by lang, f),
shares as materialized (select lang, f, n, n / total as share from counts join totals using (lang)),
sums as (select f, sum(share) as every, sum(n) as texts from shares group by f having sum(n) >= {L.TEXTS}),
profile as materialized (select lang, f, floor({L.WHOLE} * share / every + 1e-9)::bigint as weight from shares join sums using (f) where {L.WHOLE} * share / every + 1e-9 >= 1)"""


def _scores(name: str, lists: str, columns: str) -> str:
    return f"""{name}_sizes as (select {columns}, count(*) as features from {lists} group by {columns}),
{name} as materialized (select {", ".join(f"x.{c}" for c in columns.split(", "))}, p.lang as spoken, 1 + sum(weight)::bigint as raw, any_value(features) as features,
    1 - exp(-{L.SCALE} / any_value(features) * (1 + sum(weight))) as score from {lists} x join {name}_sizes z using ({columns}) join profile p on p.f = x.f group by all)"""


_AVERAGES = f"""{_PROFILE}, {_scores("taught_scores", "taught", "doc_id, lang")},
averages as (select t.lang, avg(coalesce(score, 0)) as average from train t left join taught_scores s on s.doc_id = t.doc_id and s.spoken = t.lang group by t.lang)"""
_RAW = f"""{_AVERAGES}, judged as (select source_id, text from prepared_rows where source_id is not null and text is not null), {_lists("own", "judged", "source_id")}, {_scores("scored", "own", "source_id")},
ranked as materialized (select source_id, spoken as lang, raw, score, features, row_number() over w as rank, coalesce(lead(score) over w, 0) as second from scored window w as (partition by source_id order by raw desc, list_position([{_LANGS}], spoken))),
detected as (select j.source_id, r.lang, coalesce(features >= {L.LEAST} and score >= {L.SHARE} * average and score - second > {L.LEAD}, false) as reliable from judged j left join ranked r on r.source_id = j.source_id and rank = 1 left join averages a on a.lang = r.lang)"""
SQL = {
    "lang_features": f"with {_lists('own', 'prepared_rows', 'source_id')} select source_id, f as feature from own",
    "lang_profile_join": f"with {_PROFILE} select lang, f as feature, weight from profile",
    "lang_averages": f"with {_AVERAGES} select lang, round(average, 6) as average from averages where average > 0",
    "lang_raw_scores": f"with {_RAW} select source_id, lang, raw from ranked",
    "lang_rank": f"with {_RAW} select source_id, lang, rank, round(score, 6) as score from ranked",
    "lang_margin": f"with {_RAW} select source_id, round(score - second, 6) as margin from ranked where rank = 1",
    "lang_detect": f"with {_RAW} select source_id, lang, reliable from detected",
    "highest_locale": f"with {_RAW}, r as (select *, row_number() over (partition by source_id order by raw desc, list_position([{', '.join(repr(c) for c in REGISTRY)}], lang) desc) as k from ranked) select source_id, lang, raw from r where k = 1",
    "route_rates": f"""with {_RAW}, e as (select d.*, case when upper(detector_language) in ({_LANGS}) then upper(detector_language) else 'unsupported' end as expected from detected d join prepared_rows p using (source_id)),
        c as (select expected, count(*) as rows, count(*) filter (reliable and lang = expected) as correct, count(*) filter (not reliable) as unknown, count(*) filter (reliable and lang <> expected) as misrouted from e group by 1)
        select *, round(correct / rows, 6) as route_accuracy, round(unknown / rows, 6) as unknown_rate, round(misrouted / rows, 6) as misroute_rate,
        coalesce(round(correct / nullif(correct + misrouted, 0), 6), 0) as known_route_precision, case when expected = 'unsupported' then round(unknown / rows, 6) end as unsupported_rejection_rate from c""",
}
