"""Rules, language profiles, masking and score fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quellmark import judge as J
from quellmark.functions.features import BINS
from quellmark.operators import linear_model as L
from quellmark.operators import rule_pack as P
from quellmark.operators import rules as R
from quellmark.operators.masking import MASK, masked
from quellmark.plans import sqlbits as B
from quellmark.plans.language_queries import _profiles as language_profiles
from quellmark.plans.model_queries import Trained
from quellmark.plans.text_queries import SQL as TEXT_SQL
from quellmark.plans.text_queries import _matches, _SPANS
from quellmark.runtime import Workspace, table

#: Languages of words that the pack knows; other messages are read as English.
LANGS = tuple(dict.fromkeys(lang for lang, *_ in P.default_pack()))
SPOKEN = tuple(c for c in LANGS if c not in P.COMPACT)


def messages(s, d):
    """row_id, lang, text of the corpus rows, with the language of their prepared row, and of the fixture's paired messages."""
    code = F.upper(F.trim("detector_language"))
    codes = table(s, d, "prepared_rows").select("source_id", F.when(code.isin(*LANGS), code).alias("code"))
    rows = table(s, d, "corpus_rows").select("row_id", "source_id", "text").join(codes, "source_id", "left")
    rows = rows.where("row_id is not null and text is not null").select("row_id", F.coalesce("code", F.lit("EN")).alias("lang"), "text")
    return rows.union(s.createDataFrame([m[:3] for m in P.MESSAGES], "row_id long, lang string, text string"))


def spoken(s, d):
    return messages(s, d).where(F.col("lang").isin(*SPOKEN))


def judged(s, d):
    return R.events(spoken(s, d))


def _shown(s, d, event):
    return judged(s, d).where(F.col("event") == event).select("row_id", "event", "first", "last", "points")


def _exact(s, d):
    """Events of propositions that are one implicit phrase."""
    rows = [r for r in P.default_pack() if r[1] in R.IMPLICIT or r[1] in ("boundary", "report", "counterspeech")]
    return R.events(spoken(s, d), rows).select("row_id", "event", "first", "last", "suppressor")


def _scores(s, d):
    live = judged(s, d).withColumn("points", F.when(F.col("suppressor").isNull(), F.col("points")).otherwise(0))
    category = F.coalesce(*(F.when(F.col("event") == e, F.lit(c)) for e, c in R.CATEGORY.items()))
    cells = {c: F.max(F.when(category == c, F.col("points")).otherwise(0)) for c in sorted(set(R.CATEGORY.values()))}
    return live.groupBy("row_id").agg(*(c.alias(n) for n, c in cells.items()))


def _clause_sentiment(s, d):
    """Per message the largest proposition sum of sentiment phrases (1 each, 2 after a negator in the clause), at most 8."""
    found = R.phrase_hits(spoken(s, d)).where(F.col("role").isin("sentiment", "negator"))
    per = found.groupBy("row_id").agg(F.count_if(F.col("role") == "sentiment").alias("n"), F.bool_or(F.col("role") == "negator").alias("neg"))
    return per.select("row_id", F.least(F.lit(8), F.col("n") * F.when(F.col("neg"), 2).otherwise(1)).alias("sentiment"))


def _budget(s, d):
    """Suppressed hits earn 10 each, 10 a message in all, in order of their spans."""
    order = Window.partitionBy("row_id").orderBy("first", "last", "event").rowsBetween(Window.unboundedPreceding, -1)
    low = judged(s, d).where("suppressor is not null").withColumn("p", F.least("points", F.lit(10)))
    given = F.greatest(F.lit(0), F.least(F.col("p"), 10 - F.coalesce(F.sum("p").over(order), F.lit(0))))
    return low.select("row_id", "event", "first", "last", given.cast("int").alias("given"))


def _fused(s, d):
    """The larger of rule points and model score, the model at most 49 where an event was suppressed."""
    v = Trained(s, d).verdicts.select("row_id", "score").join(R.scored(judged(s, d)), "row_id", "left")
    model = F.when(F.coalesce("capped", F.lit(False)), F.least("score", F.lit(49))).otherwise(F.col("score"))
    return v.select("row_id", F.greatest(F.coalesce("rule", F.lit(0)), model).cast("int").alias("score"))


def _merged(s, d):
    """Merged spans of each message's matches: a span that begins within or right after the one before joins it."""
    m = _matches(s, d).select("row_id", "first", "last").distinct()
    w = Window.partitionBy("row_id").orderBy("first", "last")
    far = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = m.withColumn("new", F.when(far.isNull() | (F.col("first") > far), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [masked(text, [(x["first"], x["last"]) for x in spans]) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row_id", "masked"])


def _masked(s, d):
    spans = _merged(s, d).groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = table(s, d, "corpus_rows").select("row_id", "text").join(spans, "row_id")
    return rows.select("row_id", "text", "spans").mapInArrow(_mask, "row_id long, masked string")


def _threat_list(s, d):
    return R._applied(messages(s, d).where("lang = 'ES'"), None, "row_id long, first int, last int", R.listed_threats)


def _audit(s, d):
    """Every validation row: length, model score, rule points, whether evidence is suppressed, the verdict and whether it is right."""
    rows = table(s, d, "corpus_rows").select("row_id", F.length("text").alias("length"))
    v = Trained(s, d).verdicts.where("split = 'validation' and label is not null").join(rows, "row_id").join(R.scored(judged(s, d)), "row_id", "left")
    capped = F.coalesce("capped", F.lit(False))
    fused = F.greatest(F.coalesce("rule", F.lit(0)), F.when(capped, F.least("score", F.lit(49))).otherwise(F.col("score")))
    return v.select("row_id", "label", "length", "raw", "score", F.coalesce("rule", F.lit(0)).alias("rule"), capped.alias("suppressed"), (fused >= 50).alias("flag"), ((fused >= 50) == (F.col("label") == "toxic")).alias("agrees"))


def message_judge(s, d, grawlix=True):
    """The judge of the trained model in every locale, routed by profiles of documents, with the rule pack and the German lexicon."""
    t = Trained(s, d)
    weights = {r["bin"]: r["weight"] for r in L.logodds_weights(t.counts, t.totals).collect()}  # at most 65,536 rows
    vector = np.zeros(BINS, np.int64)
    vector[list(weights)] = list(weights.values())
    model = J.Model(vector, L.logodds_bias(t.counts, t.totals).first()["bias"], t.boundary, L.score_scale(t.validation, t.boundary).first()["scale"])
    entries = [(r["id"], r["lemma"]) for r in table(s, d, "lexicon_de").where("id is not null and lemma is not null").collect()]  # a fixed table
    return J.MessageJudge(dict.fromkeys(J.REGISTRY, model), language_profiles(s, d), lexicons={"DE": entries}, grawlix=grawlix)


def _judge_lines(s, d):
    return J.lines(message_judge(s, d).judge(table(s, d, "corpus_rows").select("row_id", "text"))).select("row_id", "line")


def _exit_codes(s, d):
    """What a run over each file of messages ends with: 1 if any is unsafe, else 0."""
    judged = message_judge(s, d, False).judge(table(s, d, "corpus_raw").select("file_name", F.col("line").alias("text")))
    return judged.groupBy("file_name").agg(F.max(F.when(F.col("judgement.safe"), 0).otherwise(1)).alias("code"), F.count(F.lit(1)).alias("messages"))


_AREAS = ("profanity", "targeted_abuse", "threat_language", "sentiment_support")
QUERIES = {
    "phrase_find": lambda s, d: R.phrase_hits(spoken(s, d)),
    "propositions": lambda s, d: R.propositions(spoken(s, d)),
    "asof_intent": lambda s, d: R.harm_frames(spoken(s, d)).select("row_id", "first", "intent"),
    "proximity_target": lambda s, d: R.harm_frames(spoken(s, d)).select("row_id", "first", "target"),
    "rule_threat": lambda s, d: _shown(s, d, "threat"),
    "rule_wish": lambda s, d: _shown(s, d, "wish"),
    "rule_insult": lambda s, d: _shown(s, d, "insult"),
    "rule_self_harm": lambda s, d: _shown(s, d, "self_harm"),
    "rule_sentiment": lambda s, d: _shown(s, d, "sentiment"),
    "exact_phrase_event": _exact,
    "rule_suppression": lambda s, d: judged(s, d).select("row_id", "event", "first", "last", "suppressor", "by_first", "by_last"),
    "suppress_sparse": lambda s, d: judged(s, d).groupBy("row_id").agg(F.bool_or(F.col("suppressor").isNotNull()).alias("capped")),
    "category_scores": _scores,
    "policy_action": lambda s, d: _scores(s, d).select("row_id", F.when(F.col("threat_language") > 0, "block").when(F.col("targeted_abuse") > 0, "review").otherwise("allow").alias("action")),
    "clause_sentiment": _clause_sentiment,
    "suppressed_budget": _budget,
    "es_targeted_sum": lambda s, d: judged(s, d).where("suppressor is null").groupBy("row_id").agg(F.least(F.lit(100), F.sum("points")).alias("targeted")),
    "es_threats": _threat_list,
    "compact_rules": lambda s, d: R.events(messages(s, d).where(F.col("lang").isin(*P.COMPACT))),
    "validation_audit": _audit,
    "judge_lines": _judge_lines,
    "judge_exit": _exit_codes,
    "evidence_ranges": lambda s, d: R.evidence_ranges(judged(s, d)),
    "fuse_score": _fused,
    "evidence_sorted": lambda s, d: judged(s, d).groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "event"))), lambda x: F.concat_ws(":", x["first"], x["last"], x["event"])), ";").alias("evidence")),
    "span_merge": _merged,
    "grawlix_mask": _masked,
}

_LIST = ", ".join(f"'{c}'" for c in LANGS)
_MESSAGES = f"""messages as materialized (select c.row_id, case when upper(trim(p.detector_language)) in ({_LIST}) then upper(trim(p.detector_language)) else 'EN' end as lang, c.text
    from corpus_rows c left join prepared_rows p on p.source_id = c.source_id where c.row_id is not null and c.text is not null
    union all select * from (values {", ".join("(" + str(i) + ", '" + lang + "', '" + text.replace("'", "''") + "')" for i, lang, text, _ in P.MESSAGES)}) as v(row_id, lang, text)),
spoken as materialized (select * from messages where lang in ({", ".join(f"'{c}'" for c in SPOKEN)})),
pack as materialized (select * from (values {", ".join(f"('{lang}', '{r}', '{p}', {len(p.split())})" for lang, r, p in P.default_pack() if lang in SPOKEN)}) as p(lang, role, phrase, n))"""
_HITS = f"""{_MESSAGES},
tok as materialized (select k.row_id, k.pos, k.token, k.first, k.last, k.clause, k.scope, c.lang, c.text, length(left(c.text, k.first)) - length(replace(left(c.text, k.first), '"', chr(0)[:0])) as marks,
    contains(c.text[k.last + 1:], '"') as shut, exists (select 1 from pack b where b.lang = c.lang and b.role = 'boundary' and b.phrase = k.token) as edge
    from ({TEXT_SQL["context_tokens"].replace("from corpus_rows", "from spoken")}) k join spoken c on c.row_id = k.row_id),
counted as (select *, sum(length(token)) over w - length(token) as before, sum(length(token)) over w as after, regexp_matches(text[last + 1:coalesce(lead(first) over w, length(text))], '[?؟？]') as asked,
    (pos > 0 and (clause <> lag(clause) over w or lag(edge) over w) or edge)::int as cut from tok window w as (partition by row_id order by pos)),
placed as materialized (select * exclude (text), sum(cut) over (partition by row_id order by pos) as prop from counted),
props as materialized (select row_id, lang, prop, min(pos) as p_first, max(pos) + 1 as p_last, string_agg(token, ' ' order by pos) as words, arg_max(asked, pos) as asked from placed where not edge group by all),
runs as (select *, token as g1, token || ' ' || lead(token) over w as g2, token || ' ' || lead(token) over w || ' ' || lead(token, 2) over w as g3, lead(clause) over w as c2, lead(clause, 2) over w as c3,
    lead(after) over w as a2, lead(after, 2) over w as a3, lead(prop) over w as p2, lead(prop, 2) over w as p3 from placed window w as (partition by row_id order by pos)),
hits as materialized (select row_id, r.lang, role, pos as first, pos + n as last, case when n = 1 or n = 2 and p2 = prop or n = 3 and p3 = prop then prop end as prop, clause, scope, before, case n when 1 then after when 2 then a2 else a3 end as after
    from runs r join pack k on k.lang = r.lang and (n = 1 and phrase = g1 or n = 2 and phrase = g2 and c2 = clause or n = 3 and phrase = g3 and c3 = clause))"""


def _r(role: str) -> str:
    return f"(select * from hits where role = '{role}' and prop is not null)"


def _near(name: str, anchors: str) -> str:
    """`anchors` (row_id, prop, a_first, a_last, floor, ...) with t, [first, last] of their target."""
    return f"""{name} as materialized (select a.*, t from {anchors} a left join (select a.row_id, a.prop, a.a_first, a.a_last, a.floor,
    coalesce(min(case when t.first >= a.a_last and t.first - a.a_last <= {R.NEAR_WORDS} then [t.first, t.last] end), max(case when t.first >= a.floor and t.last <= a.a_first and a.a_first - t.last <= {R.NEAR_WORDS} then [t.first, t.last] end)) as t
    from {anchors} a join {_r('target')} t on t.row_id = a.row_id and t.prop = a.prop group by all) x using (row_id, prop, a_first, a_last, floor))"""


_INTENTS = f"""{_HITS}, prior as (select h.row_id, h.first, h.last, max([i.last, i.first, i.after::bigint]) as i from {_r('harm')} h join {_r('intent')} i on i.row_id = h.row_id and i.prop = h.prop and i.last <= h.first group by all),
intents as materialized (select h.row_id, h.prop, h.first as a_first, h.last as a_last, case when h.before - i[3] <= {R.GAP} then i end as i, p_first, asked from {_r('harm')} h left join prior using (row_id, first, last) join props using (row_id, prop)),
harms as (select *, coalesce(i[2], p_first) as floor from intents)"""
_TARGETS = f"{_INTENTS}, {_near('aimed', 'harms')}"
_EVENTS = f"""{_TARGETS},
threats as (select row_id, prop, 'threat' as event, least(a_first, i[2], t[1]) as f, greatest(a_last, i[1], t[2]) as l, a_first as main from aimed where t is not null and (i is not null or a_first = p_first and t[1] >= a_last and not asked)),
hoped as (select w.row_id, w.prop, w.first as floor, w.last as w_last, min([o.first, o.last]) as o from {_r('wish')} w join {_r('outcome')} o on o.row_id = w.row_id and o.prop = w.prop and o.first >= w.last and o.before - w.after <= {R.GAP} group by all),
outcomes as (select row_id, prop, floor, w_last, o[1] as a_first, o[2] as a_last from hoped), {_near('wished', 'outcomes')},
wishes as (select row_id, prop, 'wish', least(floor, a_first, t[1]), greatest(w_last, a_last, t[2]), a_first from wished where t is not null),
called as (select s.row_id, s.prop, s.first as a_first, s.last as a_last, p_first as floor from {_r('insult')} s join props using (row_id, prop)), {_near('thrown', 'called')},
insults as (select row_id, prop, 'insult', least(a_first, t[1]), greatest(a_last, t[2]), a_first from thrown x where t is not null and (t[2] = a_first or exists (select 1 from {_r('copula')} c where c.row_id = x.row_id and c.prop = x.prop and c.first >= t[2] and c.last <= a_first))),
commands as (select row_id, prop, 'self_harm', first, last, first from {_r('self_harm')}),
implied as (select row_id, prop, replace(role, 'implicit_', '') as event, p_first as f, p_last as l, null::int as main from props join pack on pack.lang = props.lang and pack.phrase = props.words and starts_with(role, 'implicit_')),
strong as materialized (select * from threats union all select * from wishes union all select * from insults union all select * from commands union all select * from implied),
felt as (select s.row_id, s.prop, s.first as a_first, s.last as a_last, p_first as floor from {_r('sentiment')} s join props using (row_id, prop)), {_near('voiced', 'felt')},
moods as (select row_id, prop, 'sentiment' as event, least(a_first, t[1]) as f, greatest(a_last, t[2]) as l, a_first as main from voiced where t is not null),
sentiments as (select * from moods n where not exists (select 1 from strong e where e.row_id = n.row_id and e.f < n.l and n.f < e.l) and not exists (select 1 from moods e where e.row_id = n.row_id and e.main < n.main and e.f < n.l and n.f < e.l)),
events as materialized (select row_number() over () as e, *, case event when 'threat' then 95 when 'wish' then 85 when 'self_harm' then 95 when 'insult' then 70 else 20 end as points from (select * from strong union all select * from sentiments)),
begun_at as materialized (select e.*, p.before, m.clause, m.scope, p.marks % 2 = 1 and q.marks = p.marks and q.shut as quoted from events e join placed p on p.row_id = e.row_id and p.pos = e.f join placed q on q.row_id = e.row_id and q.pos = e.l - 1 join placed m on m.row_id = e.row_id and m.pos = coalesce(e.main, e.f)),
ranked as (select e.e, min(case when role = 'negator' and e.main is not null and m.prop = e.prop and m.clause = e.clause and m.scope = e.scope and (m.first >= e.f and m.last <= e.l or m.last <= e.f and e.before - m.after <= {R.GAP}) then [1, m.first, m.last]
    when role = 'counterspeech' and m.last = e.f and m.clause = e.clause then [2, m.first, m.last] when role = 'report' and m.last = e.f and m.clause = e.clause then [3, m.first, m.last] end) as r from begun_at e join hits m on m.row_id = e.row_id and m.role in ('negator', 'counterspeech', 'report') group by e.e),
judged as materialized (select b.*, case when quoted then 'quoted' when r[1] = 1 then 'negated' when r[1] = 2 then 'counterspeech' when r[1] = 3 then 'reported' end as suppressor, (case when quoted then f else r[2] end)::int as by_first, (case when quoted then l else r[3] end)::int as by_last from begun_at b left join ranked using (e))"""


def _shown_sql(source: str, where: str = "true") -> str:
    return f"with {_EVENTS} select row_id, event, f::int as first, l::int as last, points from {source} where {where}"


_CELLS = "max(case when event in ('threat', 'wish', 'self_harm') and suppressor is null then points else 0 end) as threat_language, max(case when event = 'insult' and suppressor is null then points else 0 end) as targeted_abuse, max(case when event = 'sentiment' and suppressor is null then points else 0 end) as sentiment_support"
_MERGED = f"{_SPANS}, m as (select distinct row_id, first, last from spans), fr as (select *, max(last) over (partition by row_id order by first, last rows between unbounded preceding and 1 preceding) as far from m), isl as (select *, sum((far is null or first > far)::int) over (partition by row_id order by first, last rows unbounded preceding) as island from fr), merged as materialized (select row_id, min(first) as first, max(last) as last from isl group by row_id, island)"

SQL = {
    "phrase_find": f"with {_HITS} select row_id, lang, role, first::int as first, last::int as last from hits",
    "propositions": f"with {_HITS} select row_id, p_first::int as first, p_last::int as last from props",
    "asof_intent": f"with {_INTENTS} select row_id, a_first::int as first, i[2]::int as intent from intents",
    "proximity_target": f"with {_TARGETS} select row_id, a_first::int as first, t[1]::int as target from aimed",
    "rule_threat": _shown_sql("events", "event = 'threat'"),
    "rule_wish": _shown_sql("events", "event = 'wish'"),
    "rule_insult": _shown_sql("events", "event = 'insult'"),
    "rule_self_harm": _shown_sql("events", "event = 'self_harm'"),
    "rule_sentiment": _shown_sql("events", "event = 'sentiment'"),
    "exact_phrase_event": f"with {_EVENTS} select row_id, event, f::int as first, l::int as last, suppressor from judged where main is null",
    "rule_suppression": f"with {_EVENTS} select row_id, event, f::int as first, l::int as last, suppressor, by_first, by_last from judged",
    "suppress_sparse": f"with {_EVENTS} select row_id, bool_or(suppressor is not null) as capped from judged group by 1",
    "suppressed_budget": f"with {_EVENTS}, low as (select row_id, event, f, l, least(points, 10) as p from judged where suppressor is not null) select row_id, event, f::int as first, l::int as last, greatest(0, least(p, 10 - coalesce(sum(p) over (partition by row_id order by f, l, event rows between unbounded preceding and 1 preceding), 0)))::int as given from low",
    "evidence_sorted": f"with {_EVENTS} select row_id, string_agg(f || ':' || l || ':' || event, ';' order by f, l, event) as evidence from judged group by 1",
    "evidence_ranges": f"with {_EVENTS} select distinct j.row_id, p.first, q.last from judged j join placed p on p.row_id = j.row_id and p.pos = coalesce(j.by_first, j.f) join placed q on q.row_id = j.row_id and q.pos = coalesce(j.by_last, j.l) - 1",
    "validation_audit": f"with {B.CURVE}, {_EVENTS}, j as (select row_id, max(case when suppressor is null then points else 0 end) as rule, bool_or(suppressor is not null) as capped from judged group by 1), f as (select v.row_id, v.label, length(c.text)::int as length, raw, score, coalesce(rule, 0)::int as rule, coalesce(capped, false) as suppressed, greatest(coalesce(rule, 0), case when coalesce(capped, false) then least(score, 49) else score end) >= 50 as flag from verdicts v join corpus_rows c on c.row_id = v.row_id left join j on j.row_id = v.row_id where v.split = 'validation' and v.label is not null) select *, flag = (label = 'toxic') as agrees from f",
    "fuse_score": f"with {B.CURVE}, {_EVENTS}, j as (select row_id, max(case when suppressor is null then points else 0 end) as rule, bool_or(suppressor is not null) as capped from judged group by 1) select v.row_id, greatest(coalesce(rule, 0), case when coalesce(capped, false) then least(score, 49) else score end)::int as score from verdicts v left join j on j.row_id = v.row_id",
    "category_scores": f"with {_EVENTS} select row_id, {_CELLS} from judged group by row_id",
    "policy_action": f"with {_EVENTS}, c as (select row_id, {_CELLS} from judged group by row_id) select row_id, case when threat_language > 0 then 'block' when targeted_abuse > 0 then 'review' else 'allow' end as action from c",
    "clause_sentiment": f"with {_HITS} select row_id, least(8, count(*) filter (role = 'sentiment') * case when bool_or(role = 'negator') then 2 else 1 end) as sentiment from hits where role in ('sentiment', 'negator') group by 1",
    "es_targeted_sum": f"with {_EVENTS} select row_id, least(100, sum(points))::bigint as targeted from judged where suppressor is null group by 1",
    "span_merge": f"with {_MERGED} select row_id, first::int as first, last::int as last from merged",
    "grawlix_mask": rf"with {_MERGED}, ch as (select c.row_id, k, text[k] as x from corpus_rows c, lateral (select unnest(generate_series(1, length(text))) as k) where row_id in (select row_id from merged)), mk as (select ch.row_id, k, case when m.row_id is not null and not regexp_matches(x, '\s') then substr('{MASK}', ((k - 1 - m.first) % {len(MASK)} + 1)::int, 1) else x end as y from ch left join merged m on m.row_id = ch.row_id and k > m.first and k <= m.last) select row_id, string_agg(y, '' order by k) as masked from mk group by row_id",
}
