"""Training, checks of evidence, and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quellmark.functions import features as X
from quellmark.functions.features import BINS
from quellmark.operators import linear_model as L
from quellmark.operators import logistic as G
from quellmark.plans import sqlbits as B
from quellmark.plans.model_queries import MINIMUM, Trained
from quellmark.runtime import Workspace, table
from quellmark.sources import adapters as A
from quellmark.sources import sinks as K
from quellmark.streaming.judge import stream_judge

#: Small fixtures, the same for both engines: (columns, rows).
FIXTURES = {
    "panel": ("case_id, language, expected, pair_id, control, evidence, text", [
        ("c1", "EN", True, "p1", "none", "r1", "you are a spoon"), ("c2", "EN", False, "p1", "quotation", "r1", "she said spoon"),
        ("c3", "EN", True, "p2", "none", "r2", "you muppet"), ("c4", "EN", False, "p3", "negation", "r9", "no muppet")]),
    "registry": ("evidence, language", [("r1", "EN"), ("r2", "DE")]),
    "actual": ("case_id, flagged", [("c1", True), ("c2", False), ("c3", False), ("c4", False)]),
    "runs": ("path, retrained, version, section, stamp", [("a", True, 1, "test", 5), ("b", True, 1, "test", 7), ("c", True, 1, "test", 7), ("d", False, 1, "test", 9)]),
    "timings": ("name, p95", [("en-short", 1.0), ("de-short", 3.0), ("fr-short", 2.0), ("en-long", 9.0), ("de-long", 5.0)]),
}


def _literal(v) -> str:
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def fixture(s, name):
    columns, rows = FIXTURES[name]
    return s.createDataFrame(rows, columns.split(", "))


def _cte(*names: str) -> str:
    return "with " + ", ".join(f"{n}({FIXTURES[n][0]}) as (values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in FIXTURES[n][1])})" for n in names)


def _votes(s, d):
    cats = ("homophobia", "obscene", "insult", "racism", "misogyny", "xenophobia")
    votes = [F.greatest(*(F.coalesce(f"{c}_{k}", F.lit(0.0)) for c in cats)).cast("int") for k in (1, 2, 3)]
    label, reason = A.vote_label(votes)
    return table(s, d, "told_br_alpha").select("item_id", label.alias("label"), reason.alias("reason"))


def _pairs(s, d):
    p = fixture(s, "panel")
    toxic, clean = p.where("expected").select("pair_id", F.col("case_id").alias("toxic")), p.where("not expected").groupBy("pair_id").agg(F.count(F.lit(1)).alias("controls"))
    return toxic.join(clean, "pair_id", "full").select("pair_id", F.when(F.col("toxic").isNull(), "unknown pair").when(F.col("controls").isNull(), "missing control").when(F.col("controls") > 1, "duplicate control").otherwise("ok").alias("status"))


def _evidence_check(s, d):
    """Recorded matches whose text isn't what their place in the row says, and whose view can't be right for it."""
    m = table(s, d, "lexicon_matches").join(table(s, d, "corpus_rows").select("row_id", "text"), "row_id")
    raw = F.decode(F.substring(F.col("text").cast("binary"), F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start")), "UTF-8")
    return m.select("match_id", (raw == F.col("matched_text")).alias("same_text"), (F.octet_length("matched_text") == F.col("raw_end") - F.col("raw_start")).alias("same_length"))


#: The grid of the ablation: costs, class weights, and blends of the naive Bayes model.
COSTS, BETAS = (0.05, 0.15, 0.5, 1.0, 2.0), (1.0, 0.25)


def _rows(s, d, split, carry=("label",)):
    """Bins of the labelled rows of a split."""
    return X.with_bins(table(s, d, "corpus_rows").where("text is not null and label is not null").where(F.col("split") == split), carry=carry)


def _told(s, d):
    """The development rows as the fits read them, from their texts."""
    rows = table(s, d, "corpus_rows").where("text is not null and label is not null and split = 'development'").select("label", "text")
    cores = s.sparkContext.defaultParallelism
    return G.Rows(rows.repartition(cores * -(-rows._jdf.queryExecution().toRdd().getNumPartitions() // cores)))  # in each pass all cores have as much to do


def _counts(s, rows):
    """bin, toxic, clean of the training rows; at most 65,536 rows."""
    clean, toxic = rows.counts[:, :BINS]
    used = np.flatnonzero(clean + toxic)
    return s.createDataFrame(pd.DataFrame({"bin": used, "toxic": toxic[used], "clean": clean[used]}), "bin long, toxic long, clean long")


def naive_bayes(counts):
    """(ratios per bin, kept bins) of the training counts; at most 65,536 rows reach the driver."""
    found = L.nb_ratios(counts).collect()
    active, ratios = np.array([r["bin"] for r in found], np.int64), np.zeros(BINS)
    ratios[active] = [r["ratio"] for r in found]
    return ratios, active


def _table(s, weights):
    """bin, weight and the bias of a model, in units of 1/256."""
    kept = s.createDataFrame([(int(b), float(weights[b])) for b in np.flatnonzero(weights[:BINS])], "bin long, weight double")
    bias = s.createDataFrame([(float(weights[BINS]),)], "bias double")
    return kept.select("bin", L.quantize(F.col("weight")).alias("weight")), bias.select(L.quantize(F.col("bias"), L.I32).alias("bias"))


def _units(weights):
    """(weight of each bin, bias) of a fitted model, in units of 1/256."""
    return L.quantized(weights[:BINS]), int(L.quantized(weights[BINS:], L.I32)[0])


def _log_odds(counts, totals):
    """(weight of each bin, bias) of the log-odds model; at most 65,536 rows reach the driver."""
    lookup = np.zeros(BINS, np.int64)
    for r in L.logodds_weights(counts, totals).collect():
        lookup[r["bin"]] = r["weight"]
    return lookup, L.logodds_bias(counts, totals).first()["bias"]


def _logistic(s, d, scaled=False):
    """Weights per bin of the L2-regularised logistic model; with `scaled` of the one on bins scaled by naive Bayes ratios."""
    rows = _told(s, d)
    ratios, active = naive_bayes(_counts(s, rows)) if scaled else (None, None)
    (found,) = G.fit(rows, [G.Setting(scaled=scaled)], ratios, 1e-5)
    rows.drop()
    return _table(s, G.blended(found, ratios, active) if scaled else found)[0]


def _ablation(s, d):
    """Every learner of the grid, calibrated on the validation rows: its boundary and confusion there, or why it has none."""
    work, rows = Workspace(s, "ablation"), _told(s, d)
    counts, (clean, toxic) = _counts(s, rows), map(int, rows.counts[:, BINS])
    totals = s.createDataFrame([(toxic, clean)], "nt long, nc long")
    ratios, active = naive_bayes(counts)
    settings = [G.Setting(c, b) for b in (False, True) for c in COSTS] + [G.Setting(scaled=True)]
    fitted = G.fit(rows, settings, ratios, 1e-4)
    rows.drop()
    models = [("log_odds", None, False, None, _log_odds(counts, totals))]
    models += [("logistic", x.cost, x.balanced, None, _units(w)) for x, w in zip(settings[:-1], fitted)]
    models += [("nb_logistic", 1.0, False, beta, _units(G.blended(fitted[-1], ratios, active, beta))) for beta in BETAS]
    scores = work.keep(L.grid_scores(_rows(s, d, "validation"), [m[-1] for m in models]))
    best = {r["model"]: r for r in L.grid_boundaries(scores, len(models), MINIMUM).collect()}  # a row per model
    out = []
    for k, (name, cost, balanced, beta, _) in enumerate(models):
        found = best.get(k)
        out.append((name, cost, balanced, beta, *((found["boundary"], found["tp"], found["fp"], found["tn"], found["fn"], None) if found else (None,) * 5 + ("no boundary passes the gates",))))
    return s.createDataFrame(out, "learner string, cost double, balanced boolean, beta double, boundary long, tp long, fp long, tn long, fn long, error string")


_EVIDENCE = "case when registry.evidence is null then 'unknown' when registry.language <> panel.language then 'other language' else 'ok' end"
QUERIES = {
    "adapter_vote_consensus": _votes,
    "parquet_guard": lambda s, d: table(s, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).select("rows", "bytes", ((F.col("rows") <= 100_000) & (F.col("bytes") <= 64 * 2**20)).alias("within")),
    "behavior_pairs": _pairs,
    "behavior_evidence": lambda s, d: fixture(s, "panel").alias("panel").join(fixture(s, "registry").alias("registry"), "evidence", "left").select("case_id", F.expr(_EVIDENCE).alias("status")),
    "behavior_report": lambda s, d: fixture(s, "panel").join(fixture(s, "actual"), "case_id").groupBy("language").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("expected") == F.col("flagged")).alias("passed"), F.bool_and(F.col("expected") == F.col("flagged")).alias("passes")),
    "latest_run": lambda s, d: fixture(s, "runs").where("retrained and version = 1 and section = 'test'").agg(F.max(F.struct("stamp", "path")).alias("b")).select("b.path", "b.stamp"),
    "p95_summary": lambda s, d: fixture(s, "timings").groupBy(F.split_part("name", F.lit("-"), F.lit(2)).alias("kind")).agg(F.median("p95").alias("middle"), F.max("p95").alias("worst")),
    "evidence_check": _evidence_check,
    "verdict_lines": lambda s, d: (lambda t: t.verdicts.select("row_id", K.verdict_line(F.col("score") < 50, F.col("score"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("line")))(Trained(s, d)),
    "train_logistic": _logistic,
    "train_nb_logistic": lambda s, d: _logistic(s, d, True),
    "ablation": _ablation,
    "stream_judge": stream_judge,
}
_CATS = ("homophobia", "obscene", "insult", "racism", "misogyny", "xenophobia")
_VOTE = " + ".join("greatest(" + ", ".join(f"coalesce({c}_{k}, 0)" for c in _CATS) + ")" for k in (1, 2, 3))
SQL = {
    "evidence_check": "select match_id, decode(encode(text)[raw_start + 1:raw_end]) = matched_text as same_text, octet_length(encode(matched_text)) = raw_end - raw_start as same_length from lexicon_matches m join corpus_rows c on c.row_id = m.row_id",
    "verdict_lines": f"with {B.CURVE} select row_id, format('{{{{\"safe\":{{}},\"score\":{{}},\"locale\":null,\"grawlix\":null}}}}', score < 50, score) as line from verdicts",
    "adapter_vote_consensus": f"with v as (select item_id, {_VOTE} as n from told_br_alpha) select item_id, case when n = 0 then 'clean' when n > 1 then 'toxic' end as label, case when n = 1 then 'ambiguous' end as reason from v",
    "parquet_guard": "select count(*) as rows, sum(octet_length(encode(text)))::bigint as bytes, count(*) <= 100000 and sum(octet_length(encode(text))) <= 67108864 as within from documents",
    "behavior_pairs": f"{_cte('panel')}, t as (select pair_id, case_id from panel where expected), c as (select pair_id, count(*) as n from panel where not expected group by 1) select coalesce(t.pair_id, c.pair_id) as pair_id, case when case_id is null then 'unknown pair' when n is null then 'missing control' when n > 1 then 'duplicate control' else 'ok' end as status from t full join c on t.pair_id = c.pair_id",
    "behavior_evidence": f"{_cte('panel', 'registry')} select case_id, {_EVIDENCE} as status from panel left join registry on panel.evidence = registry.evidence",
    "behavior_report": f"{_cte('panel', 'actual')} select language, count(*) as cases, count(*) filter (expected = flagged) as passed, bool_and(expected = flagged) as passes from panel join actual using (case_id) group by 1",
    "latest_run": f"{_cte('runs')} select path, stamp::bigint as stamp from runs where retrained and version = 1 and section = 'test' order by stamp desc, path desc limit 1",
    "p95_summary": f"{_cte('timings')} select split_part(name, '-', 2) as kind, median(p95) as middle, max(p95) as worst from timings group by 1",
}
