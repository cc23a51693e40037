"""Features, training, scoring, calibration and evaluation over corpus_rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions import features as X
from quellmark.operators import linear_model as L
from quellmark.operators.ordering import nearest_rank
from quellmark.plans import sqlbits as B
from quellmark.runtime import Workspace, table

#: The lowest boundary that calibration may choose.
MINIMUM = 0


class Trained:
    """A model of development rows, calibrated on validation rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        rows = table(spark, sf_dir, "corpus_rows").where("text is not null")
        self.work = Workspace(spark, "model")
        self.featured = self.work.keep(X.with_bins(rows, carry=("split", "label")))
        self.rows = rows.select("row_id", "split", "label")
        self.labelled = self.featured.where("split = 'development' and label is not null")
        self.totals = L.class_totals(self.rows.where("split = 'development' and label is not null"))

    @cached_property
    def counts(self) -> DataFrame:
        return self.work.keep(L.document_counts(self.labelled))

    @cached_property
    def scores(self) -> DataFrame:
        model = L.logodds_weights(self.counts, self.totals), L.logodds_bias(self.counts, self.totals)
        return self.work.keep(L.raw_scores(self.featured, *model, carry=("split", "label")))

    @property
    def validation(self) -> DataFrame:
        return self.scores.where("split = 'validation' and label is not null")

    @cached_property
    def curve(self) -> DataFrame:
        return L.calibration_curve(self.validation, MINIMUM)

    @cached_property
    def boundary(self) -> int:
        found = L.best_boundary(self.curve).first()
        return found["boundary"] if found else L.I32

    @cached_property
    def verdicts(self) -> DataFrame:
        scale = L.score_scale(self.validation, self.boundary).first()["scale"]
        return self.scores.withColumn("score", L.scaled(F.col("raw"), F.lit(self.boundary), F.lit(scale)))


def _summary(profile: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The number, sum and sum of squares of each text's bins."""
        rows = table(spark, sf_dir, "corpus_rows").where("text is not null")
        squares = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
        total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
        return X.with_bins(rows, profile).select("row_id", F.size("bins").cast("long").alias("bins"), total.alias("bin_sum"), squares.alias("bin_squares"))

    return query


def _flags(t: Trained) -> DataFrame:
    return t.verdicts.where("label is not null and split is not null").withColumn("flag", F.col("score") >= 50)


def _metric_rows(spark, d):
    return L.confusion(_flags(Trained(spark, d)), "split").select("split", *(c.alias(n) for n, c in L.metrics().items()))


def _rollup(spark, d):
    flags = _flags(Trained(spark, d))
    toxic, flag = F.col("label") == "toxic", F.col("flag")
    cells = {"tp": toxic & flag, "fp": ~toxic & flag, "tn": ~toxic & ~flag, "fn": toxic & ~flag}
    return flags.rollup("split").agg(*(F.count_if(c).alias(n) for n, c in cells.items())).withColumn("split", F.coalesce("split", F.lit("pooled")))


def _projected(spark, d):
    cells = L.confusion(_flags(Trained(spark, d)), "split")
    rate = F.round(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")), 6)
    return cells.select("split", rate.alias("false_warning_rate"), L.projected_precision(0.01).alias("at_1_percent"), L.projected_precision(0.05).alias("at_5_percent"))


def _scaled(spark, d):
    return Trained(spark, d).verdicts.select("row_id", "score")


def _judge(spark, d):
    """safe, score and split of every row: unsafe from 50 on; rows without a split are still judged."""
    v = Trained(spark, d).verdicts
    return v.select("row_id", (F.col("score") < 50).alias("safe"), (F.col("score") / 100).alias("score"))


def _fail_open(spark, d):
    """Rows whose source has no language route are safe with score 0."""
    routed = table(spark, d, "prepared_rows").select("source_id", F.upper("detector_language").alias("locale")).where(F.col("locale").rlike("^[A-Z]{2}$") & (F.col("locale") != "XX"))
    rows = table(spark, d, "corpus_rows").select("row_id", "source_id")
    v = Trained(spark, d).verdicts.select("row_id", "score").join(rows, "row_id").join(routed, "source_id", "left")
    known = F.col("locale").isNotNull()
    return v.select("row_id", F.when(known, F.col("score") < 50).otherwise(True).alias("safe"), F.when(known, F.col("score") / 100).otherwise(0.0).alias("score"), "locale")


def _percentiles(spark, d):
    values = table(spark, d, "events").where("value is not null").select("value")
    return nearest_rank(values, "value", (50, 95, 99), values.count())


def _throughput(spark, d):
    e = table(spark, d, "events").agg(F.count(F.lit(1)).alias("samples"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"), F.sum(F.octet_length("props")).alias("bytes"))
    rate = lambda c: F.round(F.when(F.col("us") > 0, F.col(c) * 1e6 / F.col("us")), 6)
    return e.select("samples", rate("samples").alias("per_second"), rate("bytes").alias("bytes_per_second"))


QUERIES = {f"bins_{n}": _summary(p) for n, p in {"wordchar35": "word_char_35", "spanish": "spanish", "turkish": "turkish", "char25": "char_25", "korean": "korean", "chinese": "chinese"}.items()} | {
    "df_counts": lambda s, d: Trained(s, d).counts.select("bin", "toxic", "clean"),
    "rare_feature_filter": lambda s, d: L.kept(Trained(s, d).counts, 5).select("bin", (F.col("toxic") + F.col("clean")).alias("documents")),
    "logodds_weights": lambda s, d: (lambda t: L.logodds_weights(t.counts, t.totals))(Trained(s, d)),
    "logodds_bias": lambda s, d: (lambda t: L.logodds_bias(t.counts, t.totals))(Trained(s, d)),
    "nb_ratios": lambda s, d: L.nb_ratios(Trained(s, d).counts).select("bin", F.round("ratio", 6).alias("ratio")),
    "quantize": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.quantize(F.col("l_discount") - F.col("l_tax")).alias("q")),
    "sparse_raw_score": lambda s, d: Trained(s, d).scores.select("row_id", "raw"),
    "boundary_candidates": lambda s, d: L.boundary_candidates(Trained(s, d).validation, MINIMUM),
    "calibration_curve": lambda s, d: Trained(s, d).curve,
    "calibration_gates": lambda s, d: Trained(s, d).curve.select("boundary", L.passes_gates().alias("passes")),
    "calibrate_best": lambda s, d: L.best_boundary(Trained(s, d).curve),
    "score_scale": lambda s, d: (lambda t: L.score_scale(t.validation, t.boundary))(Trained(s, d)),
    "sparse_scaled_score": _scaled,
    "judge_documents": _judge,
    "fail_open": _fail_open,
    "confusion_matrix": lambda s, d: L.confusion(_flags(Trained(s, d)), "split"),
    "confusion_rollup": _rollup,
    "eval_metrics": _metric_rows,
    "projected_precision": _projected,
    "class_floor": lambda s, d: table(s, d, "corpus_rows").where("split is not null and label is not null").groupBy("split").agg(
        F.count_if(F.col("label") == "toxic").alias("toxic"), F.count_if(F.col("label") == "clean").alias("clean")).withColumn("enough", F.least("toxic", "clean") >= 300),
    "latency_percentiles": _percentiles,
    "throughput": _throughput,
}


def _sum_sql(prelude: str) -> str:
    return f"with {prelude} select row_id, count(bin) as bins, coalesce(sum(bin), 0)::bigint as bin_sum, coalesce(sum(bin::bigint * bin), 0)::bigint as bin_squares from texts left join row_bins using (row_id) group by row_id"


_TEXTS = f"texts as materialized (select row_id, {B.clean('text')} as t from corpus_rows where text is not null)"
_WORDS = f"tokens as materialized (select distinct row_id, unnest(regexp_extract_all(t, '{B.WORD}')) as w from texts)"


def _windows(low: int, high: int, source: str = "tokens") -> str:
    return f"""windows as (select distinct w, n, substr(chr(2) || w || chr(3), i, n) as g from (select distinct w from {source}), (select unnest(generate_series({low}, {high})) as n), lateral (select unnest(generate_series(1, length(w) + 3 - n)) as i)),
hashed as materialized (select n, g, {B.fnv16("[67, n]", "g")} as bin from (select distinct n, g from windows)),
grams as materialized (select distinct w, bin from windows join hashed using (n, g))"""


_SEGMENTS = r"segs as materialized (select distinct row_id, regexp_replace(unnest(regexp_split_to_array(t, '[\p{P}\p{S}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]+')), '\s+', '', 'g') as w from texts)"
_SPANISH = f"""{_TEXTS}, lists as materialized (select row_id, regexp_extract_all(t, '{B.WORD}') as ws from texts), {_WORDS},
pairs as materialized (select distinct row_id, unnest(list_zip(ws[:-2], ws[2:])) as p from lists where len(ws) > 1),
one as (select w, {B.fnv16("[87, 1, 0]", "w")} as bin from (select distinct w from tokens)),
two as (select p, list_reduce(list_concat([87, 2, 0], {B.bytes_of("p[1]")}, [0], {B.bytes_of("p[2]")}), lambda h, b: (xor(h, b) * 435) & 65535, 8997) as bin from (select distinct p from pairs)),
{_windows(3, 5)},
row_bins as (select row_id, bin from tokens join one using (w) union select row_id, bin from tokens join grams using (w) union select row_id, bin from pairs join two using (p))"""
_CHAR25 = f"{_TEXTS}, {_SEGMENTS}, {_windows(2, 5, 'segs')}, seg_bins as (select row_id, bin from segs join grams using (w) where w <> '')"
_KOREAN = f"{_CHAR25}, {_WORDS}, one as (select w, {B.fnv16('[87, 1, 0]', 'w')} as bin from (select distinct w from tokens)), row_bins as (select * from seg_bins union select row_id, bin from tokens join one using (w))"
_CHINESE = rf"""{_TEXTS}, {_SEGMENTS},
windows as (select distinct w, n, substr(chr(2) || w || chr(3), i, n) as g from (select distinct w from segs where w <> ''), (select unnest(generate_series(1, 5)) as n), lateral (select unnest(generate_series(1, length(w) + 3 - n)) as i)),
spaced as (select distinct n, g, case when regexp_full_match(trim(g, chr(2) || chr(3)), '\p{{Han}}+') then 72 when regexp_full_match(trim(g, chr(2) || chr(3)), '\p{{Latin}}+') then 76 else 67 end as ns from windows),
hashed as materialized (select n, g, {B.fnv16("[ns, n]", "g")} as bin from spaced where n > 1 or ns = 72),
grams as materialized (select distinct w, bin from windows join hashed using (n, g)),
row_bins as (select distinct row_id, bin from segs join grams using (w))"""

_FLAGS = f"{B.CURVE}, flags as (select *, score >= 50 as flag, label = 'toxic' as tox from verdicts where label is not null and split is not null)"
_CELLS = "count(*) filter (tox and flag) as tp, count(*) filter (not tox and flag) as fp, count(*) filter (not tox and not flag) as tn, count(*) filter (tox and not flag) as fn"
SQL = {
    "bins_wordchar35": _sum_sql(B.BINS),
    "bins_spanish": _sum_sql(_SPANISH),
    "bins_turkish": _sum_sql(f"{_TEXTS}, {_WORDS}, {_windows(3, 5)}, row_bins as (select distinct row_id, bin from tokens join grams using (w))"),
    "bins_char25": _sum_sql(f"{_CHAR25}, row_bins as (select distinct * from seg_bins)"),
    "bins_korean": _sum_sql(_KOREAN),
    "bins_chinese": _sum_sql(_CHINESE),
    "df_counts": f"with {B.MODEL} select bin, toxic, clean from counts",
    "rare_feature_filter": f"with {B.MODEL} select bin, toxic + clean as documents from counts where toxic + clean >= 5",
    "logodds_weights": f"with {B.MODEL} select * from weights",
    "logodds_bias": f"with {B.MODEL} select bias from bias",
    "nb_ratios": f"with {B.MODEL}, used as (select * from counts where toxic + clean >= 2), s as (select sum(toxic + 1) as st, sum(clean + 1) as sc from used) select bin, round(ln((toxic + 1) / st) - ln((clean + 1) / sc), 6) as ratio from used, s",
    "quantize": "select l_orderkey, l_linenumber, greatest(-32768, least(32767, round((l_discount - l_tax) * 256)))::bigint as q from lineitem",
    "sparse_raw_score": f"with {B.MODEL} select row_id, raw from scores",
    "boundary_candidates": f"with {B.CURVE} select boundary from candidates",
    "calibration_curve": f"with {B.CURVE} select * from curve",
    "calibration_gates": f"with {B.CURVE} select boundary, (10000 * fp <= 300 * (fp + tn) and 100 * tp >= 90 * (tp + fp) and tp > 0) as passes from curve",
    "calibrate_best": f"with {B.CURVE} select * from best",
    "score_scale": f"with {B.CURVE} select * from scale",
    "sparse_scaled_score": f"with {B.CURVE} select row_id, score from verdicts",
    "judge_documents": f"with {B.CURVE} select row_id, score < 50 as safe, score / 100 as score from verdicts",
    "fail_open": f"""with {B.CURVE}, routed as (select source_id, upper(detector_language) as locale from prepared_rows where regexp_full_match(upper(detector_language), '[A-Z]{{2}}') and upper(detector_language) <> 'XX')
        select v.row_id, case when locale is null then true else score < 50 end as safe, case when locale is null then 0.0::double else score / 100 end as score, locale
        from verdicts v join corpus_rows c using (row_id) left join routed r on r.source_id = c.source_id""",
    "confusion_matrix": f"with {_FLAGS} select split, {_CELLS} from flags group by split",
    "confusion_rollup": f"with {_FLAGS} select coalesce(split, 'pooled') as split, {_CELLS} from flags group by rollup (split)",
    "eval_metrics": f"""with {_FLAGS}, m as (select split, {_CELLS} from flags group by split) select split, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as precision,
        round(tp / nullif(tp + fn, 0), 6) as recall, round(tn / nullif(tn + fp, 0), 6) as specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from m""",
    "projected_precision": f"""with {_FLAGS}, m as (select split, {_CELLS} from flags group by split), r as (select split, tp / nullif(tp + fn, 0) as rc, fp / nullif(fp + tn, 0) as fw from m)
        select split, round(fw, 6) as false_warning_rate, round(0.01::double * rc / nullif(0.01::double * rc + 0.99::double * fw, 0), 6) as at_1_percent, round(0.05::double * rc / nullif(0.05::double * rc + 0.95::double * fw, 0), 6) as at_5_percent from r""",
    "class_floor": "select split, count(*) filter (label = 'toxic') as toxic, count(*) filter (label = 'clean') as clean, least(count(*) filter (label = 'toxic'), count(*) filter (label = 'clean')) >= 300 as enough from corpus_rows where split is not null and label is not null group by split",
    "latency_percentiles": "with r as (select value, row_number() over (order by value) as k, count(*) over () as n from events where value is not null) select p::int as percent, value from r, (select unnest([50, 95, 99]) as p) where k = greatest(1, ceil(p * n / 100))",
    "throughput": "with e as (select count(*) as samples, epoch_us(max(ts)) - epoch_us(min(ts)) as us, sum(octet_length(encode(props)))::bigint as bytes from events) select samples, round(samples * 1e6 / us, 6) as per_second, round(bytes * 1e6 / us, 6) as bytes_per_second from e",
}
