"""Sparse linear models over hashed features: counts, weights, scores, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellmark.functions.features import BINS
from quellmark.operators.ordering import running

#: Weight units per nat, bounds of weights and scores, least documents of a kept bin.
UNIT, I16, I32, LEAST = 256, 32_767, 2_147_483_647, 2
#: Largest share of false warnings (per 10,000 clean) and least precision (percent).
FALSE_WARNINGS, PRECISION = 300, 90


def quantize(x: Column, bound: int = I16) -> Column:
    """Units of 1/256, rounded half away from zero and clamped."""
    return F.greatest(F.lit(-bound - 1), F.least(F.lit(bound), F.round(x * UNIT))).cast("long")


def document_counts(featured: DataFrame) -> DataFrame:
    """bin, toxic, clean: documents of each label that hold the bin, from (label, bins); combined before the shuffle."""
    return featured.select("label", F.explode("bins").alias("bin")).groupBy(F.col("bin").cast("long").alias("bin")).agg(
        F.count_if(F.col("label") == "toxic").alias("toxic"), F.count_if(F.col("label") == "clean").alias("clean")
    )


def class_totals(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_if(F.col("label") == "toxic").alias("nt"), F.count_if(F.col("label") == "clean").alias("nc"))


def kept(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Bins of at least `least` documents."""
    return counts.where(F.col("toxic") + F.col("clean") >= least)


def _smoothed(counts: DataFrame, totals: DataFrame) -> DataFrame:
    pt, pc = (F.col("toxic") + 1) / (F.col("nt") + 2), (F.col("clean") + 1) / (F.col("nc") + 2)
    return kept(counts).crossJoin(F.broadcast(totals)).withColumn("pt", pt).withColumn("pc", pc)


def logodds_weights(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """bin, weight of the kept bins; `totals` is a single row."""
    logit = F.log(F.col("pt") / (1 - F.col("pt"))) - F.log(F.col("pc") / (1 - F.col("pc")))
    return _smoothed(counts, totals).select("bin", quantize(logit).alias("weight"))


def logodds_bias(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """bias: a single row. At most 65,536 terms are summed, one per bin."""
    terms = _smoothed(counts, totals).agg(F.sum(F.log(1 - F.col("pt")) - F.log(1 - F.col("pc"))).alias("s"))
    whole = F.log(F.col("nt") / F.col("nc")) + F.coalesce("s", F.lit(0.0))
    return totals.crossJoin(F.broadcast(terms)).select(quantize(whole, I32).alias("bias"))


def nb_ratios(counts: DataFrame) -> DataFrame:
    """bin, ratio: log ratio of add-one smoothed shares over the kept bins."""
    used = kept(counts)
    sums = used.agg(F.sum(F.col("toxic") + 1).alias("st"), F.sum(F.col("clean") + 1).alias("sc"))
    ratio = F.log((F.col("toxic") + 1) / F.col("st")) - F.log((F.col("clean") + 1) / F.col("sc"))
    return used.crossJoin(F.broadcast(sums)).select("bin", ratio.alias("ratio"))


def raw_scores(featured: DataFrame, weights: DataFrame, bias: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """row_id, raw, and the columns to carry along: bias plus the weights of each row's bins, clamped; a narrow step, as the model has at most 65,536 weights."""
    lookup = np.zeros(BINS, np.int64)
    for r in weights.collect():  # at most BINS rows
        lookup[r["bin"]] = r["weight"]
    model = featured.sparkSession.sparkContext.broadcast((lookup, bias.first()["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = model.value
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            totals = np.concatenate([[0], np.cumsum(known[column.flatten().to_numpy()])])
            ends = np.cumsum(lengths)
            raw = np.clip(totals[ends] - totals[ends - lengths] + base, -I32 - 1, I32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), *batch.columns[2:]], ["row_id", "raw", *carry])

    used = featured.select("row_id", "bins", *carry)
    return used.mapInArrow(run, ", ".join(["row_id long, raw long", *(f"`{c}` {dict(used.dtypes)[c]}" for c in carry)]))


def quantized(x: np.ndarray, bound: int = I16) -> np.ndarray:
    """What `quantize` makes of each number."""
    units = x * UNIT
    whole = np.trunc(units)
    return np.clip(whole + np.sign(units) * (np.abs(units - whole) >= 0.5), -bound - 1, bound).astype(np.int64)


def grid_scores(featured: DataFrame, models: list[tuple[np.ndarray, int]]) -> DataFrame:
    """model (its index), label, raw: what raw_scores says of each (bins, label) for every (weight of each bin, bias), from one pass over the rows."""
    lookups, bases = np.stack([lookup for lookup, _ in models]), [base for _, base in models]
    known = featured.sparkSession.sparkContext.broadcast((lookups, bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, bases = known.value
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            bins, ends = batch.column(0).flatten().to_numpy(), np.cumsum(lengths)
            for k, (lookup, base) in enumerate(zip(lookups, bases)):
                totals = np.concatenate([[0], np.cumsum(lookup[bins])])
                raw = np.clip(totals[ends] - totals[ends - lengths] + base, -I32 - 1, I32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), k, np.int32)), batch.column(1), pa.array(raw)], ["model", "label", "raw"])

    return featured.select("bins", "label").mapInArrow(run, "model int, label string, raw long")


def scaled(raw: Column, boundary: Column, scale: Column) -> Column:
    """0 to 100 with the boundary at 50; below it the distance rounds up, so that nothing below reaches 50."""
    gap = raw - boundary
    far = F.abs(gap) * 50
    up = F.least(F.lit(50), F.expr("0") + (far - far % scale) / scale)
    down = F.least(F.lit(50), (far + (scale - far % scale) % scale) / scale)
    return F.when(gap >= 0, 50 + up).otherwise(50 - down).cast("int")


def boundary_candidates(scores: DataFrame, minimum: int) -> DataFrame:
    """boundary: every score and its successor from `minimum` on, and `minimum`."""
    spread = scores.select(F.explode(F.array("raw", F.least(F.col("raw") + 1, F.lit(I32)))).alias("boundary")).where(F.col("boundary") >= minimum)
    floor = scores.sparkSession.createDataFrame([(minimum,)], "boundary long")
    return spread.union(floor).distinct()


def calibration_curve(scores: DataFrame, minimum: int) -> DataFrame:
    """boundary, tp, fp, tn, fn at every candidate, from (label, raw): scores and candidates are swept once, from the top."""
    counts = scores.groupBy("raw").agg(F.count_if(F.col("label") == "toxic").alias("t"), F.count_if(F.col("label") == "clean").alias("c"))
    marks = boundary_candidates(scores, minimum).select(F.col("boundary").alias("at"), F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(True).alias("mark"))
    points = counts.select(F.col("raw").alias("at"), "t", "c", F.lit(False).alias("mark")).union(marks)
    # a score equal to a candidate is above it
    swept = running(points, [-F.col("at"), F.col("mark")], tp=F.col("t"), fp=F.col("c")).where("mark")
    totals = scores.agg(F.count_if(F.col("label") == "toxic").alias("nt"), F.count_if(F.col("label") == "clean").alias("nc"))
    joined = swept.crossJoin(F.broadcast(totals))
    return joined.select(F.col("at").alias("boundary"), "tp", "fp", (F.col("nc") - F.col("fp")).alias("tn"), (F.col("nt") - F.col("tp")).alias("fn"))


def passes_gates(precision: tuple[int, int] = (PRECISION, 100)) -> Column:
    """Exact integer gates over tp, fp, tn: false warnings, precision and at least one hit."""
    tp, fp, tn = F.col("tp"), F.col("fp"), F.col("tn")
    return (10_000 * fp <= FALSE_WARNINGS * (fp + tn)) & (precision[1] * tp >= precision[0] * (tp + fp)) & (tp > 0)


def best_boundary(curve: DataFrame) -> DataFrame:
    """The candidate past the gates with most hits, then fewest false alarms, then the highest boundary; no row if none passes."""
    best = curve.where(passes_gates()).agg(F.max(F.struct("tp", (-F.col("fp")).alias("nfp"), "boundary", "tn", "fn")).alias("b")).where("b is not null")
    return best.select("b.boundary", "b.tp", (-F.col("b.nfp")).alias("fp"), "b.tn", "b.fn")


def grid_boundaries(scores: DataFrame, models: int, minimum: int) -> DataFrame:
    """model, boundary, tp, fp, tn, fn: best_boundary of every model that has one, from (model, label, raw), where all models tell the same rows.

    All scores are swept at once, one model behind another, as calibration_curve does it with one.
    """
    toxic, clean = F.col("label") == "toxic", F.col("label") == "clean"
    counts = scores.groupBy("model", "raw").agg(F.count_if(toxic).alias("t"), F.count_if(clean).alias("c"))
    own = scores.where("model = 0").agg(F.count_if(toxic).alias("t"), F.count_if(clean).alias("c")).first()
    nt, nc = own["t"], own["c"]
    spread = scores.select("model", F.explode(F.array("raw", F.least(F.col("raw") + 1, F.lit(I32)))).alias("at")).where(F.col("at") >= minimum)
    floors = scores.sparkSession.createDataFrame([(k, minimum) for k in range(models)], "model int, at long")
    marks = spread.union(floors).distinct().select("model", "at", F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(True).alias("mark"))
    points = counts.select("model", F.col("raw").alias("at"), "t", "c", F.lit(False).alias("mark")).union(marks)
    swept = running(points, [F.col("model"), -F.col("at"), F.col("mark")], tp=F.col("t"), fp=F.col("c")).where("mark")
    tp, fp = F.col("tp") - F.col("model") * nt, F.col("fp") - F.col("model") * nc  # less the rows of the models before
    curve = swept.select("model", F.col("at").alias("boundary"), tp.alias("tp"), fp.alias("fp"), (F.lit(nc) - fp).alias("tn"), (F.lit(nt) - tp).alias("fn"))
    best = curve.where(passes_gates()).groupBy("model").agg(F.max(F.struct("tp", (-F.col("fp")).alias("nfp"), "boundary", "tn", "fn")).alias("b"))
    return best.select("model", "b.boundary", "b.tp", (-F.col("b.nfp")).alias("fp"), "b.tn", "b.fn")


def score_scale(scores: DataFrame, boundary: int) -> DataFrame:
    """scale: the larger distance of the 10th and the 90th percentile (by index) to the boundary, at least 1."""
    n = scores.count()
    low, high = (n - 1) // 10 + 1, (n - 1) * 9 // 10 + 1
    ends = running(scores.select("raw"), [F.col("raw")]).where(F.col("rank").isin(low, high))
    return ends.agg(F.greatest(F.lit(1), F.least(F.lit(4_294_967_295), F.max(F.abs(F.col("raw") - boundary)))).cast("long").alias("scale"))


def confusion(predicted: DataFrame, *by: str) -> DataFrame:
    """tp, fp, tn, fn per group, from (label, flag)."""
    toxic, flag = F.col("label") == "toxic", F.col("flag")
    cells = {"tp": toxic & flag, "fp": ~toxic & flag, "tn": ~toxic & ~flag, "fn": toxic & ~flag}
    return predicted.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))


def metrics() -> dict[str, Column]:
    """Null where the denominator is zero."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    parts = {
        "accuracy": (tp + tn, tp + fp + tn + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "specificity": (tn, tn + fp), "f1": (2 * tp, 2 * tp + fp + fn),
    }
    return {name: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6) for name, (a, b) in parts.items()}


def projected_precision(prevalence: float) -> Column:
    """Precision at another share of toxic texts, from recall and the rate of false warnings."""
    recall = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    warned = F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
    return F.round(F.try_divide(prevalence * recall, prevalence * recall + (1 - prevalence) * warned), 6)
