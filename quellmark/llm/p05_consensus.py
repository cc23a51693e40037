"""Problem 5: consensus of several annotators by minimax conditional entropy.

The vote of annotator j on item i whose true answer is k is yes with probability sigmoid(s[j, k] + t[i, k]): s tilts the answers of an
annotator, over all items and categories, t those of an item. Both are fitted by regularised coordinate ascent on
the dual, alternating with the posteriors of the labels: the t and posteriors of an item need nothing but its own votes and its
annotators' s, so each pass solves them inside the partition and sends one pre-aggregated gradient and curvature
per annotator through the shuffle; s takes a Newton step and the next pass follows, until a pass raises the dual by less than
TOLERANCE of it. Agreement is measured apart from the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.runtime import BROADCAST_ROWS, Workspace, table

CATEGORIES = ("homophobia", "obscene", "insult", "racism", "misogyny", "xenophobia")
VOTES = 3
#: Pull of an annotator's tilts to those of all annotators; pull of an item's tilts to none, the one that foretells held-out votes best.
ALPHA, BETA = 2.0, 1.0
#: The share of the dual that a pass must still add for another to follow, and passes over the votes at most.
TOLERANCE, PASSES = 1e-5, 60
#: Stands for votes of unknown annotators, who share their tilts.
UNKNOWN = ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item: its annotators, and its votes as bytes (category by category; 2 for none)."""
    for batch in batches:
        cells = [np.nan_to_num(np.asarray(c.to_numpy(zero_copy_only=False), float), nan=2.0) for c in batch.columns[1 + VOTES :]]
        grid = np.stack(cells, 1)
        grid = np.where((grid == 0) | (grid == 1), grid, 2).astype(np.uint8)
        packed = pa.array([row.tobytes() for row in grid], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + VOTES], packed], ["item_id", "a1", "a2", "a3", "votes"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def posteriors(votes: np.ndarray, tilt: np.ndarray, prior: np.ndarray, beta: float = BETA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of yes [category, item], chance of a yes vote [truth, vote, category, item], part of the dual [category, item]).

    votes [vote, category, item] holds 0, 1 or 2 (none), tilt [truth, vote, item] the annotators' tilts, prior [category].
    """
    tilt, there, yes = tilt.astype(np.float32)[:, :, None], (votes < 2).astype(np.float32), (votes == 1).astype(np.float32)
    no = (votes == 0).astype(np.float32)
    prior = prior[:, None]
    item = np.zeros((2, 1, *votes.shape[1:]), np.float32)
    base = np.log(prior / (1 - prior)).astype(np.float32)
    for step in range(3):
        z = tilt + item
        e = np.exp(-z)
        e += 1
        p = 1 / e
        like = -((np.log(e) * there) + no * z).sum(1)
        q = _sigmoid(base + like[1] - like[0])
        if step < 2:
            weight = np.stack([1 - q, q])[:, None] * there
            slope = (weight * (yes - p)).sum(1, keepdims=True) - beta * item
            item = item + slope / ((weight * p * (1 - p)).sum(1, keepdims=True) + beta)
    dual = np.logaddexp(np.log(prior) + like[1], np.log(1 - prior) + like[0]) - beta / 2 * (item[:, 0] ** 2).sum(0)
    return q, p, dual


def _unpack(batch: pa.RecordBatch, known) -> tuple[np.ndarray, np.ndarray]:
    """Votes, and the tilts of each item's annotators: looked up in `known` (names, tilts), or else in the columns after the votes."""
    votes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, len(CATEGORIES), VOTES)
    votes = np.ascontiguousarray(votes.transpose(2, 1, 0))
    if known is not None:
        names, tilts = known.value
        return votes, np.ascontiguousarray(tilts[np.stack([pc.index_in(c, names).to_numpy() for c in batch.columns[1:4]])].transpose(2, 0, 1))
    tilt = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns[5:]])
    return votes, tilt.reshape(VOTES, 2, -1).transpose(1, 0, 2)


def _gradients(prior: np.ndarray, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, tilt = _unpack(batch, known)
            q, p, dual = posteriors(votes, tilt, prior)
            there = (votes < 2).astype(np.float32)
            weight = np.stack([1 - q, q])[:, None] * there
            slope = (weight * ((votes == 1) - p)).sum(2)
            bend = (weight * p * (1 - p)).sum(2)
            names, unique = pd.factorize(np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:4]]))
            by = [np.bincount(names, v.ravel(), len(unique)) for k in (0, 1) for v in (slope[k], bend[k])]
            # what the categories' priors and the dual need travels under names that no annotator has
            held = there.any(0)
            totals = [*(q * held).sum(1, dtype=float), *held.sum(1), (dual * held).sum(dtype=float)]
            zeros = np.zeros(len(totals))
            columns = [np.concatenate([by[0], totals]), *(np.concatenate([b, zeros]) for b in by[1:])]
            ids = pa.array([*unique, *(f"\0{k}" for k in range(len(totals)))], pa.string())
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["annotator", "g0", "h0", "g1", "h1"])

    return run


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per annotator the weights and yes weights of both truths when the share of yes votes is the posterior."""
    for batch in batches:
        votes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, len(CATEGORIES), VOTES)
        there, yes = votes < 2, votes == 1
        q = yes.sum(2) / np.maximum(there.sum(2), 1)
        weight = np.stack([1 - q, q], -1)[:, :, None] * there[..., None]
        names, unique = pd.factorize(np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:4]]))
        parts = [weight.sum(1), (weight * yes[..., None]).sum(1)]
        by = [np.bincount(names, v[..., k].transpose(1, 0).ravel(), len(unique)) for k in (0, 1) for v in parts]
        yield pa.RecordBatch.from_arrays([pa.array(unique, pa.string()), *map(pa.array, by)], ["annotator", "n0", "y0", "n1", "y1"])


def _spread(items: DataFrame, tilts: DataFrame, unknown: tuple[float, float]) -> DataFrame:
    """Items with the tilts of their three annotators by shuffle, where annotators are too many to be looked up; those of unknown ones are given."""
    for k in range(1, VOTES + 1):
        side = tilts.select(F.col("annotator").alias(f"b{k}"), F.col("s0").alias(f"s0_{k}"), F.col("s1").alias(f"s1_{k}"))
        # votes of unknown annotators match nothing, under many keys
        key = F.when(F.col(f"a{k}") == UNKNOWN, F.concat(F.lit("\0"), F.pmod("item_id", F.lit(997)))).otherwise(F.col(f"a{k}"))
        items = items.withColumn(f"b{k}", key).join(side, f"b{k}", "left")
    order = [F.coalesce(f"s{t}_{k}", F.lit(unknown[t])).alias(f"s{t}_{k}") for k in range(1, VOTES + 1) for t in (0, 1)]
    return items.select("item_id", "a1", "a2", "a3", "votes", *order)


_SUMS = "annotator string, g0 double, h0 double, g1 double, h1 double"


class Fit:
    """The fitted model: `items` (votes), `tilts` (annotator, s0, s1), `prior` per category, `duals` of the passes."""

    def __init__(self, rows: DataFrame, passes: int = PASSES, bound: int = BROADCAST_ROWS):
        self.spark = rows.sparkSession
        self.work = work = Workspace(self.spark, "p5")
        names = [F.coalesce(F.col(f"annotator_{k}"), F.lit(UNKNOWN)).alias(f"a{k}") for k in range(1, VOTES + 1)]
        cells = [F.col(f"{c}_{k}").cast("double") for c in CATEGORIES for k in range(1, VOTES + 1)]
        used = rows.where("item_id is not null").select("item_id", *names, *cells)
        self.items = work.keep(used.mapInArrow(_votes, "item_id long, a1 string, a2 string, a3 string, votes binary"))
        schema = "annotator string, n0 double, y0 double, n1 double, y1 double"
        start = self.items.mapInArrow(_majority, schema).groupBy("annotator").agg(*(F.sum(c).alias(c) for c in ("n0", "y0", "n1", "y1")))
        start = work.keep(start)
        n0, y0, n1, y1 = (float(x or 0) for x in start.agg(*(F.sum(c) for c in ("n0", "y0", "n1", "y1"))).first())
        self.center = np.array([np.log((y + 1) / (n - y + 1)) for y, n in ((y0, n0), (y1, n1))])
        usual = _sigmoid(self.center)
        self.tilts = start.select("annotator", *(
            F.log((F.col(f"y{k}") + ALPHA * float(usual[k])) / (F.col(f"n{k}") - F.col(f"y{k}") + ALPHA * float(1 - usual[k]))).alias(f"s{k}")
            for k in (0, 1)))
        self.prior = np.full(len(CATEGORIES), min(max(n1 / max(n0 + n1, 1), 0.01), 0.99))
        self.duals: list[float] = []
        self.names: pa.Array | None = None
        if start.seen["rows"] <= bound:
            found = self.tilts.orderBy("annotator").toPandas()
            self.names, self.values = pa.array(found["annotator"], pa.string()), found[["s0", "s1"]].to_numpy(float)
        else:
            self.tilts = work.keep(self.tilts)
        while len(self.duals) < passes and self._pass():
            pass
        if self.names is not None:
            self.tilts = self.spark.createDataFrame(pd.DataFrame({"annotator": self.names.to_pylist(), "s0": self.values[:, 0], "s1": self.values[:, 1]}), "annotator string, s0 double, s1 double")

    def _applied(self, run, schema: str) -> DataFrame:
        """Annotators up to the bound are looked up in a broadcast of that many rows, more are joined."""
        if self.names is not None:
            return self.items.mapInArrow(run(self.spark.sparkContext.broadcast((self.names, self.values))), schema)
        own = self.tilts.where(F.col("annotator") == UNKNOWN).first()
        return _spread(self.items, self.tilts, (own["s0"], own["s1"]) if own else (0.0, 0.0)).mapInArrow(run(None), schema)

    def _pass(self) -> bool:
        """A Newton step of all annotators; whether another should follow."""
        prior = self.prior
        sums = self._applied(lambda known: _gradients(prior, known), _SUMS).groupBy("annotator").agg(*(F.sum(c).alias(c) for c in ("g0", "h0", "g1", "h1")))
        if self.names is not None:
            found = sums.toPandas()
            totals = found[found["annotator"].str.startswith("\0")]
            totals = {int(a[1:]): v for a, v in zip(totals["annotator"], totals["g0"])}
            pull = float(((self.values - self.center) ** 2).sum())
        else:
            sums = self.work.keep(sums)
            totals = {int(r["annotator"][1:]): r["g0"] for r in sums.where(F.col("annotator").startswith("\0")).collect()}
            pull = self.tilts.agg(F.sum(sum((F.col(f"s{k}") - float(self.center[k])) ** 2 for k in (0, 1)))).first()[0] or 0.0
        if not totals:
            return False
        size = len(CATEGORIES)
        self.duals.append(totals[2 * size] - ALPHA / 2 * pull)
        self.prior = np.array([(totals[k] + 1) / (totals[k + size] + 2) for k in range(size)])
        if self.names is not None:
            at = pc.index_in(pa.array(found["annotator"], pa.string()), self.names).to_numpy(zero_copy_only=False)
            own = found[~np.isnan(at.astype(float))]
            at = at[~np.isnan(at.astype(float))].astype(int)
            g, h = own[["g0", "g1"]].to_numpy(float), own[["h0", "h1"]].to_numpy(float)
            step = np.clip((g - ALPHA * (self.values[at] - self.center)) / (h + ALPHA), -2, 2)
            self.values[at] = np.clip(self.values[at] + step, -6, 6)
        else:
            moves = [F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col(f"g{k}") - ALPHA * (F.col(f"s{k}") - float(self.center[k]))) / (F.col(f"h{k}") + ALPHA))) for k in (0, 1)]
            before = self.tilts
            self.tilts = self.work.keep(before.join(sums, "annotator").select("annotator", *(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col(f"s{k}") + moves[k])).alias(f"s{k}") for k in (0, 1))))
            self.work.drop(before)
            self.work.drop(sums)
        return len(self.duals) < 2 or self.duals[-1] - self.duals[-2] > TOLERANCE * abs(self.duals[-1])

    def labels(self) -> DataFrame:
        """item_id, category, consensus, probability, votes, agreement of each item and category that has a vote.

        agreement is the share of pairs of votes that agree, null for a single vote.
        """
        prior = self.prior

        def run(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                votes, tilt = _unpack(batch, known)
                q, *_ = posteriors(votes, tilt, prior)
                q, n, yes = q.T, (votes < 2).sum(0).T, (votes == 1).sum(0).T
                pairs = n * (n - 1) / 2
                agree = np.divide(yes * (yes - 1) / 2 + (n - yes) * (n - yes - 1) / 2, pairs, out=np.zeros(pairs.shape), where=pairs > 0)
                keep = n.ravel() > 0
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(CATEGORIES))[keep]
                names = np.tile(np.array(CATEGORIES, dtype=object), len(q))[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(names, pa.string()), pa.array(q.ravel()[keep] > 0.5), pa.array(q.ravel()[keep].astype(float)),
                     pa.array(n.ravel()[keep].astype(np.int32)), pa.array(agree.ravel()[keep], mask=pairs.ravel()[keep] == 0)],
                    ["item_id", "category", "consensus", "probability", "votes", "agreement"],
                )

        schema = "item_id long, category string, consensus boolean, probability double, votes int, agreement double"
        return self._applied(lambda known: lambda batches: run(batches, known), schema)


def consensus(rows: DataFrame) -> DataFrame:
    """item_id, category, consensus, probability, votes, agreement.

    Votes other than 0 and 1 and null votes don't count; votes of unknown annotators share one annotator; items without a
    vote in a category and rows without an id have no row; at a probability of exactly one half the consensus is no;
    repeated rows count as further items; an empty table gives no rows; other columns aren't read.
    """
    return Fit(rows).labels()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "told_br_alpha")).where("consensus").select("item_id", "category")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: items, mean pairwise agreement, Krippendorff's alpha (nominal) and the share of yes by consensus."""
    found = consensus(table(spark, sf_dir, "told_br_alpha"))
    yes_votes = table(spark, sf_dir, "told_br_alpha").select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.array(*(f"{c}_{k}" for k in range(1, VOTES + 1))).alias("v")) for c in CATEGORIES))).alias("x")
    ).select("x.category", F.size(F.filter("x.v", lambda v: v.isin(0, 1))).alias("n"), F.size(F.filter("x.v", lambda v: v == 1)).alias("y"))
    paired = yes_votes.where("n > 1").groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(2 * F.col("y") * (F.col("n") - F.col("y")) / (F.col("n") - 1)).alias("differ")
    )
    expected = 2 * F.col("y") * (F.col("n") - F.col("y")) / (F.col("n") - 1)
    alpha = paired.select("category", F.round(1 - F.try_divide(F.col("differ"), expected), 6).alias("alpha"))
    base = found.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("agreement"), 6).alias("agreement"), F.round(F.avg(F.col("consensus").cast("int")), 6).alias("yes_share")
    )
    return base.join(alpha, "category", "left")


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per annotator: votes, chance of yes on a true yes and of no on a true no, and reliability (their sum less one; 0 for guessing, below 0 for worse)."""
    fit = Fit(table(spark, sf_dir, "told_br_alpha"))
    hit, reject = 1 / (1 + F.exp(-F.col("s1"))), 1 / (1 + F.exp(F.col("s0")))
    voted = fit.items.select(F.explode(F.array("a1", "a2", "a3")).alias("annotator")).groupBy("annotator").agg(F.count(F.lit(1)).alias("items"))
    named = fit.tilts.join(voted, "annotator").where(F.col("annotator") != UNKNOWN)
    return named.select("annotator", "items", F.round(hit, 6).alias("yes_on_yes"), F.round(reject, 6).alias("no_on_no"), F.round(hit + reject - 1, 6).alias("reliability"))


QUERIES = {"p5_found": p5_found, "p5_agreement": p5_agreement, "p5_annotators": p5_annotators}
