"""Training, keeping and applying a judge of messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions.features import with_bins
from quellmark.operators import linear_model as L
from quellmark.operators import rules as R
from quellmark.runtime import Workspace, ship


class NotReady(RuntimeError):
    """No boundary passes the gates, or a class is missing."""


@dataclass
class Judge:
    """A model (weights per bin, bias, boundary, scale) that judges messages, in tables and streams alike."""

    weights: DataFrame
    bias: int
    boundary: int
    scale: int

    @classmethod
    def train(cls, rows: DataFrame, minimum: int = 0) -> Judge:
        """Fits on development rows of (row_id, split, label, text) and calibrates on validation rows."""
        spark = rows.sparkSession
        work = Workspace(spark, "judge")
        used = rows.where("text is not null and label is not null").select("row_id", "split", "label", "text")
        featured = work.keep(with_bins(used, carry=("split", "label")))
        names = used.select("row_id", "split", "label")
        dev = names.where("split = 'development'")
        totals = L.class_totals(dev).first()
        if not totals["nt"] or not totals["nc"]:
            raise NotReady("development rows of both labels are needed")
        counts = work.keep(L.document_counts(featured.where("split = 'development'")))
        weights = work.keep(L.logodds_weights(counts, L.class_totals(dev)))
        bias = L.logodds_bias(counts, L.class_totals(dev))
        scores = work.keep(L.raw_scores(featured.where("split = 'validation'"), weights, bias, carry=("label",)))
        best = L.best_boundary(L.calibration_curve(scores, minimum)).first()
        if best is None:
            raise NotReady("no boundary passes the gates")
        scale = L.score_scale(scores, best["boundary"]).first()["scale"]
        return cls(weights, bias.first()["bias"], best["boundary"], scale)

    def save(self, path: str) -> None:
        self.weights.write.mode("errorifexists").parquet(f"{path}/weights")
        header = [(self.bias, self.boundary, self.scale)]
        self.weights.sparkSession.createDataFrame(header, "bias long, boundary long, scale long").coalesce(1).write.mode("errorifexists").parquet(f"{path}/header")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Judge:
        ship(spark)
        header = spark.read.parquet(f"{path}/header").first()
        return cls(spark.read.parquet(f"{path}/weights"), *header)

    def judge(self, messages: DataFrame) -> DataFrame:
        """row_id, score (0 to 100 by the model), safe of (row_id, text); a narrow step, so it runs on streams too. Null texts are left out."""
        spark = self.weights.sparkSession
        bias = spark.createDataFrame([(self.bias,)], "bias long")
        raw = L.raw_scores(with_bins(messages.where("text is not null")), self.weights, bias)
        scored = raw.withColumn("score", L.scaled(F.col("raw"), F.lit(self.boundary), F.lit(self.scale)))
        return scored.select("row_id", "score", (F.col("score") < 50).alias("safe"))

    def judge_with_rules(self, messages: DataFrame, lang: str = "EN", pack: list[tuple[str, str, str]] | None = None) -> DataFrame:
        """row_id, score, safe: the larger of model and rules; the model counts at most 49 where a rule's event was suppressed."""
        lang = F.col("lang") if "lang" in messages.columns else F.lit(lang)
        events = R.scored(R.events(messages.withColumn("lang", lang), pack))
        both = self.judge(messages).join(events, "row_id", "left")
        model = F.when(F.coalesce("capped", F.lit(False)), F.least("score", F.lit(49))).otherwise(F.col("score"))
        score = F.greatest(F.coalesce("rule", F.lit(0)), model)
        return both.select("row_id", score.alias("score"), (score < 50).alias("safe"))
