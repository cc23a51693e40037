"""The model's verdicts on a stream of messages: stateless, so a stream is judged row by row like a table."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.functions.features import with_bins
from quellmark.operators.linear_model import logodds_bias, logodds_weights, raw_scores
from quellmark.plans.model_queries import Trained
from quellmark.runtime import shared_dir


def judge_stream(messages: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """row_id, safe of (row_id, text), batch or stream, by a fixed model."""
    return raw_scores(with_bins(messages), weights, bias).select("row_id", (F.col("raw") < 0).alias("safe"))


def stream_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpus rows read as a stream until none is left, judged, and written to the shared folder."""
    trained = Trained(spark, sf_dir)
    weights, bias = logodds_weights(trained.counts, trained.totals), logodds_bias(trained.counts, trained.totals)
    path = f"{sf_dir}/corpus_rows.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = (path, "*.parquet") if Path(path).is_dir() else (sf_dir, "corpus_rows.parquet")
    messages = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).select("row_id", "text").where("text is not null")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        judge_stream(messages, weights, bias).writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("row_id long, safe boolean").parquet(f"{root}/out")
