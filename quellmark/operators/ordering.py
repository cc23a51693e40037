"""Global ranks and running sums without sending a table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellmark.runtime import Workspace


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """`df` with `rank` (from 1) and the running sums of the given columns, both over the whole table in this order.

    The table is range-partitioned; a window runs within each partition, and one row per partition, which is all that
    reaches the driver, carries the totals of the partitions before it.
    """
    work = Workspace(df.sparkSession, "running")
    for k, key in enumerate(order):
        df = df.withColumn(f"_k{k}", key)
    keys = [f"_k{k}" for k in range(len(order))]
    # negated numbers keep a descending order ascending, so one range partitioning serves
    added = df.select("*", *(c.cast("long").alias(f"_s_{name}") for name, c in sums.items()))
    parted = work.keep(added.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    totals = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums)).orderBy("_p").collect()
    rows, before = [], [0] * (1 + len(sums))
    for r in totals:
        rows.append((r["_p"], *before))
        before = [a + (r[c] or 0) for a, c in zip(before, ["_n", *(f"_t_{n}" for n in sums)])]
    schema = ", ".join(["_p int", "_b0 long", *(f"_b_{n} long" for n in sums)])
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    window = Window.partitionBy("_p").orderBy(*keys)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parted.join(offsets, "_p").withColumn("rank", F.row_number().over(window) + F.col("_b0"))
    for name in sums:
        out = out.withColumn(name, F.sum(f"_s_{name}").over(upto) + F.col(f"_b_{name}"))
    return out.drop("_p", "_b0", *keys, *(f"_s_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def nearest_rank(df: DataFrame, value: str, percents: tuple[int, ...], total: int) -> DataFrame:
    """percent, value: the value of rank ceil(percent / 100 * total), for each percent."""
    ranks = {p: max(1, -(-p * total // 100)) for p in percents}
    ranked = running(df.select(value), [F.col(value)])
    wanted = df.sparkSession.createDataFrame([(p, r) for p, r in ranks.items()], "percent int, rank long")
    return ranked.join(F.broadcast(wanted), "rank").select("percent", F.col(value).alias("value"))
