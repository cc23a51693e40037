"""Reading tables and keeping intermediate tables where every executor can reach them."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context: they need not find it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_quellmark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quellmark-"), "quellmark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("quellmark", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._quellmark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quellmark-"))
            found = sc._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A small table read in fewer tasks than there are cores is dealt to all of them before costly Python work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def median_seconds(run: Callable[[], object], times: int = 7) -> float:
    """The middle one of an odd number of timed runs."""
    if times % 2 == 0:
        raise ValueError("an even number of runs has no middle one")
    took = []
    for _ in range(times):
        begun = time.perf_counter()
        run()
        took.append(time.perf_counter() - begun)
    return sorted(took)[times // 2]


class Workspace:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table cuts the lineage: a lost executor costs a re-read, not a recomputation of the loop before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, **counted: Column) -> DataFrame:
        """Write `df` and return the table that was written; its `seen` has the row count `rows` and the sums named in `counted`."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        watch = Observation(f"{self.root}/{self.count}")
        sums = [F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in counted.items()]
        watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *sums)
        watched.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._quellmark_path = path
        kept.seen = {k: v or 0 for k, v in watch.get.items()}
        return kept

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_quellmark_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
