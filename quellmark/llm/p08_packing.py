"""Problem 8: texts combined into containers of fixed capacity, by bulk-synchronous best fit.

Pieces are range-sorted by size, largest first, and numbered within their size; sizes are whole tokens up to the capacity,
so the sorted sequence is a bounded list of runs (size, count), and so is the sorted sequence of gaps (gap, consecutive
containers). A superstep matches the largest run of pieces left with its successors among the gaps, the smallest
that hold it; conflicts are resolved by rank, the k-th piece of a run taking the k-th place of the run of gaps; gaps are
updated and the next superstep follows. What a superstep yields are intervals of ranks, and the pieces find their container in
them. The runs of a target meet in one task (at most as many as its capacity has tokens, and one per partition); targets
are matched side by side, and nothing passes through the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.runtime import Workspace, table

#: Path of the tokenizer's ranks (tiktoken format); None takes the installed public one of TOKENIZER.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@cache
def encoder(path: str | None = None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, tokens of each document's whole text; null ids and texts are left out."""
    used = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return used.mapInArrow(_count_tokens(path), "doc_id long, tokens long")


def best_fit(runs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank exclusive, first container, pieces a container) of runs (size, count), largest first.

    Piece r of an interval goes to container first + (r - first rank) // pieces a container.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened, out = 0, []

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    for size, count in runs:
        rank = 0
        while count:
            k = bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first, many = capacity, opened, -(-count // (capacity // size))
                opened += many
            each = gap // size
            used = min(many, -(-count // each))
            placed = min(count, used * each)
            out.append((size, rank, rank + placed, first, each))
            full, left = divmod(placed, each)
            put(gap - each * size, first, full)
            if left:
                put(gap - left * size, first + full, 1)
            put(gap, first + used, many - used)
            rank, count = rank + placed, count - placed
    return out


_PLACES = "target_name string, tokens long, p long, low long, high long, first long, each long, skip long"


def _place(runs: pd.DataFrame) -> pd.DataFrame:
    """The intervals of one target's ranks that share a first container and a number of pieces a container.

    `runs` has the pieces of one size in one partition: tokens, p, n, at (the first one's place), and the target's capacity.
    """
    runs = runs.sort_values(["tokens", "p"], ascending=[False, True])
    counts = runs.groupby("tokens", sort=False)["n"].sum()
    placed: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, int(counts.get(0, 0)), 0, max(1, int(counts.get(0, 0))))]}
    for size, a, b, first, each in best_fit([(int(s), int(n)) for s, n in counts.items() if s], int(runs["capacity"].iloc[0])):
        placed.setdefault(size, []).append((a, b, first, each))
    out, upto = [], {}
    name = runs["target_name"].iloc[0]
    for size, part, n, at in zip(*(runs[c].tolist() for c in ("tokens", "p", "n", "at"))):
        # rank of a piece = at - (the partition's first piece of the run) + the pieces of its size in partitions before
        rank = upto.get(size, 0)
        upto[size] = rank + n
        for a, b, first, each in placed[size]:
            low, high = max(a, rank), min(b, rank + n)
            if low < high:
                out.append((name, size, part, at + low - rank, at + high - rank, first, each, low - a))
    return pd.DataFrame(out, columns=["target_name", "tokens", "p", "low", "high", "first", "each", "skip"])


def pack(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """target_name, doc_id, part, container_id, tokens: where each document goes for each target.

    A document of at most the capacity is one part; a larger one is cut to parts of the capacity and a rest. Documents
    without tokens take no room and go to container 0; rows with nulls and targets without a positive capacity are left
    out; a target named twice has the smallest of its capacities; repeated documents are packed each; an empty table gives no
    rows. Each target's runs, at most one for each size and partition border, are matched in a task of their own.
    """
    work = Workspace(sizes.sparkSession, "p8")
    goals = targets.where("target_name is not null and capacity_tokens > 0").groupBy("target_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    listed = goals.agg(F.sort_array(F.collect_list(F.struct("target_name", "capacity"))).alias("goals"))
    sizes = work.keep(sizes.where("doc_id is not null and tokens is not null").select("doc_id", "tokens"))
    parts = sizes.withColumn("goal", F.explode(listed.scalar())).select("doc_id", "tokens", "goal.target_name", "goal.capacity")
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1))))
    parts = parts.withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")))
    by = [F.col("target_name"), F.desc("tokens"), F.col("doc_id"), F.col("part")]
    pieces = work.keep(parts.select("target_name", "tokens", "doc_id", "part").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    pieces = pieces.withColumn("p", F.shiftright("at", 33))
    runs = pieces.groupBy("target_name", "tokens", "p").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).join(goals, "target_name")
    # as many rows as there are sizes, partitions and gaps of a run: Spark broadcasts the written table only if it is small
    where = work.keep(runs.groupBy("target_name").applyInPandas(_place, _PLACES))
    found = pieces.join(where, ["target_name", "tokens", "p"]).where("at >= low and at < high")
    container = F.col("first") + F.floor((F.col("skip") + F.col("at") - F.col("low")) / F.col("each"))
    return found.select("target_name", "doc_id", "part", container.cast("long").alias("container_id"), "tokens")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_targets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each target."""
    targets = table(spark, sf_dir, "pack_targets")
    packed = p8_packed(spark, sf_dir).groupBy("target_name").agg(
        F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents")
    )
    unused = F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return packed.join(targets, "target_name").select("target_name", "documents", "containers", "tokens", unused.alias("unused"))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}
