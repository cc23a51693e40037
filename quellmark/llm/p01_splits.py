"""Problem 1: splits that keep related provenance records together.

Records that share a key are tied through a star per key instead of all pairs: the records of a (key, salt) pair hang
on its smallest record, those hang on the key's smallest record, so no vertex of a hot key has more neighbours than a
bounded number of rows or the number of salts, which grows with the table. Borůvka rounds pick every component's smallest outgoing edge, keep it in the spanning forest
and contract along the picked edges; the forest and each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quellmark.runtime import Workspace, table

#: Salts per key: LEAST, and one more for every PER rows, so that a hot key's share of a (key, salt) pair stays bounded.
LEAST, PER = 64, 2_000_000
#: What stands for "no author", compared without case and outer blanks.
NO_AUTHOR = ["", "-", "?", "unknown", "n/a", "na", "none", "null", "[deleted]", "deleted", "anonymous", "anon"]
#: Step of the additive low-discrepancy sequence by which clusters are dealt (the golden ratio's fraction), and its start, in parts of CYCLE.
CYCLE = 1 << 31
STEP, START = 1_327_217_885, CYCLE // 2
RATIOS = {"development": 0.70, "validation": 0.15, "test": 0.15}


def _key(kind: str, value: Column, usable: Column | None = None) -> Column:
    present = value.isNotNull() & (F.trim(value) != "")
    return F.when(present if usable is None else present & usable, F.unhex(F.md5(F.concat(F.lit(kind), value))))


def tie_edges(records: DataFrame, salts: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are the clusters; at most four for a record, whatever the size of its keys."""
    salts = salts or LEAST + records.count() // PER
    author = F.col("author_id")
    keys = F.array(
        _key("source:", F.col("source_id")),
        _key("source:", F.col("representative_source_id")),
        _key("group:", F.col("canonical_group_id")),
        _key("author:", author, ~F.lower(F.trim(author)).isin(NO_AUTHOR)),
    )
    rows = records.where("record_id is not null").select(
        "record_id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key")
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)))
    near = rows.withColumn("hub", F.min("record_id").over(Window.partitionBy("key", "salt")))
    leaves = near.where("record_id <> hub").select(F.col("record_id").alias("u"), F.col("hub").alias("v"))
    hubs = near.where("record_id = hub").select("key", "hub").distinct()
    hubs = hubs.withColumn("top", F.min("hub").over(Window.partitionBy("key")))
    return leaves.union(hubs.where("hub <> top").select(F.col("hub").alias("u"), F.col("top").alias("v")))


def floor_sum(n: int, step: int, start: int, cycle: int) -> int:
    """The sum of (step * i + start) // cycle over 0 <= i < n, exactly, in logarithmically many steps."""
    total = 0
    while n > 0:
        total += (n - 1) * n // 2 * (step // cycle) + n * (start // cycle)
        step, start = step % cycle, start % cycle
        last = step * n + start
        n, start, step, cycle = last // cycle, last % cycle, cycle, step
        if not step or not cycle:
            break
    return total


def points_below(n: int, bound: int) -> int:
    """How many of the sequence's first n points lie below `bound` (of CYCLE), in closed form."""
    return floor_sum(n, STEP, START, CYCLE) - floor_sum(n, STEP, START - bound + CYCLE, CYCLE) + n


def boruvka(edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(labels: vertex, root; forest: u, v) of the graph; vertices without an edge don't occur.

    Each round halves the number of components at least, and each doubling step halves the height of the
    contracted trees, so both loops are logarithmic.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")

    def contracted(df: DataFrame) -> DataFrame:
        return (
            df.where("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.struct("u", "v")).alias("edge"))
            .select("a", "b", "edge.u", "edge.v")
        )

    current = work.keep(contracted(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v")))
    labels, forest = None, []
    while current.seen["rows"]:
        ends = current.select(F.explode(F.array("a", "b")).alias("c"), F.struct("a", "b", "u", "v").alias("edge"))
        picked = work.keep(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("c", "edge.*"))
        forest.append(work.keep(picked.select("u", "v").distinct()))
        parents = picked.select("c", F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a")).alias("p"))
        up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # two components that picked the same edge point at each other: the smaller becomes the root
        tree = work.keep(
            parents.join(up, "p").select(
                "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
            )
        )
        while True:
            up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = work.keep(tree.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), moved=F.col("moved"))
            work.drop(tree)
            tree = jumped.select("c", "p")
            tree._quellmark_path = jumped._quellmark_path
            if not jumped.seen["moved"]:
                break
        to_a, to_b = tree.select(F.col("c").alias("a"), F.col("p").alias("ra")), tree.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        after = work.keep(
            contracted(current.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "u", "v"))
        )
        if labels is None:
            labels = tree.select(F.col("c").alias("vertex"), F.col("p").alias("root"))
        else:
            moved_to = tree.select(F.col("c").alias("root"), F.col("p").alias("next"))
            old = labels
            labels = work.keep(
                labels.join(moved_to, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
            )
            work.drop(old)
            work.drop(tree)
        for done in (current, picked):
            work.drop(done)
        current = after
    if labels is None:
        empty = current.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        return empty, current.select("u", "v")
    out = forest[0]
    for more in forest[1:]:
        out = out.union(more)
    return labels, out


def clusters(records: DataFrame, work: Workspace) -> DataFrame:
    """record_id, cluster_id (the cluster's smallest record_id) of every record; a record that nothing ties is its own cluster."""
    labels, _ = boruvka(tie_edges(records), work)
    smallest = labels.groupBy("root").agg(F.min("vertex").alias("cluster_id"))
    tied = labels.join(smallest, "root").select(F.col("vertex").alias("record_id"), "cluster_id")
    ids = records.where("record_id is not null").select("record_id").distinct()
    return ids.join(tied, "record_id", "left").select("record_id", F.coalesce("cluster_id", "record_id").alias("cluster_id"))


def broken_clusters(records: DataFrame) -> DataFrame:
    """record_id, cluster_id of each record in a cluster whose records carry two or more different detector_splits.

    Null and blank keys and placeholder authors tie nothing; a null detector_split is no split of its own; rows
    without a record_id are left out; repeated rows count once; an empty table gives no rows.
    """
    work = Workspace(records.sparkSession, "p1")
    members = work.keep(clusters(records, work))
    splits = records.where("record_id is not null and detector_split is not null").select("record_id", "detector_split")
    torn = (
        members.join(splits, "record_id").groupBy("cluster_id")
        .agg(F.min("detector_split").alias("first"), F.max("detector_split").alias("last")).where("first <> last")
    )
    return members.join(torn, "cluster_id", "left_semi").select("record_id", "cluster_id")


def deal_splits(records: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """record_id, cluster_id, split: all records of a cluster in one split, the splits near `ratios`.

    Clusters are stratified by size band (powers of two) and dealt systematically: within a band they are ordered by a
    hash and the n-th takes the split that the n-th point of an additive low-discrepancy sequence falls on. What a band
    can't give (a single giant cluster goes to one split whole) is made up for by the bands below it. Bands are at most
    64 rows, the only data that reaches the driver besides one count per partition.
    """
    spark = records.sparkSession
    work = Workspace(spark, "p1s")
    members = work.keep(clusters(records, work))
    sized = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("h", F.xxhash64("cluster_id"))
    ordered = work.keep(
        sized.repartitionByRange("band", "h", "cluster_id").sortWithinPartitions("band", "h", "cluster_id")
        .withColumn("at", F.monotonically_increasing_id())
    )
    runs = (
        ordered.groupBy("band", F.shiftright("at", 33).alias("part"))
        .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("at").alias("first")).orderBy("band", "part").collect()
    )
    total = sum(r["n"] for r in runs) or 1
    names, given, rows = list(ratios), dict.fromkeys(ratios, 0.0), []
    for band in sorted({r["band"] for r in runs}, reverse=True):
        own = [r for r in runs if r["band"] == band]
        size = sum(r["n"] for r in own)
        want = {s: max(0.0, ratios[s] * total - given[s]) for s in names}
        share = {s: want[s] / (sum(want.values()) or 1) for s in names}
        count = sum(r["k"] for r in own)
        bounds = [round(CYCLE * share[names[0]]), round(CYCLE * (share[names[0]] + share[names[1]]))]
        upto = [0, *(points_below(count, b) for b in bounds), count]
        dealt = [(b - a) / count for a, b in zip(upto, upto[1:])]
        for s, part in zip(names, dealt):
            given[s] += size * part
        before = 0
        for r in own:
            rows.append((int(band), int(r["part"]), int(r["first"]), before, *bounds))
            before += r["k"]
    schema = "band int, part long, first long, before long, b0 long, b1 long"
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    # the sequence repeats after CYCLE points, so the product stays below 2^62
    point = ((F.col("before") + F.col("at") - F.col("first")) % CYCLE * STEP + START) % CYCLE
    split = F.when(point < F.col("b0"), names[0]).when(point < F.col("b1"), names[1]).otherwise(names[2])
    dealt = ordered.withColumn("part", F.shiftright("at", 33)).join(plan, ["band", "part"]).select("cluster_id", split.alias("split"))
    return members.join(dealt, "cluster_id").select("record_id", "cluster_id", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_clusters(table(spark, sf_dir, "provenance"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal_splits(table(spark, sf_dir, "provenance"))


def p1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted spanning forest: the edges that hold the clusters together."""
    return boruvka(tie_edges(table(spark, sf_dir, "provenance")), Workspace(spark, "p1f"))[1]


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_forest": p1_forest}

#: Labels spread along the ties until none falls any more; a record's ties go over its keys.
SQL = {
    "p1_found": f"""with recursive keys as materialized (select distinct record_id as r, k from (select record_id, unnest([case when trim(source_id) <> chr(0)[:0] then 's' || source_id end, case when trim(representative_source_id) <> chr(0)[:0] then 's' || representative_source_id end,
        case when trim(canonical_group_id) <> chr(0)[:0] then 'g' || canonical_group_id end, case when lower(trim(author_id)) not in ({", ".join(f"'{a}'" for a in NO_AUTHOR)}) then 'a' || author_id end]) as k from provenance) where k is not null),
    hubs as (select k, min(r) as h from keys group by k), e as materialized (select r as a, h as b from keys join hubs using (k) union select h, r from keys join hubs using (k)),
    cc(id, c) using key (id) as (select record_id, record_id from provenance union select e.b, min(cc.c) from cc join e on e.a = cc.id join recurring.cc as cur on cur.id = e.b where cc.c < cur.c group by e.b),
    torn as (select c from cc join provenance on record_id = id group by c having count(distinct detector_split) > 1)
    select id as record_id, c as cluster_id from cc where c in (select c from torn)""",
}
