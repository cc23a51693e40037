"""Problem 4: duplicates hidden by formatting, collapsed by recursive radix partitioning and counted in tries.

Canonical bytes (split, label, then the text's canonical form) are cut into buckets by their first bytes. A bucket of more
than `capacity` rows or `room` bytes is split by further bytes, level by level, until each fits. An oversized bucket whose bytes are
used up holds nothing but copies of one text: those are counted map-side and never meet in one task. Every other bucket
goes whole to one task, which counts its texts in a path-compressed trie with counters at the terminals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.llm.forms import canonical
from quellmark.runtime import Workspace, table

#: Bytes of the canonical form that each level of the partitioning looks at.
LEVELS = (6, 16, 40, 96, 256, 1024, 8192, 1 << 30)
#: A bucket of at most so many rows and so many bytes fits a task, whatever the size of the table.
CAPACITY, ROOM = 20_000, 64 << 20


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, splits, labels, texts = (c.to_pylist() for c in batch.columns)
        out = [f"{s}\t{b}\t{canonical(t)}".encode() for s, b, t in zip(splits, labels, texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row_id", "c"])


class Trie:
    """A path-compressed byte trie; each terminal keeps the number of its rows and their ids."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, row_id: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.setdefault(-1, []).append(row_id)
                return
            edge = node.get(key[at])
            if edge is None:
                node[key[at]] = [key[at:], {-1: [row_id]}]
                return
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = 1
            rest = key[at : at + len(label)]
            while same < len(rest) and rest[same] == label[same]:
                same += 1
            middle = {label[same]: [label[same:], child]}
            edge[0], edge[1] = label[:same], middle
            node, at = middle, at + same

    def terminals(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            for k, v in node.items():
                if k == -1:
                    yield v
                else:
                    stack.append(v[1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, row_id, c) in bucket order to (row_id, first_row_id, copies), a trie per bucket."""

    def flush(trie: Trie) -> pa.RecordBatch:
        rows, first, copies = [], [], []
        for ids in trie.terminals():
            least = min(ids)
            rows += ids
            first += [least] * len(ids)
            copies += [len(ids)] * len(ids)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, first, copies)], ["row_id", "first_row_id", "copies"])

    trie, bucket = Trie(), None
    for batch in batches:
        for b, row_id, c in zip(*(x.to_pylist() for x in batch.columns)):
            if b != bucket:
                if bucket is not None:
                    yield flush(trie)
                trie, bucket = Trie(), b
            trie.add(c, row_id)
    if bucket is not None:
        yield flush(trie)


def copies(rows: DataFrame, capacity: int = CAPACITY, room: int = ROOM) -> DataFrame:
    """row_id, first_row_id, copies of each row: the smallest row_id and the size of its group of copies.

    A group has equal split and label and texts equal but for white space, letter case, punctuation and order of
    their fields. Rows with a null row_id, split, label or text belong to no group and are left out; texts of nothing but
    white space and punctuation are copies of each other; columns other than these four are never read.

    The prefixes of oversized buckets stay tables of digests, joined and never collected: their number grows with the
    rows, the size of a bucket doesn't.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "p4")
    used = rows.where("row_id is not null and split is not null and label is not null and text is not null")
    keyed = work.keep(used.select("row_id", "split", "label", "text").mapInArrow(_canonical, "row_id long, c binary"))

    def prefix(level: int) -> Column:
        return F.unhex(F.md5(F.substring("c", 1, LEVELS[level])))

    # the digests of oversized prefixes level by level, and those of texts that are a bucket of their own
    over: list[DataFrame] = []
    full = None
    pending = keyed.select("c")
    for level, size in enumerate(LEVELS):
        length = F.length("c")
        counted = pending.groupBy(prefix(level).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("bytes"), F.max(length).alias("most"))
        # a prefix that is as long as its longest row is one text
        big = work.keep(counted.where((F.col("n") > capacity) | (F.col("n") > 1) & (F.col("bytes") > room)).select("p", (F.col("most") <= size).alias("one")), one=F.col("one"))
        if big.seen["one"]:
            own = big.where("one").select("p")
            full = own if full is None else full.union(own)
        if big.seen["rows"] == big.seen["one"]:
            break
        over.append(big.where("not one").select("p"))
        pending = pending.withColumn("p", prefix(level)).join(over[-1], "p", "left_semi").select("c")
    located, same = keyed, None
    if full is not None:
        # such a text is all of its prefix, so the digest of the whole text finds it
        whole = keyed.withColumn("p", F.unhex(F.md5("c")))
        located, same = whole.join(full, "p", "left_anti").select("row_id", "c"), whole.join(full, "p", "left_semi").select("row_id", "p")
    depth = F.lit(0)
    for level, known in enumerate(over):
        marked = known.select(F.col("p").alias(f"p{level}"), F.lit(True).alias(f"o{level}"))
        located = located.withColumn(f"p{level}", prefix(level)).join(marked, f"p{level}", "left")
        depth = F.when(F.col(f"o{level}"), level + 1).otherwise(depth)
    sizes = F.element_at(F.array(*map(F.lit, LEVELS)), depth + 1)
    bucket = F.unhex(F.md5(F.substring(F.col("c"), F.lit(1), sizes)))
    out = (
        located.select(bucket.alias("b"), "row_id", "c").repartition("b").sortWithinPartitions("b")
        .mapInArrow(_count, "row_id long, first_row_id long, copies long")
    )
    if same is not None:
        firsts = work.keep(same.groupBy("p").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies")))
        out = out.union(same.join(firsts, "p").select("row_id", "first_row_id", "copies"))
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(table(spark, sf_dir, "corpus_rows"))
    return found.where("row_id <> first_row_id").select("first_row_id", "row_id")


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per text with its number of copies."""
    rows = table(spark, sf_dir, "corpus_rows").select("row_id", "split", "label", "text")
    return copies(rows).where("row_id = first_row_id").join(rows, "row_id").select("row_id", "split", "label", "text", "copies")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates per batch (rows that aren't the first of their group) beside what prepared_counts says."""
    rows = table(spark, sf_dir, "corpus_rows").where("batch_id is not null").select("row_id", "batch_id")
    extra = copies(table(spark, sf_dir, "corpus_rows")).where("row_id <> first_row_id").select("row_id")
    counted = rows.join(extra.withColumn("extra", F.lit(1)), "row_id", "left").groupBy("batch_id").agg(F.count("extra").alias("duplicates"))
    said = table(spark, sf_dir, "prepared_counts").groupBy("batch_id").agg(F.max("duplicates").alias("recorded"))
    return said.join(counted, "batch_id", "left").select("batch_id", "recorded", F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


QUERIES = {"p4_found": p4_found, "p4_collapsed": p4_collapsed, "p4_counts": p4_counts}

_FORM = r"""
marked as (select row_id, split, label, batch_id, text, regexp_replace(t, '[;|](\s*\p{L}+(\s+\p{L}+){0,2}\s*:)', chr(57347) || '\1', 'g') as t
    from (select *, translate(replace(lower(text), 'ß', 'ss'), '@_#', chr(57344) || chr(57345) || chr(57346)) as t from corpus_rows where split is not null and label is not null)),
formed as materialized (select row_id, split, label, batch_id, text, array_to_string(list_sort(list_transform(case when regexp_matches(t, '^\s*\p{L}+(\s+\p{L}+){0,2}\s*:') then string_split(t, chr(57347)) else [t] end,
    lambda x: regexp_replace(x, '[\s\p{Z}\p{P}\x{1c}-\x{1f}\x{85}$+<=>^`|~\x{e003}]', chr(0)[:0], 'g'))), chr(0)[:0]) as f from marked),
groups as materialized (select *, min(row_id) over g as first_row_id, count(*) over g as copies from formed window g as (partition by split, label, f))
"""
SQL = {
    "p4_found": f"with {_FORM} select first_row_id, row_id from groups where row_id <> first_row_id",
    "p4_collapsed": f"with {_FORM} select row_id, split, label, text, copies from groups where row_id = first_row_id",
    "p4_counts": f"with {_FORM}, c as (select batch_id, count(*) as n from groups where row_id <> first_row_id and batch_id is not null group by 1) select p.batch_id, max(p.duplicates) as recorded, coalesce(any_value(n), 0) as duplicates from prepared_counts p left join c using (batch_id) group by 1",
}
