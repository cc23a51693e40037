"""Problem 9: evaluation texts leaking into documents, searched with an FM-index per shard of documents.

A shard is a bounded number of whole documents. Its words become symbols of the evaluation vocabulary (any other word
is a separator: no passage can run over it), the suffixes are sorted by prefix doubling, and the Burrows-Wheeler
transform is kept as a wavelet matrix. All evaluation phrases of PHRASE words are searched backwards at once; what is
found is located through sampled suffix positions, and overlapping finds are merged to spans to be removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.llm.forms import words
from quellmark.runtime import table

#: Consecutive words of an item that make a leak.
PHRASE = 10
#: Symbols that a shard gathers before its index is built, and the distance of sampled suffix positions.
SHARD, SAMPLE = 1_000_000, 8
#: Evaluation words that one pass over the documents carries; a larger evaluation set is searched in blocks of so many.
BLOCK = 2_000_000


class Phrases:
    """The distinct PHRASE-word windows of the items, as symbols 1, 2, ... of their vocabulary."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.symbols: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, ws in items:
            if len(ws) < PHRASE:
                continue
            line = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in ws]
            for k in range(len(line) - PHRASE + 1):
                own = owners[tuple(line[k : k + PHRASE])]
                if item not in own:
                    own.append(item)
        self.windows = np.array(list(owners), np.int64).reshape(-1, PHRASE)
        self.owners = list(owners.values())


class FMIndex:
    """An FM-index over the symbols 0 (separator) to `sigma`; an end mark smaller than all is added here."""

    def __init__(self, text: np.ndarray, sigma: int):
        text, sigma = np.append(text + 1, 0), sigma + 1
        n = len(text)
        rank = text.astype(np.int64)
        width = 1
        while True:
            after = np.zeros(n, np.int64)
            if width < n:
                after[: n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (n + sigma + 2) + after, return_inverse=True)
            if rank.max() == n - 1:
                break
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.n = n
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        self.levels = max(1, int(sigma).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits: list[np.ndarray] = []
        row = bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.bits.append(bit.astype(bool))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        sampled = order % SAMPLE == 0
        self.marked = sampled
        self.before = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int64)
        self.positions = order[sampled]

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        low, high = np.zeros_like(upto), upto.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((symbols >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = self.bits[k][at]
            ones = self.ones[k][at]
            out |= bit.astype(np.int64) << level
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, low, high) of the phrases that occur."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k] + 1
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows of the sorted suffixes: steps back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.positions[self.before[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            steps[todo] += 1
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
        return out


def shard_finds(ids: list[int], texts: list[list[int]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, word position, phrase number) of every occurrence in the shard.

    Only stretches of at least PHRASE words of the evaluation vocabulary can hold a phrase; the rest is not indexed.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((s for t in texts for s in (*t, 0)), np.int64, int(lengths.sum()) + len(texts))
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    stops = np.flatnonzero(flat == 0)
    run = np.diff(np.concatenate([[-1], stops]))  # symbols up to and with each separator
    keep = np.repeat(run > PHRASE, run)
    flat, doc, place = flat[keep], doc[keep], place[keep]
    none = np.zeros(0, np.int64)
    if not len(flat) or not len(phrases.windows):
        return none, none, none
    index = FMIndex(flat, len(phrases.symbols))
    which, low, high = index.search(phrases.windows)
    count = high - low
    if not len(which):
        return none, none, none
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(rows)
    return doc[at], place[at], np.repeat(which, count)


def _scan(phrases, spans: bool):
    def flush(ids: list[int], texts: list[list[int]]) -> pa.RecordBatch:
        known = phrases.value
        doc, at, which = shard_finds(ids, texts, known)
        if not spans:
            pairs = sorted({(item, ids[d]) for d, w in zip(doc.tolist(), which.tolist()) for item in known.owners[w]})
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["item_id", "doc_id"]
            )
        out = []
        order = np.lexsort((at, doc))
        for d, a in zip(doc[order].tolist(), at[order].tolist()):
            if out and out[-1][0] == d and a <= out[-1][2]:
                out[-1][2] = max(out[-1][2], a + PHRASE)
            else:
                out.append([d, a, a + PHRASE])
        columns = [[ids[o[0]] for o in out], [o[1] for o in out], [o[2] for o in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "first_word", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.value.symbols.get
        ids: list[int] = []
        texts: list[list[int]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line = [get(w, 0) for w in words(text)]
                ids.append(doc)
                texts.append(line)
                size += len(line)
                if size >= SHARD:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return run


def _blocks(items: DataFrame) -> Iterator[Phrases]:
    """The items in blocks of at most BLOCK words, read one partition at a time."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], words(row["text"])))
        size += len(block[-1][1])
        if size >= BLOCK:
            yield Phrases(block)
            block, size = [], 0
    yield Phrases(block)


def _search(documents: DataFrame, items: DataFrame, spans: bool, schema: str) -> DataFrame:
    used = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for phrases in _blocks(items):
        part = used.mapInArrow(_scan(used.sparkSession.sparkContext.broadcast(phrases), spans), schema)
        out = part if out is None else out.union(part)
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id: documents that hold PHRASE or more consecutive words of an item, whatever case and punctuation.

    Null ids and texts take no part; items and documents of fewer words hold nothing; a pair is one row however often
    the passage occurs, repeated items and documents each give their own rows; no other column is read. The documents are
    never shuffled; every document is read whole.
    """
    return _search(documents, items, False, "item_id long, doc_id long").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, first_word, end_word: the merged spans of words (counted from 0, end exclusive) that leaked phrases cover."""
    return _search(documents, items, True, "doc_id long, first_word long, end_word long")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    counted = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(counted, "item_id")


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_items": p9_items}

_WINDOWS = "select {id}, array_to_string(ws[i:i + 9], ' ') as g, i from (select {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from {table}), lateral (select unnest(generate_series(1, len(ws) - 9)) as i)"
_FOUND = f"with d as ({_WINDOWS.format(id='doc_id', table='documents')}), e as ({_WINDOWS.format(id='item_id', table='eval_items')}), found as (select distinct item_id, doc_id from d join e using (g))"
SQL = {
    "p9_found": f"{_FOUND} select item_id, doc_id from found",
    "p9_items": f"{_FOUND} select item_id, any_value(suite) as suite, count(*) as documents from found join eval_items using (item_id) group by item_id",
}
