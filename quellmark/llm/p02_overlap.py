"""Problem 2: the same or nearly the same records across splits.

Two texts of L words (the longer) match when they differ in at most floor(L / 10) words. One edit touches at most N of
a text's word N-grams, so two matching texts share one of the d * N + 1 first N-grams of each under any common order of
all N-grams, d = floor(L / 10). The order puts rare N-grams first (by their least common word's count over all rows),
which keeps the partitioned hash table of evaluation N-grams and the hits of the training scan small. A text takes as many
as its longest possible partner allows. Texts of fewer than nine words must be equal and meet by the digest of their words.
The containment of the evaluation text's N-grams in the training text it hits decides which hits stay: d edits take at most
d * N of them away. What is contained enough is checked by an exact edit distance over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.llm.forms import words
from quellmark.runtime import Workspace, table

#: Words of an N-gram. TESTDATA fixes one differing word in ten, so short texts need N-grams shorter than five words.
N = 3
#: One word in so many may differ.
PER = 10
#: N-grams that make up more than 1/HOT of all entries are hot (fewer than HOT), and are dealt to SALTS parts.
HOT, SALTS = 1_024, 64
#: Words counted apart: those that make up more than 1/COMMON of all words, hence fewer than COMMON of them.
COMMON = 65_536
EVALUATION = ("validation", "test")


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """64-bit word hashes of all texts in a row, the number of words of each text, and the words."""
    split = [words(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) & (2**63 - 1) for w in unique), np.int64, len(unique))
    return hashes[codes], lengths, split


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, _, _ = _flat(batch.column(0).to_pylist())
        unique, counts = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(counts.astype(np.int64))], ["w", "n"])


def common_words(texts: DataFrame, bound: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words that make up more than 1/bound of all; by that at most `bound` of them."""
    work = Workspace(texts.sparkSession, "p2c")
    counted = work.keep(texts.select("text").mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") > total / bound).toPandas()
    work.drop(counted)
    order = np.argsort(rows["w"].to_numpy(np.int64))
    return rows["w"].to_numpy(np.int64)[order], rows["n"].to_numpy(np.int64)[order]


def _digest(ws: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(ws).encode(), digest_size=16).digest()


def _in_order(doc: np.ndarray, least: np.ndarray, gram: np.ndarray, docs: int) -> np.ndarray:
    """The order by doc, least and gram. One sort by as much of the three as fits 64 bits, unless two N-grams agree in that much."""
    kinds, rank = np.unique(least, return_inverse=True)
    high = (max(docs - 1, 1)).bit_length() + (max(len(kinds) - 1, 1)).bit_length()
    if high <= 40:
        wide = np.uint64(64 - high)
        key = ((doc.astype(np.uint64) << np.uint64((max(len(kinds) - 1, 1)).bit_length())) | rank.astype(np.uint64)) << wide
        key |= (gram.astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(high)
        order = np.argsort(key, kind="stable")
        key, grams = key[order], gram[order]
        if not ((key[1:] == key[:-1]) & (grams[1:] != grams[:-1])).any():
            return order
    return np.lexsort((gram, least, doc))


def _entries(common: tuple[np.ndarray, np.ndarray]):
    """A function from (row_id, side, text) to one row per text (g null) and one per leading N-gram of each text."""
    known, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            hashes, lengths, split = _flat(batch.column(2).to_pylist())
            digests = [_digest(ws) for ws in split]
            doc = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rank = np.zeros(len(hashes), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[place] == hashes, counts[place], 0)
            # copies within the batch and texts too short to differ give no entries
            first = np.zeros(len(lengths), bool)
            first[list({(d, s): i for i, (d, s) in reversed(list(enumerate(zip(digests, sides))))}.values())] = True
            # edits that a text's longest possible partner allows
            edits = lengths * PER // (PER - 1) // PER
            start = np.flatnonzero((at <= lengths[doc] - N) & first[doc] & (edits[doc] > 0)) if len(hashes) else np.zeros(0, np.int64)
            gram, least = hashes[start].astype(np.uint64), rank[start]
            for k in range(1, N):
                gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k].astype(np.uint64)
                least = np.minimum(least, rank[start + k])
            gram = gram.view(np.int64)
            order = _in_order(doc[start], least, gram, len(lengths))
            start, gram = start[order], gram[order]
            owner = doc[start]
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            keep = nth <= edits[owner] * N
            start, gram, owner, nth = start[keep], gram[keep], owner[keep], nth[keep]
            every = np.arange(len(lengths))
            both = np.concatenate([every, owner])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, np.zeros(len(owner), np.int64)])),
                    pa.array(sides[both].astype(bool)),
                    pa.array([digests[i] for i in both], pa.binary()),
                    pa.array(np.concatenate([np.zeros(len(every), np.int64), gram]), mask=np.arange(len(both)) < len(every)),
                    # the number of words and the place of the N-gram among them
                    pa.array(np.concatenate([np.zeros(len(every), np.int64), lengths[owner] << 32 | at[start]])),
                    pa.array(np.concatenate([np.zeros(len(every)), nth]).astype(np.int32)),
                ],
                ["row_id", "evaluation", "h", "g", "place", "nth"],
            )

    return run


def distance_within(a: list[str], b: list[str], most: int) -> int | None:
    """The edit distance over words (replaced, added, dropped), or None above `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            cost = [v + 1 for v in (last.get(j), now.get(j - 1)) if v is not None]
            if j and (j - 1) in last:
                cost.append(last[j - 1] + (x != b[j - 1]))
            if not j:
                cost.append(i)
            now[j] = min(cost)
        if min(now.values()) > most:
            return None
        last = now
    end = last.get(len(b))
    return end if end is not None and end <= most else None


def shingles(ws: list[str]) -> frozenset:
    """The distinct word N-grams of a text of at least N words."""
    return frozenset(zip(*(ws[k:] for k in range(N))))


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    out, split = [], {t: words(t) for t in {*pdf["td"], *pdf["te"]}}
    grams = {t: shingles(ws) for t, ws in split.items()}
    for dev, held, a, b in zip(pdf["hd"], pdf["he"], pdf["td"], pdf["te"]):
        x, y = split[a], split[b]
        most = max(len(x), len(y)) // PER
        # containment of the evaluation text: every edit takes N of its N-grams at most
        own = grams[b]
        missing = len(own - grams[a])
        if missing > most * N:
            continue
        found = distance_within(x, y, most)
        if found is not None:
            out.append((dev, held, found, 1 - missing / len(own)))
    return pd.DataFrame(out, columns=["hd", "he", "distance", "containment"])


def _contained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hd, he, containment of the hits whose containment allows a match, without a look at the words' order."""
    for pdf in batches:
        split = {t: words(t) for t in {*pdf["td"], *pdf["te"]}}
        grams = {t: shingles(ws) for t, ws in split.items()}
        found = [(dev, held, len(grams[b] - grams[a]), len(grams[b]), max(len(split[a]), len(split[b])) // PER) for dev, held, a, b in zip(pdf["hd"], pdf["he"], pdf["td"], pdf["te"])]
        yield pd.DataFrame([(d, h, 1 - miss / own) for d, h, miss, own, most in found if miss <= most * N], columns=["hd", "he", "containment"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return map(_verify, batches)


def hot_grams(grams: DataFrame, share: int = HOT) -> list[int]:
    """N-grams that make up more than 1/share of the entries, by a bounded sketch; fewer than `share`."""
    found = grams.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(g, {share}, {16 * share})").alias("top")).first()
    return [r["item"] for r in found["top"] or () if r["count"] * share > found["n"] and r["count"] > share]


def _meetings(grams: DataFrame) -> DataFrame:
    """hd, he: texts of the two sides that share an N-gram and may be near. Copies of an entry are dropped where it is sent to meet the others."""
    hot = hot_grams(grams)
    salted = F.col("g").isin(hot) if hot else F.lit(False)
    held = grams.where("evaluation").select("g", F.col("h").alias("he"), F.col("place").alias("pe"), F.col("nth").alias("ne"))
    train = grams.where("not evaluation").select("g", F.col("h").alias("hd"), F.col("place").alias("pd"), F.col("nth").alias("nd"))
    on = ["g"]
    if hot:
        on = ["g", "salt"]
        train = train.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("hd"), F.lit(SALTS)).cast("int")).otherwise(0))
        held = held.withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    train, held = train.repartition(*on).distinct(), held.repartition(*on).distinct()
    (we, ae), (wd, ad) = ((F.shiftright(c, 32), F.col(c).bitwiseAND(2**32 - 1)) for c in ("pe", "pd"))
    most = F.floor(F.greatest(we, wd) / PER)
    # what the pair's own number of edits allows, for lengths, places and how far down the order the N-gram may stand
    near = (F.abs(we - wd) <= most) & (F.abs(ae - ad) <= most) & (F.greatest("ne", "nd") <= most * N) & (most > 0)
    return train.join(held, on).where(near & (F.col("hd") != F.col("he"))).select("hd", "he").distinct()


def class_overlaps(rows: DataFrame, check=_verified, out: str = "hd binary, he binary, distance int, containment double") -> tuple[DataFrame, DataFrame]:
    """Classes of rows of equal words, (row_id, evaluation, h), and the pairs of different classes that match, (hd, he, distance, containment).

    Rows with a null split, row_id or text take no part; empty texts have no words and are one class; columns other than
    row_id, split and text are never read. Only classes meet, so copies cost nothing.
    """
    work = Workspace(rows.sparkSession, "p2")
    evaluation = F.col("split").isin(*EVALUATION)
    used = rows.where(evaluation | (F.col("split") == "development")).where("row_id is not null and text is not null")
    used = used.select("row_id", evaluation.alias("evaluation"), "text")
    schema = "row_id long, evaluation boolean, h binary, g long, place long, nth int"
    entries = work.keep(used.mapInArrow(_entries(common_words(used)), schema))
    texts = entries.where("g is null").select("row_id", "evaluation", "h")
    hits = work.keep(_meetings(entries.where("g is not null").select("evaluation", "h", "g", "place", "nth")))
    # one row stands for its text; only texts that were hit are read again
    wanted = hits.select(F.explode(F.array("hd", "he")).alias("h")).distinct()
    owners = work.keep(texts.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("row_id").alias("row_id")))
    spelled = work.keep(owners.join(used.select("row_id", "text"), "row_id").select("h", "text"))
    pairs = hits.join(spelled.select(F.col("h").alias("hd"), F.col("text").alias("td")), "hd")
    pairs = pairs.join(spelled.select(F.col("h").alias("he"), F.col("text").alias("te")), "he")
    return texts, pairs.mapInPandas(check, out)


def overlaps(rows: DataFrame) -> DataFrame:
    """row_dev, row_eval, distance, containment of all pairs of a development and an evaluation row whose texts match.

    Rows with a null split, row_id or text take no part; empty texts match each other; ties don't occur (a pair is one
    row). A pair of classes is expanded to its rows at the very end.
    """
    texts, checked = class_overlaps(rows)
    left = texts.where("not evaluation").select(F.col("row_id").alias("row_dev"), F.col("h").alias("hd"))
    right = texts.where("evaluation").select(F.col("row_id").alias("row_eval"), F.col("h").alias("he"))
    almost = left.join(checked, "hd").join(right, "he").select("row_dev", "row_eval", "distance", "containment")
    same = left.withColumnRenamed("hd", "h").join(right.withColumnRenamed("he", "h"), "h")
    return same.select("row_dev", "row_eval", F.lit(0).alias("distance"), F.lit(1.0).alias("containment")).union(almost)


def containments(rows: DataFrame) -> DataFrame:
    """dev, held, containment: pairs of class representatives (their smallest row_id) by containment alone, before any word distance; equal words have 1.

    Members of a class are the rows of equal words; nulls take no part, as in `overlaps`.
    """
    texts, pairs = class_overlaps(rows, _contained, "hd binary, he binary, containment double")
    dev = texts.where("not evaluation").groupBy("h").agg(F.min("row_id").alias("dev"))
    held = texts.where("evaluation").groupBy("h").agg(F.min("row_id").alias("held"))
    near = pairs.join(dev.withColumnRenamed("h", "hd"), "hd").join(held.withColumnRenamed("h", "he"), "he")
    return near.select("dev", "held", "containment").union(dev.join(held, "h").select("dev", "held", F.lit(1.0)))


def p2_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containments(table(spark, sf_dir, "corpus_rows"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(table(spark, sf_dir, "corpus_rows"))
    return pairs.select(F.least("row_dev", "row_eval").alias("row_id_a"), F.greatest("row_dev", "row_eval").alias("row_id_b"))


def report(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """split, dataset, pairs, evaluation_rows, equal_pairs, mean_containment, from the sizes of the classes: no pair is expanded.

    `datasets` has the dataset of each source_id; evaluation rows without one are reported under null.
    """
    texts, checked = class_overlaps(rows)
    dev = texts.where("not evaluation").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where(F.col("split").isin(*EVALUATION)).select("row_id", "split", "source_id").join(datasets, "source_id", "left")
    held = texts.where("evaluation").select("row_id", "h").join(held, "row_id").groupBy("h", "split", "dataset").agg(F.count(F.lit(1)).alias("m"))
    same = dev.join(held.select("h").distinct(), "h", "left_semi").select(F.col("h").alias("he"), F.lit(0).alias("distance"), F.lit(1.0).alias("containment"), "n")
    almost = checked.join(dev.withColumnRenamed("h", "hd"), "hd").select("he", "distance", "containment", "n")
    met = same.union(almost).groupBy("he").agg(
        F.sum("n").alias("pairs"), F.sum(F.when(F.col("distance") == 0, F.col("n")).otherwise(0)).alias("equal"), F.sum(F.col("containment") * F.col("n")).alias("contained")
    )
    summed = held.join(met.withColumnRenamed("he", "h"), "h").groupBy("split", "dataset").agg(
        F.sum(F.col("m") * F.col("pairs")).alias("pairs"), F.sum("m").alias("evaluation_rows"),
        F.sum(F.col("m") * F.col("equal")).alias("equal_pairs"), F.sum(F.col("m") * F.col("contained")).alias("contained"))
    return summed.select("split", "dataset", "pairs", "evaluation_rows", "equal_pairs", F.round(F.col("contained") / F.col("pairs"), 6).alias("mean_containment"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs per evaluation split and dataset (of the evaluation row's prepared source_id), and the rows they touch."""
    datasets = table(spark, sf_dir, "prepared_rows").select("source_id", F.split_part("source_id", F.lit("@"), F.lit(1)).alias("dataset"))
    return report(table(spark, sf_dir, "corpus_rows"), datasets)


QUERIES = {"p2_method": p2_method, "p2_found": p2_found, "p2_report": p2_report}
