"""Problem 7: languages of texts and of their segments, by hyperdimensional profiles.

Every letter has a random ±1 vector; a letter trigram is the product of its letters' vectors, permuted by place; a language's
prototype bundles the trigrams of labelled words, weighted by the square root of their share, less what all languages
have in common. Words are assigned to segments by the best path through the words' products with the prototypes, which are
computed once per trigram, where a change of language costs SWITCH. The words of a segment are bundled into the segment's vector;
its language is the prototype of the largest cosine, its confidence that language's share of all languages' (softmax of the
cosines, in units of what chance gives).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.llm.p06_lookalikes import transducer
from quellmark.runtime import Workspace, table

LANGUAGES = ("AR", "DE", "EN", "ES", "FR", "ID", "IT", "PT", "RU", "TR", "VI", "ZH")
#: Dimensions of the vectors; labelled rows that the prototypes are fitted on, at most.
DIM, SAMPLE = 4096, 20_000
#: What a change of language costs on the best path, the least words and letters of a sentence, and the softmax's scale.
SWITCH, WORDS, LETTERS, SCALE = 20.0, 6, 20, 0.5
#: The least words of a shorter sentence that stands between sentence ends, and the least confidence in it.
SHORT, SURE = 3, 0.8
#: Words whose vectors are held at once while segments are bundled.
BLOCK = 30_000
#: Names of users, tags and links end where ideographs begin, as no blank need part them.
_TOKEN = re.compile(r"https?://[^\s぀-ヿ㐀-鿿]+|[@#][^\W぀-ヿ㐀-鿿]+|([぀-ヿ㐀-鿿])|([^\W\d_぀-ヿ㐀-鿿]+)|([.!?…؟।]+(?![^\s@#぀-ヿ㐀-鿿])|[。！？\n])")


def parts(text: str | None) -> tuple[list[str], list[int]]:
    """Lower-case words of letters, in one consistent form, and the number of sentence ends before each.

    Each ideograph is a word; names of users, tags and links are none.
    """
    words, numbers, ends = [], [], 0
    for a, b, end in _TOKEN.findall(transducer()(text).lower()) if text else ():
        if a or b:
            words.append(a or b)
            numbers.append(ends)
        elif end:
            ends += 1
    return words, numbers


def tokens(text: str | None) -> list[str]:
    """The words of a text, without its sentence ends."""
    return parts(text)[0]


def _letters(points: np.ndarray) -> np.ndarray:
    """The ±1 vectors of code points."""
    return np.stack([np.random.default_rng(int(p)).integers(0, 2, DIM, np.int8) * 2 - 1 for p in points]) if len(points) else np.zeros((0, DIM), np.int8)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the words between marks, as 63-bit codes, and the number of the word each comes from."""
    joined = "".join(f"_{w}_" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], owner[at]


def _vectors(grams: np.ndarray) -> np.ndarray:
    """The trigrams' vectors: letters permuted (rolled) by place and multiplied."""
    mask = (1 << 21) - 1
    parts = np.stack([grams >> 42, (grams >> 21) & mask, grams & mask])
    points, index = np.unique(parts, return_inverse=True)
    letters, index = _letters(points), index.reshape(parts.shape)
    return np.roll(letters, 2, 1)[index[0]] * np.roll(letters, 1, 1)[index[1]] * letters[index[2]]


def _products(grams: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Each trigram's product with each prototype, in blocks."""
    out = np.zeros((len(grams), len(LANGUAGES)), np.float32)
    for k in range(0, len(grams), 4096):
        out[k : k + 4096] = _vectors(grams[k : k + 4096]).astype(np.float32) @ prototypes
    return out


class Profiles:
    """Prototypes of the languages and the products of the trigrams they were fitted on."""

    def __init__(self, words: list[list[str]], labels: list[int]):
        grams_of, share = [], []
        for k in range(len(LANGUAGES)):
            own = [w for ws, lab in zip(words, labels) if lab == k for w in ws]
            grams, n = np.unique(_trigrams(own)[0], return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0))
            grams_of.append(grams)
            share.append(np.sqrt(n / max(n.sum(), 1)))
        self.grams = np.unique(np.concatenate(grams_of))
        weights = np.zeros((len(self.grams), len(LANGUAGES)), np.float32)
        for k, (grams, w) in enumerate(zip(grams_of, share)):
            weights[np.searchsorted(self.grams, grams), k] = w
        weights -= weights.mean(1, keepdims=True)
        prototypes = np.zeros((DIM, len(LANGUAGES)), np.float32)
        for k in range(0, len(self.grams), 4096):
            prototypes += _vectors(self.grams[k : k + 4096]).astype(np.float32).T @ weights[k : k + 4096]
        self.prototypes = prototypes / (np.linalg.norm(prototypes, axis=0) + 1e-9)
        self.products = _products(self.grams, self.prototypes)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the sum of its trigrams' products with each prototype, and its number of trigrams."""
        grams, owner = _trigrams(words)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        rows = self.products[place]
        new = self.grams[place] != grams
        if new.any():
            fresh, index = np.unique(grams[new], return_inverse=True)
            rows[new] = _products(fresh, self.prototypes)[index]
        out = np.zeros((len(words), len(LANGUAGES)), np.float32)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = np.add.reduceat(rows, starts) if len(starts) else 0
        return out, np.bincount(owner, minlength=len(words)).astype(np.float32)


def word_vectors(words: list[str]) -> np.ndarray:
    """The bundled trigram vectors of words."""
    grams, owner = _trigrams(words)
    unique, index = np.unique(grams, return_inverse=True)
    vectors = _vectors(unique).astype(np.int16) if len(unique) else np.zeros((0, DIM), np.int16)
    out = np.zeros((len(words), DIM), np.int16)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(owner))):
        out[owner[a]] = np.add.reduce(vectors[index[a:b]], axis=0, dtype=np.int16)
    return out


def _bundle(vectors: np.ndarray, codes: np.ndarray, run: int) -> np.ndarray:
    """The sum of the words' vectors, `run` at a time, which can't overflow."""
    parts = [np.add.reduce(vectors[codes[k : k + run]], axis=0, dtype=np.int16) for k in range(0, len(codes), run)]
    return np.sum(parts, axis=0, dtype=np.float32)


def _pieces(cut: np.ndarray, end: int) -> Iterator[list[tuple[int, int, int]]]:
    """(segment, first word, end) of all segments, in blocks of at most BLOCK words; a longer segment goes over several blocks."""
    block: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), end])):
        for c in range(a, b, BLOCK):
            d = min(b, c + BLOCK)
            if block and d - block[0][1] > BLOCK:
                yield block
                block = []
            block.append((k, c, d))
    if block:
        yield block


def cosines(words: np.ndarray, codes: np.ndarray, cut: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """The cosine of each segment's bundled vector with each prototype; segment k has the words codes[cut[k] : cut[k + 1]]."""
    out = np.zeros((len(cut), prototypes.shape[1]), np.float32)
    rows, sums = [], []

    def flush() -> None:
        if rows:
            block = np.stack(sums)
            out[rows] = block @ prototypes / np.maximum(np.linalg.norm(block, axis=1), 1)[:, None]
            rows.clear(), sums.clear()

    for block in _pieces(cut, len(codes)):
        first = block[0][1]
        own, local = np.unique(codes[first : block[-1][2]], return_inverse=True)
        vectors = word_vectors(words[own].tolist())
        run = max(1, 32_000 // max(1, int(vectors.max(initial=1)), -int(vectors.min(initial=-1))))
        for k, a, b in block:
            vector = _bundle(vectors, local[a - first : b - first], run)
            if rows and rows[-1] == k:
                sums[-1] += vector
                continue
            if len(rows) == 256:
                flush()
            rows.append(k), sums.append(vector)
    flush()
    return out


def best_paths(lengths: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word on its text's best path; all texts step in parallel, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if len(size) else 0
    back = np.zeros(scores.shape, np.int8)
    value = np.zeros((len(size), scores.shape[1]), np.float32)
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t words
    for t in range(steps):
        n = live[t]
        at = start[:n] + t
        if t:
            best = value[:n].argmax(1)
            jump = value[np.arange(n), best] - switch
            stay = value[:n] >= jump[:, None]
            back[at] = np.where(stay, np.arange(scores.shape[1]), best[:, None])
            value[:n] = np.where(stay, value[:n], jump[:, None])
        value[:n] += scores[at]
    path = np.zeros(len(scores), np.int8)
    state = value.argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def segments(texts: list[str | None], profiles: Profiles) -> pd.DataFrame:
    """text (its number), first_word, words, lang, confidence, letters, sentence (words of its longest whole sentence) of every segment of every text."""
    both = [parts(t) for t in texts]
    split = [ws for ws, _ in both]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.array([w for ws in split for w in ws], dtype=object)
    codes, unique = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.array([], dtype=object))
    per_word = profiles.scores(list(unique))[0] if len(unique) else np.zeros((0, len(LANGUAGES)), np.float32)
    scores = per_word[codes]
    path = best_paths(lengths, scores)
    text = np.repeat(np.arange(len(split)), lengths)
    cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    size = np.diff(np.append(cut, len(path)))
    width = np.fromiter(map(len, unique), np.int64, len(unique))[codes]
    if not len(cut):
        return pd.DataFrame({c: [] for c in ("text", "first_word", "words", "lang", "confidence", "letters", "sentence")})
    segment = np.repeat(np.arange(len(cut)), size)
    number = np.array([k for _, ns in both for k in ns], np.int64)
    begun = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    ended = np.append(begun[1:], len(path))
    sentence = np.zeros(len(cut), np.int64)
    whole = segment[begun] == segment[ended - 1]
    np.maximum.at(sentence, segment[begun][whole], (ended - begun)[whole])
    cosine = cosines(unique, codes, cut, profiles.prototypes)
    lang = cosine.argmax(1)
    near = SCALE * DIM**0.5 * cosine
    near = np.exp(near - near.max(1, keepdims=True))
    confidence = (near / near.sum(1, keepdims=True))[np.arange(len(cut)), lang]
    begin = np.cumsum(lengths) - lengths
    return pd.DataFrame(
        {"text": text[cut], "first_word": cut - begin[text[cut]], "words": size, "lang": np.array(LANGUAGES, dtype=object)[lang],
         "confidence": confidence.astype(float).round(6), "letters": np.add.reduceat(width, cut), "sentence": sentence}
    )


def named(code: Column) -> Column:
    """The language a code names, without case and region; null for missing codes and placeholders."""
    base = F.upper(F.regexp_extract(F.trim(code), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    return F.when(base.isin(*LANGUAGES), base)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most `sample` rows of (key, code, text), those with the smallest hashes of their key.

    Rows are counted first, so that no partition sends more than its share of the sample to the driver.
    """
    rows = labelled.select("key", named(F.col("code")).alias("lang"), "text").where("lang is not null and text is not null")
    share = min(1.0, 1.2 * sample / max(rows.count(), 1))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(2**30))).where(F.col("h") <= int(share * 2**30))
    rows = rows.orderBy("h", "key").limit(sample).select("lang", "text").collect()
    number = {lang: k for k, lang in enumerate(LANGUAGES)}
    return Profiles([tokens(r["text"]) for r in rows], [number[r["lang"]] for r in rows])


def sentence_like(found: pd.DataFrame) -> pd.DataFrame:
    """Segments as long as a sentence, WORDS words of LETTERS letters in all (an ideograph counts for two letters), and surer ones with a whole sentence."""
    letters = np.where(found["lang"] == "ZH", 2 * found["letters"], found["letters"])
    return found[(found["words"] >= WORDS) & (letters >= LETTERS) | (found["sentence"] >= SHORT) & (found["confidence"] >= SURE)]


def _segment(profiles, only_sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(batch.column(1).to_pylist(), profiles.value)
            if only_sentences:
                found = sentence_like(found)
            keys = batch.column(0).take(pa.array(found["text"].to_numpy(np.int64)))
            columns = [pa.array(found[c].to_numpy(t), kind) for c, t, kind in (
                ("first_word", np.int32, pa.int32()), ("words", np.int32, pa.int32()), ("lang", object, pa.string()), ("confidence", float, pa.float64()))]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "first_word", "words", "lang", "confidence"])

    return run


def segment_languages(texts: DataFrame, profiles: Profiles, only_sentences: bool = False) -> DataFrame:
    """key, first_word, words, lang, confidence of each segment of (key, text); a narrow step over the scan.

    Null keys and texts are left out; a text without letters has no segment; repeated rows give repeated segments.
    """
    spread = texts.sparkSession.sparkContext.broadcast(profiles)
    used = texts.where("key is not null and text is not null").select("key", "text")
    return used.mapInArrow(_segment(spread, only_sentences), "key string, first_word int, words int, lang string, confidence double")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prepared = table(spark, sf_dir, "prepared_rows").select(F.col("source_id").alias("key"), F.col("detector_language").alias("code"), "text")
    audit = table(spark, sf_dir, "behavior_audit").select(F.col("source_id").alias("key"), F.col("detector_language_code").alias("code"), "text")
    records = table(spark, sf_dir, "provenance").select("record_id", F.col("source_id").alias("key"), F.col("source_language_code").alias("code"))
    return prepared, audit, records


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_key, lang: each language that a sentence of a record is in and that its code doesn't name.

    A prepared text is segmented once, for its own row and for all provenance records of its source_id.
    """
    prepared, audit, records = _tables(spark, sf_dir)
    work = Workspace(spark, "p7")
    profiles = fit(prepared)
    spoken = work.keep(segment_languages(prepared, profiles, True).groupBy("key").agg(F.collect_set("lang").alias("langs")))

    def unnamed(df: DataFrame, name: str, key: Column) -> DataFrame:
        rows = df.select(F.lit(name).alias("record_table"), key.alias("record_key"), named(F.col("code")).alias("own"), F.explode("langs").alias("lang"))
        return rows.where("own is null or own <> lang").select("record_table", "record_key", "lang")

    own = unnamed(prepared.select("key", "code").join(spoken, "key"), "prepared_rows", F.col("key"))
    delivered = unnamed(records.where("record_id is not null").join(spoken, "key"), "provenance", F.col("record_id").cast("string"))
    heard = segment_languages(audit, profiles, True).groupBy("key").agg(F.collect_set("lang").alias("langs"))
    audited = unnamed(audit.select("key", "code").join(heard, "key"), "behavior_audit", F.col("key"))
    return own.union(delivered).union(audited)


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every prepared and audited text with its language and confidence."""
    prepared, audit, _ = _tables(spark, sf_dir)
    profiles = fit(prepared)
    out = [segment_languages(df, profiles).select(F.lit(name).alias("record_table"), F.col("key").alias("record_key"), "first_word", "words", "lang", "confidence")
           for name, df in (("prepared_rows", prepared), ("behavior_audit", audit))]
    return out[0].union(out[1])


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language and confidence per prepared and audited text: that of most of its words, the first in order of codes at ties."""
    found = p7_segments(spark, sf_dir)
    summed = found.groupBy("record_table", "record_key", "lang").agg(
        F.sum("words").alias("n"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("sure")
    )
    best = summed.groupBy("record_table", "record_key").agg(F.min(F.struct(-F.col("n"), "lang", "sure")).alias("b"), F.sum("n").alias("all"))
    return best.select("record_table", "record_key", "b.lang", F.round(F.col("b.sure") * -F.col("b.col1") / F.col("all"), 6).alias("confidence"))


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments, "p7_labels": p7_labels}
