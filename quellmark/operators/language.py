"""Language identification: byte features of the first words, weights per language, scores, ranks and reliability.

Profiles are fitted on labelled texts other than those judged, and are small: features of at most SAMPLE texts. A judged text
is read once, in the partition that holds it; its features are looked up there, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellmark.runtime import spread

#: Languages in the order that breaks ties; ID and MS are one profile, under ID.
LANGUAGES = ("AR", "DE", "EN", "ES", "FR", "HI", "IT", "JA", "KO", "ID", "PT", "RU", "TR", "VI", "ZH")
#: Bytes of a text that are read, features kept, bytes of a chunk, and the least features of a reliable answer.
BYTES, FEATURES, CHUNK, LEAST = 1000, 500, 6, 3
#: Scale of the scores, share of the language's average that the first must reach, and its least lead over the second.
SCALE, SHARE, LEAD = 0.0001, 0.85, 0.02
#: Labelled texts that profiles are fitted on, at most, and texts that must have a feature for it to count.
SAMPLE, TEXTS = 20_000, 2
#: Weight of a feature that only one language has.
WHOLE = 10_000

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_LETTERS = rf"(?:[^\P{{L}}{_CJK}]|\p{{M}})+"
_TOKEN = regex.compile(rf"([{_CJK}])|{_LETTERS}(?:['’]{_LETTERS})*")


def opening(text: str) -> str:
    """What is read of a text: up to its first NUL and BYTES bytes of whole characters."""
    text = text.partition("\0")[0]
    return text if len(text) * 4 <= BYTES else text.encode()[:BYTES].decode(errors="ignore")


def features(text: str) -> list[bytes]:
    """The distinct features of a text in order: ideographs and short words between blanks, longer words as their first, inner and last bytes."""
    out: dict[bytes, None] = {}
    for m in _TOKEN.finditer(opening(text).replace("İ", "i").replace("Σ", "σ").lower()):
        word = m[0].encode()
        if len(word) <= CHUNK:
            out[b" " + word + b" "] = None
            continue
        out[b" " + word[:CHUNK]] = None
        for k in range(CHUNK, len(word) - CHUNK, CHUNK):
            out[word[k : k + CHUNK]] = None
        out[word[-CHUNK:] + b" "] = None
    return list(out)[:FEATURES]


def key(feature: bytes) -> int:
    """A feature's bytes as one number (at most eight bytes)."""
    return int.from_bytes(feature, "little", signed=False) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], ["key", "features"])


def feature_lists(texts: DataFrame) -> DataFrame:
    """key, features of (key, text); null keys and texts are left out, a text without letters has none."""
    used = texts.where("key is not null and text is not null").select("key", "text")
    return spread(used).mapInArrow(_features, f"key {dict(used.dtypes)['key']}, features array<binary>")


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` rows of (key, lang, text) with a known language: those of the smallest hashes of their keys."""
    rows = labelled.where(F.col("lang").isin(*LANGUAGES) & F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.orderBy(F.xxhash64("key"), "key").limit(sample)


def profile_table(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, feature, weight: WHOLE times the language's part of the feature's shares of texts, over features of TEXTS texts and more."""
    rows = sampled(labelled, sample)
    lists = feature_lists(rows.select(F.struct("key", "lang").alias("key"), "text")).select("key.lang", F.explode("features").alias("feature"))
    counts = lists.groupBy("lang", "feature").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))  # a row per language
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    sums = shares.groupBy("feature").agg(F.sum("share").alias("all"), F.sum("n").alias("texts")).where(F.col("texts") >= TEXTS)
    weight = F.floor(F.lit(WHOLE) * F.col("share") / F.col("all") + 1e-9)
    return shares.join(sums, "feature").select("lang", "feature", weight.cast("long").alias("weight")).where("weight > 0")


class Profiles:
    """Features (sorted keys), weights per language, and each language's average score of its own labelled texts."""

    def __init__(self, rows: list[tuple[str, bytes, int]]):
        keys = np.array([key(bytes(f)) for _, f, _ in rows], np.int64)
        self.keys, at = np.unique(keys, return_inverse=True) if len(keys) else (keys, keys)
        self.weights = np.zeros((len(self.keys) + 1, len(LANGUAGES)))
        for (lang, _, weight), k in zip(rows, at):
            self.weights[k, LANGUAGES.index(lang)] = weight
        self.averages = np.zeros(len(LANGUAGES))

    def raw(self, found: list[bytes]) -> np.ndarray:
        """1 and the weights of the features, per language."""
        if not found or not len(self.keys):
            return np.ones(len(LANGUAGES))
        own = np.array([key(f) for f in found], np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return 1 + self.weights[np.where(self.keys[at] == own, at, len(self.keys))].sum(0)


    def detect(self, text: str) -> tuple[str | None, bool]:
        """(best language, whether it is reliable) of one text, as `detect` says it of a table."""
        found = features(text)
        raw = self.raw(found)
        order = [k for k in np.argsort(-raw, kind="stable") if raw[k] > 1] if found else []
        if not order:
            return None, False
        first, second = (1 - np.exp(-SCALE / len(found) * raw[k]) if k is not None else 0.0 for k in (order[0], order[1] if len(order) > 1 else None))
        return LANGUAGES[order[0]], bool(len(found) >= LEAST and first >= SHARE * self.averages[order[0]] and first - second > LEAD)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of (key, lang, text); what reaches the driver is bounded by the features of `sample` texts."""
    profiles = Profiles([(r["lang"], r["feature"], r["weight"]) for r in profile_table(labelled, sample).collect()])
    rows = sampled(labelled, sample)
    own = scores(rows.select(F.struct("key", "lang").alias("key"), "text"), profiles).select("key.lang", F.expr("get(filter(scores, s -> s.lang = key.lang), 0).score").alias("score"))
    for r in own.groupBy("lang").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("a")).collect():
        profiles.averages[LANGUAGES.index(r["lang"])] = r["a"]
    return profiles


SCORES = "features int, scores array<struct<lang: string, raw: double, score: double>>"


def scores(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """key, features (their number), scores (lang, raw, score of languages with any weight, best first, ties in the order of LANGUAGES)."""
    spread_ = texts.sparkSession.sparkContext.broadcast(profiles)
    item = pa.struct([("lang", pa.string()), ("raw", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread_.value
        for batch in batches:
            counts, out = [], []
            for text in batch.column(1).to_pylist():
                found = features(text)
                raw = known.raw(found)
                order = [k for k in np.argsort(-raw, kind="stable") if raw[k] > 1] if found else []
                counts.append(len(found))
                out.append([{"lang": LANGUAGES[k], "raw": raw[k], "score": 1 - np.exp(-SCALE / len(found) * raw[k])} for k in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(out, pa.list_(item))], ["key", "features", "scores"])

    used = texts.where("key is not null and text is not null").select("key", "text")
    return spread(used).mapInArrow(run, f"key {dict(used.dtypes)['key']}, {SCORES}")


def detect(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """key, lang, reliable, top, second, features: the best language, null without letters or known features.

    Reliable is an answer of LEAST features whose score reaches SHARE of the language's average and leads the second by LEAD.
    """
    averages = F.create_map(*(x for k, c in enumerate(LANGUAGES) for x in (F.lit(c), F.lit(float(profiles.averages[k])))))
    first, top, second = F.get("scores", F.lit(0)), F.coalesce(F.get("scores", F.lit(0))["score"], F.lit(0.0)), F.coalesce(F.get("scores", F.lit(1))["score"], F.lit(0.0))
    reliable = first.isNotNull() & (F.col("features") >= LEAST) & (top >= SHARE * averages[first["lang"]]) & (top - second > LEAD)
    return scores(texts, profiles).select("key", first["lang"].alias("lang"), F.coalesce(reliable, F.lit(False)).alias("reliable"), top.alias("top"), second.alias("second"), "features")


def routes(detected: DataFrame, expected: Column, supported: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Per expected language how many texts went right, nowhere and wrong, with rates (0 where nothing could go there); all other codes are `unsupported`, and should go nowhere."""
    known = F.coalesce(expected.isin(*supported), F.lit(False))
    rows = detected.withColumn("expected", F.when(known, expected).otherwise("unsupported")).withColumn("known", known)
    right = F.col("reliable") & (F.col("lang") == F.col("expected"))
    counted = rows.groupBy("expected", "known").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(right).alias("correct"), F.count_if(~F.col("reliable")).alias("unknown"), F.count_if(F.col("reliable") & ~right).alias("misrouted")
    )

    def rate(a: str, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0)), 6)

    return counted.select(
        "expected", "rows", "correct", "unknown", "misrouted", rate("correct", F.col("rows")).alias("route_accuracy"), rate("unknown", F.col("rows")).alias("unknown_rate"),
        rate("misrouted", F.col("rows")).alias("misroute_rate"), rate("correct", F.col("correct") + F.col("misrouted")).alias("known_route_precision"),
        F.when(~F.col("known"), rate("unknown", F.col("rows"))).alias("unsupported_rejection_rate"),
    )
