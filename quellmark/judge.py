"""The judge of messages: language, model, rules, lexicon, fusion and mask in one pass over the text.

Everything a verdict needs is small and travels to the workers once (a model has at most 65,536 weights); a message is read
once and nothing is shuffled, so tables and streams are judged alike. Where no loaded language is
recognised reliably, the verdict is that the message is safe.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quellmark.api import Judge, NotReady
from quellmark.functions import features as X
from quellmark.functions.text import nfkc_text
from quellmark.operators import language as L
from quellmark.operators import lexicon as W
from quellmark.operators import rules as R
from quellmark.operators.linear_model import I32
from quellmark.operators.masking import masked
from quellmark.operators.rule_pack import default_pack
from quellmark.runtime import ship, spread

#: Locales in registry order, and the feature profile of those that don't have the usual one.
REGISTRY = ("EN", "ZH", "ES", "AR", "ID", "PT", "FR", "HI", "RU", "JA", "DE", "TR", "VI", "KO", "IT")
ALIASES = {"MS": "ID"}
PROFILE = {"ES": "spanish", "TR": "turkish", "ZH": "chinese", "JA": "char_25", "KO": "korean"}
#: Points from which a message isn't safe, points of a lexicon hit, most points of the model beside suppressed evidence.
UNSAFE, HIT, CAPPED = 50, 30, 49

JUDGEMENT = StructType([StructField("safe", BooleanType()), StructField("score", DoubleType()), StructField("locale", StringType()), StructField("grawlix", StringType())])


def chosen(locales: str | list[str] | None, there: list[str]) -> list[str]:
    """The wanted locales in registry order, once each: case and blanks don't matter, MS is ID, `all` stands alone; unknown ones and ones without a model are errors."""
    if locales is None or locales == "all":
        return [c for c in REGISTRY if c in there]
    wanted = [c.strip().upper() for c in (locales.split(",") if isinstance(locales, str) else locales)]
    if "ALL" in wanted:
        if len(wanted) > 1:
            raise ValueError("all stands alone")
        return [c for c in REGISTRY if c in there]
    wanted = [ALIASES.get(c, c) for c in wanted]
    for c in wanted:
        if c not in REGISTRY or c not in there:
            raise ValueError(f"no such locale: {c!r}")
    return [c for c in REGISTRY if c in wanted]


@dataclass
class Model:
    """A sparse model of one locale."""

    weights: np.ndarray
    bias: int
    boundary: int
    scale: int
    profile: str = "word_char_35"

    @classmethod
    def of(cls, judge: Judge, profile: str = "word_char_35") -> Model:
        weights = np.zeros(X.BINS, np.int64)
        for r in judge.weights.collect():  # at most BINS rows
            weights[r["bin"]] = r["weight"]
        return cls(weights, judge.bias, judge.boundary, judge.scale, profile)

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 100 with the boundary at 50."""
        plain = [nfkc_text(t).lower() for t in texts]
        if self.profile in X.SHAPES:
            sizes, bins = X.hashed_sets(plain, X.SHAPES[self.profile])
        else:
            found = [sorted(X.PROFILES[self.profile](t)) for t in plain]
            sizes, bins = np.array([len(f) for f in found], np.int64), np.array([b for f in found for b in f], np.int64)
        sums = np.concatenate([[0], np.cumsum(self.weights[bins])])
        ends = np.cumsum(sizes)
        gap = np.clip(sums[ends] - sums[ends - sizes] + self.bias, -I32 - 1, I32) - self.boundary
        far = np.abs(gap) * 50
        return np.where(gap >= 0, 50 + np.minimum(50, far // self.scale), 50 - np.minimum(50, -(-far // self.scale)))


@dataclass
class MessageJudge:
    """Models per locale, language profiles, a rule pack and lexicons; `detect` off judges by every locale and takes the worst."""

    models: dict[str, Model]
    profiles: L.Profiles | None = None
    pack: list[tuple[str, str, str]] | None = None
    lexicons: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    locales: str | list[str] | None = None
    detect: bool = True
    grawlix: bool = False
    reply: bool = False

    def __post_init__(self) -> None:
        self.loaded = chosen(self.locales, list(self.models))
        if self.detect and self.profiles is None:
            raise ValueError("detection needs language profiles")
        self.packs = R.packs(self.pack if self.pack is not None else default_pack())
        self.lookups = {c: W.lookups(self.lexicons[c]) for c in self.loaded if c in self.lexicons}
        self.closed = False

    def ready(self) -> bool:
        return not self.closed and bool(self.loaded)

    def close(self) -> None:
        self.closed = True

    def _locales(self, text: str) -> list[str]:
        if not self.detect:
            return self.loaded
        lang, reliable = self.profiles.detect(text)
        return [lang] if reliable and lang in self.loaded else []

    def _judged(self, text: str, locale: str, model: int) -> tuple[int, list[tuple[int, int]]]:
        """(points, spans of the evidence) of a message in a locale whose model gives so many points."""
        events = R.analyze(text, self.packs[locale], self.reply) if locale in self.packs else []
        hits = W.matches(text, self.lookups[locale]) if locale in self.lookups else []
        rule = max((e.points for e in events if e.suppressor is None), default=0)
        if any(e.suppressor for e in events):
            model = min(model, CAPPED)
        spans = [(first, last) for _, _, first, last in hits]
        spans += [(e.raw_first, e.raw_last) if e.suppressor is None else (e.by_raw_first, e.by_raw_last) for e in events]
        return max(rule, model, HIT if hits else 0), spans

    def verdicts(self, texts: list[str]) -> list[tuple[bool, float, str | None, str | None]]:
        """(safe, score from 0 to 1, locale, masked text) of messages; the mask only of unsafe ones, and only if it is asked for."""
        if not self.ready():
            return [(True, 0.0, None, None) for _ in texts]
        by: dict[str, list[int]] = defaultdict(list)
        for k, text in enumerate(texts):
            for locale in self._locales(text) if text else ():
                by[locale].append(k)
        best: dict[int, tuple] = {}
        for place, locale in enumerate(self.loaded):
            rows = by.get(locale, [])
            if not rows:
                continue
            for k, model in zip(rows, self.models[locale].scores([texts[k] for k in rows]).tolist()):
                points, spans = self._judged(texts[k], locale, model)
                # of equal points the last locale in order counts
                best[k] = max(best.get(k, (-1,)), (points, place, locale, spans), key=lambda b: b[:2])
        out = []
        for k, text in enumerate(texts):
            if k not in best:
                out.append((True, 0.0, None, None))
                continue
            points, _, locale, spans = best[k]
            safe = points < UNSAFE
            out.append((safe, points / 100, locale, masked(text, spans) if self.grawlix and not safe else None))
        return out

    def judge(self, messages: DataFrame, text: str = "text") -> DataFrame:
        """The messages with `judgement`, a struct of safe, score, locale, grawlix; null and empty texts are safe. A closed judge raises NotReady."""
        if self.closed:
            raise NotReady("the judge is closed")
        spark = messages.sparkSession
        ship(spark)
        known = spark.sparkContext.broadcast(self)
        kind = pa.struct([("safe", pa.bool_()), ("score", pa.float64()), ("locale", pa.string()), ("grawlix", pa.string())])
        names = messages.columns
        at = names.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = known.value.verdicts([t or "" for t in batch.column(at).to_pylist()])
                told = pa.array([dict(zip(("safe", "score", "locale", "grawlix"), f)) for f in found], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, told], [*names, "judgement"])

        return spread(messages).mapInArrow(run, StructType([*messages.schema.fields, StructField("judgement", JUDGEMENT)]))


def lines(judged: DataFrame) -> DataFrame:
    """One JSON object per judged message."""
    from quellmark.sources.sinks import verdict_line

    j = [F.col(f"judgement.{c}") for c in ("safe", "score", "locale", "grawlix")]
    return judged.withColumn("line", verdict_line(*j))
