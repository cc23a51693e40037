"""Context rules: phrases with roles, the events they make, what suppresses them, and the scores that follow.

The phrases are a table of (lang, role, phrase). A message is read once, in the partition that holds it: its symbols (words, or
characters in scripts without word gaps) are looked up, events are framed within propositions, and only events leave the
partition. Nothing is shuffled, whatever the number of phrases per message.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellmark.functions.text import nfkc_text
from quellmark.operators.context import RULE_QUOTES, quote_ranges, tokens
from quellmark.operators.rule_pack import COMPACT, ROLES, default_pack
from quellmark.runtime import spread

#: Points of the events, and the most code points between the parts of a frame.
POINTS = {"threat": 95, "wish": 85, "self_harm": 95, "insult": 70, "sentiment": 20}
GAP = 8
#: Symbols between a frame and its target, words or characters.
NEAR_WORDS, NEAR_CHARACTERS = 2, 8
CATEGORY = {"threat": "threat_language", "wish": "threat_language", "self_harm": "threat_language", "insult": "targeted_abuse", "sentiment": "sentiment_support"}
#: Events of propositions that are one implicit phrase.
IMPLICIT = {"implicit_threat": "threat", "implicit_wish": "wish", "implicit_insult": "insult"}
#: Characters of scripts without word gaps that end clauses, ask, end scopes, and quote.
ENDS, ASKS, COMMAS, MARKS = set(".!?;؟۔।॥。！？；\n\r"), set("?؟？"), set(",，"), set('"„“”«»「」『』')
_ASKS = re.compile("[?؟？]")
_CLUSTER = regex.compile(r"\X")


class Span(NamedTuple):
    first: int
    last: int


class Pack:
    """The phrases of one language by role; phrases are tuples of words, or strings of characters where `compact`."""

    def __init__(self, lang: str, rows: Iterable[tuple[str, str]]):
        self.lang, self.compact = lang, lang in COMPACT
        self.near = NEAR_CHARACTERS if self.compact else NEAR_WORDS
        self.roles: dict = defaultdict(list)
        for role, phrase in rows:
            if role not in ROLES:
                raise ValueError(f"unknown role: {role!r}")
            own = nfkc_text(phrase).lower()
            symbols = "".join(own.split()) if self.compact else tuple(own.split())
            if symbols and role not in self.roles[symbols]:
                self.roles[symbols].append(role)
        self.lengths = sorted({len(k) for k in self.roles})


def packs(rows: Iterable[tuple[str, str, str]]) -> dict[str, Pack]:
    by_lang: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for lang, role, phrase in rows:
        by_lang[lang].append((role, phrase))
    return {lang: Pack(lang, own) for lang, own in by_lang.items()}


class Symbols:
    """What the rules read of a text: symbols with their places in it, clauses, scopes, and the questions that follow them."""

    def __init__(self, text: str, compact: bool):
        self.symbols: list[str] = []
        self.places: list[tuple[int, int]] = []
        self.clauses: list[int] = []
        self.scopes: list[int] = []
        self.asked: list[bool] = []
        if compact:
            self._characters(text)
        else:
            found = tokens(text)
            for k, (word, first, last, clause, scope, *_) in enumerate(found):
                after = text[last : found[k + 1][1] if k + 1 < len(found) else len(text)]
                self._add(word, (first, last), clause, scope, _ASKS.search(after) is not None)
        self.before = [0]
        for s in self.symbols:
            self.before.append(self.before[-1] + len(s))

    def _add(self, symbol: str, place: tuple[int, int], clause: int, scope: int, asked: bool = False) -> None:
        self.symbols.append(symbol)
        self.places.append(place)
        self.clauses.append(clause)
        self.scopes.append(scope)
        self.asked.append(asked)

    def _characters(self, text: str) -> None:
        clause = scope = 0
        ended = False
        for m in _CLUSTER.finditer(text):
            for char in nfkc_text(m[0]).lower():
                if char in ENDS:
                    ended = True
                    if char in ASKS and self.asked:
                        self.asked[-1] = True
                elif char in COMMAS:
                    scope += 1
                elif not char.isspace() and char not in MARKS:
                    clause, ended = clause + (ended and bool(self.symbols)), False
                    self._add(char, m.span(), clause, scope)

    def hits(self, pack: Pack) -> dict[str, list[Span]]:
        """The places of every phrase within a clause, by role, in order."""
        out: dict[str, list[Span]] = {role: [] for role in ROLES}
        joined = "".join(self.symbols) if pack.compact else None
        count = len(self.symbols)
        for i in range(count):
            for n in pack.lengths:
                if i + n > count or self.clauses[i] != self.clauses[i + n - 1]:
                    break
                for role in pack.roles.get(joined[i : i + n] if pack.compact else tuple(self.symbols[i : i + n]), ()):
                    out[role].append(Span(i, i + n))
        return out

    def propositions(self, boundaries: list[Span]) -> list[Span]:
        """Clauses, cut at boundary phrases, which belong to no side."""
        out, begin, at = [], 0, 0
        for k in range(1, len(self.symbols) + 1):
            if k < len(self.symbols) and self.clauses[k] == self.clauses[k - 1]:
                continue
            start = begin
            while at < len(boundaries) and boundaries[at].last <= k:
                mark, at = boundaries[at], at + 1
                if mark.first > start:
                    out.append(Span(start, mark.first))
                start = max(start, mark.last)
            if start < k:
                out.append(Span(start, k))
            begin = k
        return out

    def gap(self, a: int, b: int) -> int:
        return self.before[b] - self.before[a]

    def closes_scope(self, span: Span) -> bool:
        return span.last == len(self.symbols) or self.scopes[span.last - 1] != self.scopes[span.last] or self.clauses[span.last - 1] != self.clauses[span.last]


class Event(NamedTuple):
    event: str
    points: int
    first: int
    last: int
    raw_first: int
    raw_last: int
    suppressor: str | None
    by_first: int | None
    by_last: int | None
    by_raw_first: int | None
    by_raw_last: int | None


def begun(spans: list[Span], first: int, end: int) -> list[Span]:
    """The spans that begin at `first` or later and before `end`; spans are in order, so long texts cost no more per event than short ones."""
    return spans[bisect_left(spans, (first, -1)) : bisect_left(spans, (end, -1))]


def within(spans: list[Span], whole: Span) -> list[Span]:
    return [s for s in begun(spans, whole.first, whole.last) if s.last <= whole.last]


def intent_before(line: Symbols, pack: Pack, intents: list[Span], at: int) -> Span | None:
    """The intent that ends last before `at`, if at most GAP code points lie between."""
    near = begun(intents, at - GAP - pack.lengths[-1], at)
    prior = max((i for i in near if i.last <= at), key=lambda i: (i.last, i.first), default=None)
    return prior if prior and line.gap(prior.last, at) <= GAP else None


def target_near(line: Symbols, pack: Pack, targets: list[Span], whole: Span, anchor: Span, floor: int, closing: bool = False) -> Span | None:
    """The first target after the anchor and near it, else the last one before it; characters ask more of a target that follows."""

    def counts(t: Span) -> bool:
        return not pack.compact or (line.closes_scope(t) or t.last == whole.last if closing else t.last - t.first > 1 or t.last == whole.last)

    ahead = next((t for t in begun(targets, anchor.last, anchor.last + pack.near + 1) if counts(t)), None)
    before = begun(targets, max(floor, anchor.first - pack.near - pack.lengths[-1]), anchor.first)
    return ahead or next((t for t in reversed(before) if t.last <= anchor.first and anchor.first - t.last <= pack.near), None)


def _suppressor(line: Symbols, pack: Pack, frame: Span, primary: Span, negators: list[Span], found: dict[str, list[Span]], whole: Span) -> tuple[str, Span] | None:
    """Negator in the primary's clause and scope, in the frame or closely before it; then counterspeech, then report right before it."""
    clause, scope, reach = line.clauses[primary.first], line.scopes[primary.first], pack.lengths[-1]
    for n in begun(negators, frame.first - GAP - reach, frame.last):
        inside = frame.first <= n.first and n.last <= frame.last
        close = n.last <= frame.first and line.gap(n.last, frame.first) <= GAP
        if line.clauses[n.first] == clause and line.scopes[n.first] == scope and (inside or close):
            return "negated", n
    for role, name in (("counterspeech", "counterspeech"), ("report", "reported")):
        for m in begun(found[role], frame.first - reach, frame.last + 1):
            follows = pack.compact and role == "report" and m.first == frame.last
            apart = pack.compact and not (whole.first <= m.first and m.last <= whole.last)
            if not apart and line.clauses[m.first] == clause and (m.last == frame.first or follows):
                return name, m
    return None


def analyze(text: str, pack: Pack, reply: bool = False) -> list[Event]:
    """The events of a message; `reply` says that it answers someone, who is its target where it names none."""
    line = Symbols(text, pack.compact)
    if not line.symbols:
        return []
    found = line.hits(pack)
    quotes = quote_ranges(text, RULE_QUOTES) if any(m in text for m in MARKS) else []
    out: list[Event] = []
    since = [0]

    def fire(name: str, parts: list[Span | None], primary: Span, negators: list[Span], whole: Span) -> None:
        there = [p for p in parts if p]
        frame = Span(min(p.first for p in there), max(p.last for p in there))
        raw = line.places[frame.first][0], line.places[frame.last - 1][1]
        if name == "sentiment" and any(e.raw_first < raw[1] and raw[0] < e.raw_last for e in out[since[0] :]):
            return
        by = _suppressor(line, pack, frame, primary, negators, found, whole)
        if any(a <= raw[0] and raw[1] <= b for a, b in quotes):
            by = "quoted", frame
        shown = (by[0], *by[1], line.places[by[1].first][0], line.places[by[1].last - 1][1]) if by else (None,) * 5
        out.append(Event(name, POINTS[name], *frame, *raw, *shown))

    for whole in line.propositions(found["boundary"]):
        own = {role: within(spans, whole) for role, spans in found.items() if spans}
        if not own:
            continue
        own = defaultdict(list, own)
        since[0] = len(out)
        targets = own["target"]
        for role, name in IMPLICIT.items():
            if any(h == whole for h in begun(own[role], whole.first, whole.first + 1)):
                fire(name, [whole], whole, [], whole)
        for harm in own["harm"]:
            intent = intent_before(line, pack, own["intent"], harm.first)
            target = target_near(line, pack, targets, whole, harm, intent.first if intent else whole.first, closing=True)
            ordered = harm.first == whole.first and target is not None and target.first >= harm.last and not line.asked[whole.last - 1]
            if (target or reply) and (intent or ordered):
                fire("threat", [harm, intent, target], harm, own["negator"], whole)
        for wish in own["wish"]:
            outcome = next((o for o in begun(own["outcome"], wish.last, wish.last + GAP + 1) if line.gap(wish.last, o.first) <= GAP and (not pack.compact or o.last == whole.last)), None)
            if outcome is None:
                continue
            target = target_near(line, pack, targets, whole, outcome, wish.first)
            if target or reply:
                fire("wish", [wish, outcome, target], outcome, own["negator"], whole)
        for insult in own["insult"]:
            target = target_near(line, pack, targets, whole, insult, whole.first)
            linked = target and (target.last == insult.first or any(c.last <= insult.first for c in begun(own["copula"], target.last, insult.first)))
            if linked or reply:
                fire("insult", [insult, target], insult, own["negator"], whole)
        for command in own["self_harm"]:
            if not pack.compact or line.closes_scope(command):
                fire("self_harm", [command], command, own["negator"], whole)
        for phrase in own["sentiment"]:
            target = target_near(line, pack, targets, whole, phrase, whole.first)
            if target or reply:
                fire("sentiment", [phrase, target], phrase, own["negator"], whole)
    return out


def listed_threats(text: str, pack: Pack) -> list[tuple[int, int]]:
    """Harm phrases from left to right, the longest at a place first, each skipped past; benign phrases skip too. A harm counts with a target within
    five words and an intent at most three words before it, or with the target after it."""
    line = Symbols(text, False)
    found = line.hits(pack)
    spans = sorted([(s.first, -s.last, role) for role in ("benign", "harm") for s in found[role]])
    out, past = [], 0
    for first, last, role in spans:
        last = -last
        if first < past:
            continue
        past = last
        if role == "benign":
            continue
        same = [t for t in found["target"] if line.clauses[t.first] == line.clauses[first]]
        after = any(0 <= t.first - last <= 5 for t in same)
        near = after or any(0 <= first - t.last <= 5 for t in same)
        meant = any(0 <= first - i.last <= 3 and line.clauses[i.first] == line.clauses[first] for i in found["intent"])
        if near and (meant or after):
            out.append((first, last))
    return out


HITS = "row_id long, lang string, role string, first int, last int"
PROPOSITIONS = "row_id long, first int, last int"
FRAMES = "row_id long, first int, intent int, target int"
EVENTS = "row_id long, lang string, event string, points int, first int, last int, raw_first int, raw_last int, suppressor string, by_first int, by_last int, by_raw_first int, by_raw_last int"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _applied(texts: DataFrame, rows: list[tuple[str, str, str]] | None, schema: str, each) -> DataFrame:
    """`each` (text, pack) of every (row_id, lang, text) whose language has a pack; nulls give no rows, and the pack is a small table."""
    known = texts.sparkSession.sparkContext.broadcast(packs(rows or default_pack()))
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                pack = known.value.get(lang)
                if pack and text:
                    out += [(i, *found) for found in each(text, pack)]
            columns = list(zip(*out)) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    used = texts.where("row_id is not null and lang is not null and text is not null").select("row_id", "lang", "text")
    return spread(used).mapInArrow(run, schema)


def phrase_hits(texts: DataFrame, rows=None) -> DataFrame:
    """A row per phrase of the pack at each place of (row_id, lang, text); phrases stay within a clause."""
    return _applied(texts, rows, HITS, lambda text, pack: [(pack.lang, role, *s) for role, spans in Symbols(text, pack.compact).hits(pack).items() for s in spans])


def propositions(texts: DataFrame, rows=None) -> DataFrame:
    def each(text: str, pack: Pack) -> list[Span]:
        line = Symbols(text, pack.compact)
        return line.propositions(line.hits(pack)["boundary"])

    return _applied(texts, rows, PROPOSITIONS, each)


def harm_frames(texts: DataFrame, rows=None) -> DataFrame:
    """Each harm with the nearest intent before it and its target (their first symbols), within its proposition."""

    def each(text: str, pack: Pack) -> Iterator[tuple]:
        line = Symbols(text, pack.compact)
        found = line.hits(pack)
        for whole in line.propositions(found["boundary"]):
            for harm in within(found["harm"], whole):
                intent = intent_before(line, pack, within(found["intent"], whole), harm.first)
                target = target_near(line, pack, within(found["target"], whole), whole, harm, intent.first if intent else whole.first, closing=True)
                yield harm.first, intent and intent.first, target and target.first

    return _applied(texts, rows, FRAMES, each)


def events(texts: DataFrame, rows=None, reply: bool = False) -> DataFrame:
    """A row per event of (row_id, lang, text) with its points, its symbols and characters, and what suppresses it and where (null if nothing does)."""
    return _applied(texts, rows, EVENTS, lambda text, pack: [(pack.lang, *e) for e in analyze(text, pack, reply)])


def scored(found: DataFrame) -> DataFrame:
    """row_id, rule (the most points of an event that nothing suppresses), capped (whether an event is suppressed)."""
    live = F.when(F.col("suppressor").isNull(), F.col("points")).otherwise(0)
    return found.groupBy("row_id").agg(F.max(live).alias("rule"), F.bool_or(F.col("suppressor").isNotNull()).alias("capped"))


def evidence_ranges(found: DataFrame) -> DataFrame:
    """row_id, first, last (characters) of the evidence: an event's own range, or that of what suppresses it."""
    return found.select("row_id", F.coalesce("by_raw_first", "raw_first").alias("first"), F.coalesce("by_raw_last", "raw_last").alias("last")).distinct()
