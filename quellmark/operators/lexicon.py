"""Lemmas in three views of a text: its words, its words with look-alike characters folded, and its words with evasions undone.

Texts are scanned in the partition that reads them, against a lexicon small enough to broadcast; only matches leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellmark.functions.text import LEET, nfkc_text

VIEWS = ("Normalized", "Confusable", "Evasion")
#: Letters of other scripts, and the Latin ones they look like; capitals are folded before case is removed.
FOLDED = str.maketrans(
    "АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝґүӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳɑɡıоԍ", "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwrylABEZHIKMNOPTYXovcjagiog"
)
_WORD, _LOOSE = regex.compile(r"[\p{L}\p{N}\p{M}]+"), regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}]+")
_UNSEEN, _FOLDABLE = regex.compile(r"\p{Cf}+"), regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}]")
_LETTER, _DIGIT, _DIGITS = regex.compile(r"\p{L}"), re.compile("[0-9]"), str.maketrans(*LEET)


@lru_cache(200_000)
def plain(word: str) -> str:
    return nfkc_text(word).lower()


@lru_cache(200_000)
def folded(word: str) -> str:
    """Without characters that can't be seen, look-alikes as Latin letters."""
    word = nfkc_text(_UNSEEN.sub("", word))
    return (word.translate(FOLDED) if _FOLDABLE.search(word) else word).lower()


Words = list[tuple[str, int, int]]


def undone(normal: Words) -> Words:
    """The words with three or more single characters in a row joined, and digits among letters read as letters."""
    out, k = [], 0
    while k < len(normal):
        end = k
        while end < len(normal) and len(normal[end][0]) == 1:
            end += 1
        if end - k >= 3:
            out.append(("".join(w for w, *_ in normal[k:end]), normal[k][1], normal[end - 1][2]))
            k = end
            continue
        for word, first, last in normal[k : max(end, k + 1)]:
            mixed = _DIGIT.search(word) and _LETTER.search(word)
            out.append((word.translate(_DIGITS) if mixed else word, first, last))
        k = max(end, k + 1)
    return out


def views(text: str) -> list[Words | None]:
    """(word, first, last) of each view, in code points of the text; None for a view that holds no more than the first."""
    normal = [(plain(m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]
    loose = normal  # ASCII has nothing to fold, but a lemma may have
    if not text.isascii():
        loose = [w for w in ((folded(m[0]), m.start(), m.end()) for m in _LOOSE.finditer(text)) if w[0]]
    disguised = _DIGIT.search(text) or sum(len(w) == 1 for w, *_ in normal) >= 3
    return [normal, loose, undone(normal) if disguised else None]


#: Lemmas by their first word: the words of each, and the ids of its entries.
Lemmas = dict[str, list[tuple[tuple[str, ...], list[str]]]]


def matches(text: str, lexicons: list[Lemmas]) -> list[tuple[str, str, int, int]]:
    """(id, view, first, last), once per entry and place, by the first view that has it."""
    seen: dict[tuple[str, int, int], str] = {}
    for view, words, lexicon in zip(VIEWS, views(text), lexicons):
        for k, (word, first, _) in enumerate(words or ()):
            for lemma, entries in lexicon.get(word, ()):
                if len(lemma) == 1 or tuple(w for w, *_ in words[k : k + len(lemma)]) == lemma:
                    for entry in entries:
                        seen.setdefault((entry, first, words[k + len(lemma) - 1][2]), view)
    return [(entry, view, first, last) for (entry, first, last), view in seen.items()]


def lookups(entries: list[tuple[str, str]]) -> list[Lemmas]:
    """The lemmas of (id, lemma) as each view spells them."""
    out = []
    for fold, word in zip((plain, folded, plain), (_WORD, _LOOSE, _WORD)):
        by_words: dict[tuple[str, ...], list[str]] = {}
        for entry, lemma in entries:
            if key := tuple(w for w in map(fold, word.findall(lemma)) if w):
                by_words.setdefault(key, []).append(entry)
        own: Lemmas = {}
        for key, ids in by_words.items():
            own.setdefault(key[0], []).append((key, ids))
        out.append(own)
    return out


def view_matches(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """row_id, id, view, first, last: lemmas of (id, lemma) in (row_id, text). Nulls are left out; the lexicon is a small table."""
    used = lexicon.where("id is not null and lemma is not null").select("id", "lemma").distinct()
    tables = lookups([(r["id"], r["lemma"]) for r in used.collect()])
    spread = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matches(t, spread.value)]
            columns = list(zip(*found)) if found else [[]] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row_id", "id", "view", "first", "last"])

    used = texts.where(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select("row_id", "text")
    return used.mapInArrow(run, "row_id long, id string, view string, first int, last int")


def folded_words(texts: DataFrame) -> DataFrame:
    """row_id, view: the words of (row_id, text) in the confusable view; null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(w for w in map(folded, _LOOSE.findall(t)) if w) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row_id", "view"])

    return texts.where(F.col("text").isNotNull()).select("row_id", "text").mapInArrow(run, "row_id long, view string")
