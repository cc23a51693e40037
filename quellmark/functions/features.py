"""Hashed word and character n-gram features: 16-bit FNV-1a bins, one set per text.

The lowest 16 bits of FNV-1a depend only on the lowest 16 bits of its state and prime, so all arithmetic stays within
them. Texts travel in Arrow batches; the distinct tokens of a batch are hashed side by side, a byte of all windows at a
time, and each text gathers the bins of its tokens. The functions of a single text say the same in plain Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quellmark.functions.text import CLAUSE_END, nfkc_text
from quellmark.runtime import spread

#: The low 16 bits of the 64-bit FNV offset and prime, and the number of bins.
OFFSET, PRIME, BINS = 8997, 435, 65_536
START, END = "\x02", "\x03"

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_CLAUSE = re.compile(f"[{re.escape(CLAUSE_END)}]")
_BREAK = regex.compile(r"[\p{P}\p{S}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]+")
_SPACE = re.compile(r"\s+")
_HAN, _LATIN = regex.compile(r"\p{Han}+"), regex.compile(r"\p{Latin}+")


def fnv16(data: bytes, state: int = OFFSET) -> int:
    for byte in data:
        state = ((state ^ byte) * PRIME) & 0xFFFF
    return state


@lru_cache(200_000)
def word_bin(*parts: str) -> int:
    """The bin of one word or of two neighbours."""
    return fnv16(b"W" + bytes([len(parts)]) + b"".join(b"\0" + p.encode() for p in parts))


@lru_cache(200_000)
def gram_bin(gram: str, namespace: bytes = b"C") -> int:
    return fnv16(namespace + bytes([len(gram)]) + gram.encode())


def grams(token: str, low: int, high: int) -> list[str]:
    """Windows of low to high characters of the token between its marks; none of an empty token."""
    marked = f"{START}{token}{END}"
    return [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)] if token else []


@lru_cache(100_000)
def char_bins(token: str, low: int, high: int) -> frozenset[int]:
    return frozenset(map(gram_bin, grams(token, low, high)))


@lru_cache(100_000)
def script_bins(token: str) -> frozenset[int]:
    """Bins of 1 to 5 characters under a namespace by script; single characters only if Han."""
    out = set()
    for gram in grams(token, 1, 5):
        plain = gram.strip(START + END)
        space = b"H" if plain and _HAN.fullmatch(plain) else b"L" if plain and _LATIN.fullmatch(plain) else b"C"
        if len(gram) > 1 or space == b"H":
            out.add(gram_bin(gram, space))
    return frozenset(out)


def clauses(text: str) -> list[list[str]]:
    """The words of each clause."""
    return [_WORD.findall(part) for part in _CLAUSE.split(text)]


def words(text: str | None) -> list[str]:
    """The words of a text as it came, in normal form."""
    return _WORD.findall(nfkc_text(text).lower()) if text else []


def segments(text: str) -> list[str]:
    """Stretches between punctuation, symbols and control characters, white space taken out."""
    return [s for s in (_SPACE.sub("", part) for part in _BREAK.split(text)) if s]


def word_char_bins(text: str) -> set[int]:
    """Words, pairs of neighbours within a clause, and 3 to 5 characters within words."""
    out: set[int] = set()
    for ws in clauses(text):
        for w in ws:
            out.add(word_bin(w))
            out |= char_bins(w, 3, 5)
        out.update(map(word_bin, ws, ws[1:]))
    return out


def spanish_bins(text: str) -> set[int]:
    """As word_char_bins, but pairs run over clauses."""
    ws = _WORD.findall(text)
    out = {word_bin(w) for w in ws} | set(map(word_bin, ws, ws[1:]))
    return out.union(*(char_bins(w, 3, 5) for w in ws))


def turkish_bins(text: str) -> set[int]:
    return set().union(*(char_bins(w, 3, 5) for w in _WORD.findall(text)))


def char25_bins(text: str) -> set[int]:
    return set().union(*(char_bins(s, 2, 5) for s in segments(text)))


def korean_bins(text: str) -> set[int]:
    return char25_bins(text) | {word_bin(w) for w in _WORD.findall(text)}


def chinese_bins(text: str) -> set[int]:
    return set().union(*(script_bins(s) for s in segments(text)))


PROFILES = {
    "word_char_35": word_char_bins,
    "spanish": spanish_bins,
    "turkish": turkish_bins,
    "char_25": char25_bins,
    "korean": korean_bins,
    "chinese": chinese_bins,
}


class Shape(NamedTuple):
    """What a profile hashes: the units of a text, windows of low to high characters in them, words, and pairs of neighbours (within clauses)."""

    segments: bool
    low: int
    high: int
    words: bool
    pairs: bool
    clauses: bool


SHAPES = {
    "word_char_35": Shape(False, 3, 5, True, True, True),
    "spanish": Shape(False, 3, 5, True, True, False),
    "turkish": Shape(False, 3, 5, False, False, False),
    "char_25": Shape(True, 2, 5, False, False, False),
    "korean": Shape(True, 2, 5, True, False, False),
}
#: Characters of texts that are hashed side by side.
BLOCK = 1_000_000


class Tokens:
    """The bytes of distinct tokens, one after another."""

    def __init__(self, tokens: list[str], marked: bool):
        parts = [f"{START}{t}{END}" for t in tokens] if marked else tokens
        self.data = np.frombuffer("".join(parts).encode(), np.uint8)
        self.chars = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.at = np.append(heads, len(self.data))
        self.owner = np.repeat(np.arange(len(parts)), self.chars)
        ends = np.cumsum(self.chars)
        self.first, self.last = self.at[ends - self.chars], self.at[ends]

    def hashed(self, state: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The states after the bytes from `first` to `last` of each."""
        state = state.astype(np.uint32)
        order = np.argsort(first - last, kind="stable")  # the longest first
        lengths = (last - first)[order]
        begin, out = first[order], state[order]
        steps = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")
        for j in range(steps):
            n = live[j]
            out[:n] = ((out[:n] ^ self.data[begin[:n] + j]) * PRIME) & 0xFFFF
        state[order] = out
        return state

    def windows(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, bin) of all windows of low to high characters."""
        owners, bins = [], []
        for n in range(low, high + 1):
            k = np.arange(max(0, len(self.owner) - n + 1))
            k = k[self.owner[k] == self.owner[k + n - 1]]
            head = fnv16(b"C" + bytes([n]))
            owners.append(self.owner[k])
            bins.append(self.hashed(np.full(len(k), head, np.uint32), self.at[k], self.at[k + n]))
        return np.concatenate(owners), np.concatenate(bins)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort (hashing, as np.unique does it, is many times slower here)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _pairs_of(text: np.ndarray, unit: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, next token) of neighbours in a unit."""
    same = np.flatnonzero((text[1:] == text[:-1]) & (unit[1:] == unit[:-1]))
    return text[same], code[same], code[same + 1]


def hashed_sets(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(number of bins of each text, all bins): the sets of PROFILES, ascending, for texts in normal form."""
    keys: list[np.ndarray] = []
    count = len(texts)

    def gather(units: list[list[list[str]]], windows: bool, words: bool) -> None:
        """Units are lists of tokens per clause per text."""
        lengths = np.array([sum(map(len, u)) for u in units], np.int64)
        flat = [t for u in units for part in u for t in part]
        if not flat:
            return
        text = np.repeat(np.arange(count), lengths)
        code, unique = pd.factorize(np.array(flat, dtype=object))
        unique = list(unique)
        owners, bins = [], []
        if windows:
            owner, found = Tokens(unique, True).windows(shape.low, shape.high)
            owners.append(owner), bins.append(found)
        if words or shape.pairs:
            plain = Tokens(unique, False)
        if words:
            own = plain.hashed(np.full(len(unique), fnv16(b"W\x01\0"), np.uint32), plain.first, plain.last)
            owners.append(np.arange(len(unique))), bins.append(own)
        # a token's bins once per text that has it
        owner, found = np.concatenate(owners), np.concatenate(bins)
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
        begin = np.searchsorted(owner, np.arange(len(unique) + 1))
        held = distinct(text << 32 | code)
        who, what = held >> 32, held & 0xFFFFFFFF
        size = (begin[1:] - begin[:-1])[what]
        spread_ = np.repeat(begin[what] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys.append(np.repeat(who, size) << 16 | found[spread_])
        if shape.pairs and words:
            part = np.repeat(np.arange(sum(map(len, units))), [len(p) for u in units for p in u]) if shape.clauses else text
            who, left, right = _pairs_of(text, part, code)
            both, index = np.unique(left << 32 | right, return_inverse=True)
            left, right = both >> 32, both & 0xFFFFFFFF
            state = plain.hashed(np.full(len(unique), fnv16(b"W\x02\0"), np.uint32), plain.first, plain.last)[left]
            state = plain.hashed((state * PRIME) & 0xFFFF, plain.first[right], plain.last[right])
            keys.append(who << 16 | state[index])

    if shape.segments:
        gather([[segments(t)] for t in texts], True, False)
        if shape.words:
            gather([[_WORD.findall(t)] for t in texts], False, True)
    else:
        gather([clauses(t) if shape.clauses else [_WORD.findall(t)] for t in texts], True, shape.words)
    found = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return np.bincount(found >> 16, minlength=count), (found & 0xFFFF).astype(np.int32)


class Parts(NamedTuple):
    """The words of some texts: text and code of each in order; of each code its bins (repeated ones too) and the same as stems.

    A stem is the windows that begin at one character, shared by all words that have them; stems count from BINS on, so that a word's own bin
    can stand beside them. Those of most windows come first: `stem_bins` are the first windows of all stems, the second ones of those that have
    two, and the third ones. Pairs are the bins of neighbours in a clause, in the order of the texts.
    """

    text: np.ndarray
    code: np.ndarray
    sizes: np.ndarray
    bins: np.ndarray
    sizes_in_stems: np.ndarray
    stems: np.ndarray
    stem_sizes: np.ndarray
    stem_bins: np.ndarray
    pair_text: np.ndarray
    pair_bins: np.ndarray


def each(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the stretches that begin at `starts`, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def word_parts(texts: list[str]) -> Parts:
    """What `word_char_35` hashes, for texts in normal form: words, neighbours, and 3 to 5 characters within words."""
    whole = "".join(t + "\n" for t in texts)  # the end of a text ends its clause
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
    chars = [chr(p) for p in seen]
    kinds = np.zeros((2, int(seen[-1]) + 1 if len(seen) else 1), bool)
    kinds[:, seen] = [[bool(_WORD.fullmatch(c)) for c in chars], [c in CLAUSE_END for c in chars]]
    inside = np.concatenate([[False], kinds[0][points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first = edges[::2]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    clause = np.cumsum(kinds[1][points])[first] if len(first) else first
    if not len(first):
        none = np.zeros(0, np.int64)
        return Parts(*[none] * len(Parts._fields))
    code, unique = pd.factorize(np.array(np.where(inside[1:-1], points, ord(" ")).astype("<u4").tobytes().decode("utf-32-le").split(), dtype=object))
    unique = list(unique)
    plain = Tokens(unique, False)
    own = plain.hashed(np.full(len(unique), fnv16(b"W\x01\0"), np.uint32), plain.first, plain.last)

    marked = Tokens(unique, True)
    begin = np.cumsum(marked.chars) - marked.chars
    at = each(begin, marked.chars - 2)  # where a window of three characters begins
    room = np.minimum(marked.chars[marked.owner[at]] - (at - begin[marked.owner[at]]), 5)
    ranks = np.zeros(int(seen[-1]) + 4, np.int64)
    ranks[seen] = np.arange(1, len(seen) + 1)
    letters = np.frombuffer("".join(f"{START}{t}{END}" for t in unique).encode("utf-32-le"), np.uint32)
    ranks[[ord(START), ord(END)]] = len(seen) + np.array([1, 2])
    ranked, bits = np.concatenate([ranks[letters], np.zeros(4, np.int64)]), int(len(seen) + 2).bit_length()
    if 5 * bits <= 63:
        key = np.zeros(len(at), np.int64)
        for j in range(5):
            key = key << bits | np.where(j < room, ranked[at + j], 0)
        stem, _ = pd.factorize(key)
    else:  # too many letters to tell windows by a number
        stem = np.arange(len(at))
    one = np.empty(stem.max() + 1, np.int64)
    one[stem] = np.arange(len(at))
    order = np.argsort(-room[one], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    stem, where = rank[stem], at[one[order]]
    stem_sizes = room[one[order]] - 2
    columns = []
    for n in (3, 4, 5):
        k = where[: np.count_nonzero(stem_sizes >= n - 2)]
        columns.append(marked.hashed(np.full(len(k), fnv16(b"C" + bytes([n])), np.uint32), marked.at[k], marked.at[k + n]))

    in_stems = marked.chars - 1  # its stems, and its own bin
    stems = np.empty(in_stems.sum(), np.int64)
    ends = np.cumsum(in_stems) - 1
    other = np.ones(len(stems), bool)
    other[ends] = False
    stems[other], stems[ends] = BINS + stem, own
    sizes = np.ones(len(stems), np.int64)
    sizes[other] = stem_sizes[stem]
    bins = np.empty(sizes.sum(), np.uint32)
    spread_ = np.cumsum(sizes) - sizes
    bins[spread_[ends]] = own
    for j, column in enumerate(columns):
        has = stem < len(column)
        bins[spread_[other][has] + j] = column[stem[has]]
    who, left, right = _pairs_of(text, clause, code)
    index, both = pd.factorize(left << 32 | right)
    left, right = both >> 32, both & 0xFFFFFFFF
    state = plain.hashed(np.full(len(unique), fnv16(b"W\x02\0"), np.uint32), plain.first, plain.last)[left]
    state = plain.hashed((state * PRIME) & 0xFFFF, plain.first[right], plain.last[right])
    return Parts(text, code, np.add.reduceat(sizes, ends - in_stems + 1), bins, in_stems, stems, stem_sizes, np.concatenate(columns), who, state[index].astype(np.int64))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _bins(profile: str):
    make, shape = PROFILES[profile], SHAPES.get(profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [nfkc_text(t).lower() if t else "" for t in batch.column(1).to_pylist()]
            if shape:
                parts = [hashed_sets(block, shape) for block in _blocks(plain)]
                sizes = np.concatenate([n for n, _ in parts]) if parts else np.zeros(0, np.int64)
                values = np.concatenate([v for _, v in parts]) if parts else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            else:
                found = pa.array([sorted(make(t)) for t in plain], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], ["row_id", "bins", *batch.schema.names[2:]])

    return run


def with_bins(texts: DataFrame, profile: str = "word_char_35", carry: tuple[str, ...] = ()) -> DataFrame:
    """row_id, bins (ascending) of each (row_id, text), and the columns to carry along; a null or empty text has none."""
    used = texts.select("row_id", "text", *carry)
    return spread(used).mapInArrow(_bins(profile), ", ".join(["row_id long, bins array<int>", *(f"`{c}` {dict(used.dtypes)[c]}" for c in carry)]))


def bin_array(bins: np.ndarray) -> np.ndarray:
    """The bins as a presence vector."""
    out = np.zeros(BINS, bool)
    out[bins] = True
    return out
