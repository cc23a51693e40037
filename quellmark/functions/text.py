"""Text scalars: normal forms, views and escapes, as column expressions where the JVM has what they need."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters, digits and marks make words.
WORD = r"[\p{L}\p{N}\p{M}]+"
#: Characters that end a clause, and those that end a scope as well.
CLAUSE_END = ".!?;:。！？；：؟؛।॥\r\n"
SCOPE_END = ",，،、"
#: Digits that stand for letters in disguised words.
LEET = ("013457", "oieast")
#: What Arabic text loses before it is compared (tatweel, signs), and alef forms that become bare.
ARABIC_DROPPED = r"[ـؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ]"
ALEF = ("أإآٱ", "اااا")


def nfkc_text(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(nfkc_text, na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition, which the JVM lacks; ASCII text passes through."""
    return F.pandas_udf(_nfkc, StringType())(text)


def normalize_generic(text: Column) -> Column:
    return F.lower(nfkc(text))


def normalize_turkish(text: Column) -> Column:
    """Dotted and dotless i keep apart: I becomes ı and İ becomes i before lower-casing."""
    return F.lower(F.translate(nfkc(text), "Iİ", "ıi"))


def normalize_arabic(text: Column) -> Column:
    """Signs and tatweel dropped, alef forms made bare; no lower-casing."""
    return F.translate(F.regexp_replace(nfkc(text), ARABIC_DROPPED, ""), *ALEF)


def hindi_words(text: Column) -> Column:
    """Words, with joiners (U+200C, U+200D) inside them where both neighbours are Devanagari word characters."""
    devanagari = r"[\p{IsDevanagari}&&[\p{L}\p{N}\p{M}]]"
    return F.regexp_extract_all(text, F.lit(rf"((?:[\p{{L}}\p{{N}}\p{{M}}]|(?<={devanagari})[\x{{200C}}\x{{200D}}](?={devanagari}))+)"), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def escape(text: Column) -> Column:
    """Backslash, tab, line feed and carriage return written as two characters each."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape in one pass; an unknown escape and a trailing backslash stay as they are."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def unleet(token: Column) -> Column:
    """A token of letters and digits with its digits read as letters; other tokens as they are."""
    mixed = token.rlike(r"\p{L}") & token.rlike("[0-9]")
    return F.when(mixed, F.translate(token, *LEET)).otherwise(token)


def clause_parts(text: Column) -> Column:
    return F.split(text, f"[{CLAUSE_END}]", -1)


_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_LATIN = regex.compile(r"[\p{Latin}\p{M}\p{N}]+")


def tokens_text(text: str | None) -> str | None:
    """The words of a text, lower-case and parted by one space; words of Latin letters lose their accents."""
    if text is None:
        return None
    out = []
    for word in _TOKEN.findall(nfkc_text(text).lower()):
        if not word.isascii() and _LATIN.fullmatch(word):
            word = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
        out.append(word)
    return " ".join(out)


def _normalize_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(tokens_text, na_action="ignore")


def normalize_text(text: Column) -> Column:
    return F.pandas_udf(_normalize_text, StringType())(text)


def fnv64(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for byte in data:
        state = ((state ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return state


def fnv64_all(blobs: list[bytes]) -> np.ndarray:
    """The hashes of many byte strings, a byte of all of them at a time; the last few long ones are finished one by one."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    order = np.argsort(-lengths, kind="stable")
    data, begin = np.frombuffer(b"".join(blobs), np.uint8), (np.cumsum(lengths) - lengths)[order]
    state = np.full(len(blobs), 0xCBF29CE484222325, np.uint64)
    steps = int(lengths.max(initial=0))
    live = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
    done = 0
    while done < steps and live[done] >= 16:
        n = live[done]
        state[:n] = (state[:n] ^ data[begin[:n] + done]) * np.uint64(0x100000001B3)
        done += 1
    if done < steps:
        for k in range(live[done]):
            state[k] = fnv64(blobs[order[k]][done:], int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _group_hash(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in keys:
        known = series.dropna()
        found = [f"{h:016x}" for h in fnv64_all([k.encode() for k in known]).tolist()]
        yield pd.Series(found, known.index, dtype=object).reindex(series.index)


def group_hash(language: Column, normalized: Column) -> Column:
    """The 64-bit FNV-1a of language, a zero byte and the normalized text, as 16 hexadecimal digits."""
    return F.pandas_udf(_group_hash, StringType())(F.concat(language, F.lit("\0"), normalized))


def hash_bucket(digits: Column) -> Column:
    """A group hash modulo 100; 2**32 leaves 96."""
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return (high % 100 * 96 + low % 100) % 100
