"""Tokens of a message with their place, clause, scope and mention mark, and quoted stretches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quellmark.functions.text import CLAUSE_END, SCOPE_END

_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_CLAUSE = re.compile(f"[{re.escape(CLAUSE_END)}]")
_SCOPE = re.compile(f"[{re.escape(CLAUSE_END + SCOPE_END)}]")
#: Opening and closing quotes of token marks; rules read guillemets either way round, and corner brackets too.
QUOTES = (('"', '"'), ("„", "“"), ("“", "”"), ("«", "»"))
RULE_QUOTES = (*QUOTES, ("»", "«"), ("「", "」"), ("『", "』"))

SCHEMA = "row_id long, pos int, token string, first int, last int, clause int, scope int, mention boolean, quoted boolean"


def quote_ranges(text: str, pairs: tuple[tuple[str, str], ...] = QUOTES) -> list[tuple[int, int]]:
    """(begin, end) of every stretch between the marks of a pair, marks included, in order of their ends.

    Pairs don't see each other, so quotes nest; a later opening mark replaces an earlier one; a mark that closes one pair opens no
    other; an open quote quotes nothing.
    """
    opened: dict[str, int] = {}  # by the mark that closes it
    out = []
    for at, mark in enumerate(text):
        if mark in opened:
            out.append((opened.pop(mark), at + 1))
            continue
        for first, last in pairs:
            # marks that pair either way round keep their first opening
            if mark == first and not (last in opened and (last, first) in pairs):
                opened[last] = at
    return out


def tokens(text: str) -> list[tuple]:
    """(token, first, end, clause, scope, mention, quoted); offsets in code points; clauses and scopes count from 0."""
    out, clause, scope, last = [], 0, 0, 0
    quotes = quote_ranges(text) if any(a in text for a, _ in QUOTES) else []
    for m in _TOKEN.finditer(text):
        gap = text[last : m.start()]
        if last:
            clause += _CLAUSE.search(gap) is not None
            scope += _SCOPE.search(gap) is not None
        last = m.end()
        quoted = any(a <= m.start() and m.end() <= b for a, b in quotes)
        out.append((m.group().lower(), m.start(), m.end(), clause, scope, gap.endswith("@"), quoted))
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row_id", "pos", "token", "first", "last", "clause", "scope", "mention", "quoted"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    for batch in batches:
        rows = [(i, k, *t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for k, t in enumerate(tokens(text))]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def context_tokens(texts: DataFrame) -> DataFrame:
    """A row per token of (row_id, text): a narrow step; null and empty texts give no rows."""
    return texts.select("row_id", "text").mapInArrow(_tokens, SCHEMA)


def _quotes(pairs: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for a, b in quote_ranges(text, pairs)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["row_id", "first", "last"])

    return run


def quoted_spans(texts: DataFrame, pairs: tuple[tuple[str, str], ...] = QUOTES) -> DataFrame:
    """row_id, first, last of the quoted stretches of (row_id, text); null texts have none."""
    return texts.select("row_id", "text").mapInArrow(_quotes(pairs), "row_id long, first int, last int")
