"""Problem 6: one consistent form for text that looks the same but is written with different characters.

The mapping is compiled once: rules (widths, spaces, invisible characters) and the table of look-alikes are expanded
to one output per character, checked for conflicts (no output may itself be mapped, no character may have two outputs),
and applied in a single pass over the grapheme clusters that hold anything mapped, the longest match first. A base
letter with combining marks is one cluster and becomes its composed form, after its base is mapped.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.runtime import Workspace, table

#: Letters that look like the Latin letters under them.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХԌԚԜҮ": "ABESIJKMHOPCTYXGQWY",
    "аеѕіјорсухһԁԛԝґүӏ": "aesijopcyxhdqwryl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονϲϳ": "ovcj",
    "ɑɡıоԍ": "agıoG",
    "ՍՏՕԼհոսօցզյ": "USOLhnuogqj",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHYGZ4RWVSLCPKB",
    "‐‑‒": "---",
    "’‘": "''",
}

#: Code points that the rules below look at: no other holds spaces, widths or invisible characters.
BLOCKS = ((0x80, 0x3400), (0xF900, 0x14000), (0x1BC00, 0x1BD00), (0x1D100, 0x1D200), (0x1D400, 0x1D800), (0xE0000, 0xE0100))


def _characters() -> dict[str, str]:
    out: dict[str, str] = {}

    def put(char: str, form: str) -> None:
        if out.setdefault(char, form) != form:
            raise ValueError(f"two forms of {char!r}")

    for row, forms in LOOKALIKES.items():
        for char, form in zip(row, forms, strict=True):
            if char != form:
                put(char, form)
    looks = str.maketrans(out)
    for point in chain(*(range(*r) for r in BLOCKS)):
        char = chr(point)
        kind, how = unicodedata.category(char), unicodedata.decomposition(char).partition(" ")[0]
        if kind == "Zs":
            put(char, " ")
        elif kind == "Cf" and not 0x600 <= point < 0x900:  # invisible, but for the signs of Arabic script
            put(char, "")
        elif 0xFB00 <= point <= 0xFB06 or how in ("<wide>", "<narrow>", "<font>"):
            # letters of another style or width; what they stand for may itself be a look-alike
            put(char, unicodedata.normalize("NFKC", char).translate(looks))
    for form in out.values():
        if any(c in out for c in form):
            raise ValueError(f"{form!r} is mapped again")
    return out


def _class(chars: str) -> str:
    """The inside of a character class, in ranges: beyond the basic plane single characters would be tried one by one."""
    out, points = [], sorted({ord(c) for c in chars})
    for k, p in enumerate(points):
        if k and p == points[k - 1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Transducer:
    """Applies a one-pass mapping of characters and clusters; text without anything mapped is returned as it is."""

    def __init__(self, characters: dict[str, str]):
        self.table = str.maketrans(characters)
        self.forms: dict[str, str] = {}
        marks = "".join(c for c in map(chr, chain(*(range(*r) for r in BLOCKS))) if unicodedata.combining(c))
        # letters with marks of their own may hold a mapped base
        composed = [
            c for c in map(chr, range(0xC0, 0x2000))
            if "<" not in (d := unicodedata.decomposition(c)) and d and any(x in characters for x in unicodedata.normalize("NFD", c))
        ]
        singles = _class("".join([*characters, *composed]))
        hidden = _class("".join(c for c, f in characters.items() if not f))
        marks = _class(marks)
        # a base letter and its marks, with what is invisible between them, before runs of mapped characters
        self.clusters = re.compile(f"[^{marks}][{hidden}]*[{marks}][{marks}{hidden}]*|[{singles}]+(?![{marks}])|[{singles}]")
        # the same language where no mark occurs
        self.marked, self.runs = re.compile(f"[{marks}]"), re.compile(f"[{singles}]+")

    def _form(self, cluster: re.Match) -> str:
        text = cluster.group()
        form = self.forms.get(text)
        if form is None:
            form = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.table))
            if len(self.forms) < 100_000:
                self.forms[text] = form
        return form

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        return (self.clusters if self.marked.search(text) else self.runs).sub(self._form, text)


@cache
def transducer() -> Transducer:
    return Transducer(_characters())


def one_form(text: str | None) -> str | None:
    """The consistent form of a text: equal for all texts that look the same; letter case and visible accents stay."""
    return None if text is None else transducer()(text)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, digest of the form, digest of the text, whether they differ)."""
    form = transducer()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        shown = [form(t) for t in texts]
        own = [_digest(t) for t in texts]
        looks = [o if s is t or s == t else _digest(s) for o, s, t in zip(own, shown, texts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(looks, pa.binary()), pa.array(own, pa.binary())], ["key", "looks", "own"]
        )


def lookalike_pairs(keyed: DataFrame) -> DataFrame:
    """a, b: pairs of keys (a long) whose texts look the same but aren't the same characters, a < b.

    Only digests travel: texts are grouped by what they look like, and groups of a single spelling, however many
    copies it has, are dropped by an aggregate with map-side combining before any pair is formed. Null keys and texts
    take no part; empty texts look like texts of nothing but invisible characters.
    """
    work = Workspace(keyed.sparkSession, "p6")
    rows = work.keep(keyed.where("key is not null and text is not null").select("key", "text").mapInArrow(_forms, "key long, looks binary, own binary"))
    spellings = rows.groupBy("looks").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    mixed = work.keep(rows.join(spellings.where("first <> last").select("looks"), "looks", "left_semi"))
    # different spellings meet first, their copies join afterwards
    kinds = mixed.select("looks", "own").distinct()
    other = kinds.select("looks", F.col("own").alias("own2"))
    pairs = kinds.join(other, "looks").where("own < own2").select("own", "own2")
    left, right = mixed.select(F.col("key").alias("x"), "own"), mixed.select(F.col("key").alias("y"), F.col("own").alias("own2"))
    return pairs.join(left, "own").join(right, "own2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _two_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to the key, the text and its form without letter case."""
    form = transducer()
    for batch in batches:
        shown = [form(t).casefold() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string())], ["key", "text", "shown"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "corpus_rows").select(F.col("row_id").alias("key"), "text")
    corpus = lookalike_pairs(rows).select(F.lit("corpus_rows").alias("field"), F.col("a").cast("string").alias("key_a"), F.col("b").cast("string").alias("key_b"))

    def shown(df: DataFrame, key: str, text: str) -> DataFrame:
        used = df.where(f"{key} is not null and {text} is not null").select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        return used.mapInArrow(_two_forms, "key string, text string, shown string")

    lexicon = table(spark, sf_dir, "lexicon_de")
    lemmas = shown(lexicon, "id", "lemma").select(F.col("key").alias("key_b"), F.col("text").alias("lemma"), "shown")
    matches = shown(table(spark, sf_dir, "lexicon_matches"), "match_id", "matched_text")
    disguised = matches.join(lemmas, "shown").where(F.lower("text") != F.lower("lemma"))
    disguised = disguised.select(F.lit("lexicon_matches").alias("field"), F.col("key").alias("key_a"), "key_b")
    own = lexicon.where("id is not null and lemma is not null").select("id", "lemma")
    exact = own.mapInArrow(_exact_forms, "id string, lemma string, shown string")
    twin = exact.select(F.col("id").alias("key_b"), F.col("lemma").alias("other"), "shown")
    entries = exact.join(twin, "shown").where("id < key_b and lemma <> other")
    entries = entries.select(F.lit("lexicon_de").alias("field"), F.col("id").alias("key_a"), "key_b")
    return corpus.union(entries).union(disguised)


def _exact_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form = transducer()
    for batch in batches:
        shown = [form(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], ["id", "lemma", "shown"])


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every corpus text, and whether the text differs from it."""
    rows = table(spark, sf_dir, "corpus_rows").where("text is not null").select("row_id", "text")
    return rows.mapInArrow(_written, "row_id long, form string, changed boolean")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form = transducer()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        shown = [form(t) for t in texts]
        changed = pa.array([s != t for s, t in zip(shown, texts)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string()), changed], ["row_id", "form", "changed"])


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}


def _form_sql(x: str) -> str:
    """The consistent form in SQL: the same characters, replaced one by one between two compositions."""
    form = transducer()
    table_ = {c: f for c, f in _characters().items() if len(f) == 1}
    table_ |= {c: form(c) for c in map(chr, range(0xC0, 0x2000)) if c not in table_ and len(form(c)) == 1 and form(c) != c}
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    hidden = "".join(c for c, f in _characters().items() if not f)
    plain = f"translate(nfc_normalize(translate({x}, {quote(hidden)}, '')), {quote(''.join(table_))}, {quote(''.join(table_.values()))})"
    for char, out in _characters().items():
        if len(out) > 1:
            plain = f"replace({plain}, {quote(char)}, {quote(out)})"
    return f"nfc_normalize({plain})"


SQL = {
    "p6_found": f"""with r as materialized (select row_id as k, text, {_form_sql("text")} as f from corpus_rows), l as materialized (select id, lemma, {_form_sql("lemma")} as f from lexicon_de),
    m as (select match_id, matched_text, {_form_sql("matched_text")} as f from lexicon_matches)
    select 'corpus_rows' as field, a.k::varchar as key_a, b.k::varchar as key_b from r a join r b on a.f = b.f and a.k < b.k and a.text <> b.text
    union all select 'lexicon_de', a.id, b.id from l a join l b on a.f = b.f and a.id < b.id and a.lemma <> b.lemma
    union all select 'lexicon_matches', match_id::varchar, id from m join l on lower(m.f) = lower(l.f) and lower(matched_text) <> lower(lemma)""",
}
