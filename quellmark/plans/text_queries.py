"""Text scalars, views, spans and the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from quellmark.functions import text as X
from quellmark.operators.context import RULE_QUOTES, context_tokens, quoted_spans
from quellmark.operators.lexicon import FOLDED, folded_words, view_matches
from quellmark.operators.ordering import running
from quellmark.plans import sqlbits as B
from quellmark.runtime import table


def rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corpus_rows").select("row_id", "text")



_VIEWS = {"Normalized": 0, "Confusable": 1, "Evasion": 2}


def _view_rank():
    return F.coalesce(*(F.when(F.col("view") == v, F.lit(k)) for v, k in _VIEWS.items()), F.lit(3))


def tokens(s, d):
    """row_id, clause, pos, token: lower-case words by clause."""
    parts = rows(s, d).select("row_id", F.posexplode(X.clause_parts(F.lower("text"))).alias("clause", "part"))
    return parts.select("row_id", "clause", F.posexplode(X.words(F.col("part"))).alias("pos", "token"))


def _evasion(s, d):
    """Disguised digits read as letters, and three or more single characters in a row joined."""
    spaced = F.concat(F.lit(" "), F.array_join(F.transform(X.words(F.lower("text")), X.unleet), " "), F.lit(" "))
    return rows(s, d).select("row_id", F.trim(F.regexp_replace(spaced, r"(?<= \S) (?=\S \S )|(?<= \S \S) (?=\S )", "")).alias("view"))


def _caps(s, d):
    loud = lambda c: c.rlike(r"\p{Lu}.*\p{Lu}.*\p{Lu}") & ~c.rlike(r"\p{Ll}")
    return rows(s, d).select("row_id", F.size(F.filter(X.clause_parts(F.col("text")), loud)).cast("long").alias("loud_clauses"), F.col("text").rlike(r"[!?][!?]").alias("punctuated"))


def _segments(s, d):
    kept = F.filter(F.transform(F.split("text", r"[\p{P}\p{S}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]+", -1), lambda p: F.regexp_replace(p, r"\s+", "")), lambda p: p != "")
    return rows(s, d).select("row_id", kept.alias("k")).select("row_id", F.size("k").cast("long").alias("segments"), F.length(F.array_join("k", "")).cast("long").alias("characters"))


def _matches(s, d):
    m = table(s, d, "lexicon_matches").where("row_id is not null")
    raw = F.col("text").cast("binary")
    before, inside = F.decode(F.substring(raw, F.lit(1), F.col("raw_start")), "UTF-8"), F.decode(F.substring(raw, F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start")), "UTF-8")
    return m.join(rows(s, d), "row_id").select("match_id", "row_id", "entry_id", "view", "text", F.length(before).alias("first"), (F.length(before) + F.length(inside)).alias("last"), inside.alias("surface"))


def _boundary(s, d):
    """Both neighbours of a match aren't alphanumeric, or one of the adjoining characters is Han or Kana."""
    m = _matches(s, d)
    left, right = F.expr("substring(text, first, 1)"), F.expr("substring(text, last + 1, 1)")
    word, cjk = r"[\p{L}\p{N}]", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    free = lambda c: (c == "") | ~c.rlike(word) | c.rlike(cjk)
    return m.select("match_id", (F.when(F.col("first") == 0, F.lit(True)).otherwise(free(left)) & free(right)).alias("bounded"))


def entry_matches(s, d):
    """row_id, id, view, first, last, lemma, category, level: every place of every lemma in the three views, the first view that has it."""
    lex = _lex(s, d)
    return view_matches(rows(s, d), lex).join(lex.select("id", F.lower("lemma").alias("lemma"), "category", "level"), "id")


def _phrases(s, d):
    """Runs of one to three words of a clause that are a phrase of the lexicon's two-word stand-ins."""
    lex = s.createDataFrame([(p, len(p.split())) for p in PHRASES], "phrase string, n int")
    parts = rows(s, d).select("row_id", F.explode(X.clause_parts(F.lower("text"))).alias("part")).select("row_id", X.words(F.col("part")).alias("ws"))
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - n + 1)), lambda i: F.array_join(F.slice("ws", i, n), " "))))
    spread = parts.select("row_id", F.explode(runs).alias("phrase"))
    return spread.join(F.broadcast(lex), "phrase").groupBy("row_id", "phrase").agg(F.count(F.lit(1)).alias("hits"))


#: Phrases of several words that the demonstration queries look for.
PHRASES = ("such a", "should know", "as soon as", "went away", "live stream", "without any reason")
#: Lemmas to drop (one of them stale), category names by code, and lemmas of everyday use.
DROPS = ("murmelkopf", "rübenkönig", "no such lemma")
COLLISIONS = ("filzhut", "nebelbär", "murmelkopf", "rübenkönig")
#: Phrases that make a lemma of everyday use count after all.
REVIVING = ("such a", "so ein", "du", "you")


def _drops(s, d):
    return s.createDataFrame([(x,) for x in DROPS], "lemma string")


def _assigned(s, d):
    """Level of each entry: recorded, else inclusive for nouns of category `an`, else conservative; part of speech: recorded, else by suffix."""
    suffix = F.when(F.col("lemma").rlike("(en|ern|eln)$"), "v").when(F.col("lemma").rlike("(ig|isch|lich)$"), "a").otherwise("n")
    return table(s, d, "lexicon_de").select("id", F.coalesce("level", F.when((F.col("pos") == "n") & (F.col("category") == "an"), "inclusive"), F.lit("conservative")).alias("level"), F.coalesce("pos", suffix).alias("pos"))


def _siblings(s, d):
    """Forms of every lemma with a further letter, and whether a form is a lemma itself, of another category or level."""
    lex = table(s, d, "lexicon_de").select("id", F.lower("lemma").alias("form"), "category", "level")
    grown = lex.select(F.col("id").alias("base"), F.explode(F.transform(F.array(F.lit("n"), F.lit("s"), F.lit("e")), lambda e: F.concat("form", e))).alias("form"), F.col("category").alias("c"), F.col("level").alias("l"))
    both = grown.join(lex, "form", "left")
    return both.select("base", "form", "id", F.when(F.col("id").isNotNull(), (F.col("c") != F.col("category")) | ~F.col("l").eqNullSafe(F.col("level"))).alias("differs"))


def _category_filter(s, d):
    """Of the categories a page lists (by language name, by code, or of another language) those of the wanted language, without its prefix."""
    listed = F.array(F.concat(F.lit("German "), F.col("category")), F.concat(F.lit("de:"), F.coalesce("pos", F.lit("?"))), F.concat(F.lit("fr:"), F.col("category")), F.concat(F.lit("Germanic "), F.col("category")))
    kept = F.filter(listed, lambda c: c.startswith("German ") | c.startswith("de:"))
    return _lex(s, d).select("id", F.array_join(kept, ",").alias("kept"))


def _evidence(s, d):
    """30 points per distinct lemma and place, none for lemmas of everyday use unless a reactivating phrase comes right before them."""
    found = entry_matches(s, d).select("row_id", "lemma", "first", "last").distinct().join(rows(s, d), "row_id")
    before = F.lower(F.expr("left(text, first)"))
    revived = before.rlike(r"(^|[^\p{L}\p{N}])(" + "|".join(REVIVING) + r") $")
    return found.select("row_id", "lemma", "first", "last", F.when(F.col("lemma").isin(*COLLISIONS) & ~revived, 0).otherwise(30).alias("points"))


def _markers(s, d):
    """What the model reads for a text with lexicon hits: a mark, and one per category."""
    found = entry_matches(s, d).groupBy("row_id").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return found.select("row_id", F.concat(F.lit("lexhit"), F.array_join(F.transform("c", lambda x: F.concat(F.lit(" lexcat"), x)), "")).alias("markers"))


def _confusable(s, d):
    """The words of each text with what can't be seen left out and look-alikes as Latin letters."""
    return folded_words(rows(s, d)).select("row_id", "view")


def _representative(s, d):
    m = table(s, d, "lexicon_matches").where("entry_id is not null").join(table(s, d, "lexicon_de").select(F.col("id").alias("entry_id"), "level"), "entry_id")
    points = F.when(F.col("level") == "conservative", 30).otherwise(20)
    best = m.groupBy("row_id", "raw_start").agg(F.max(F.struct(points.alias("points"), (-_view_rank()).alias("v"), "entry_id")).alias("b"))
    return best.select("row_id", "raw_start", "b.points", "b.entry_id")


def _sweep(s, d, base, known):
    """Forms of lemmas with a further letter that are no lemma yet, with the words of texts that have them, by label."""
    grown = base.select(F.explode(F.transform(F.array(F.lit("n"), F.lit("s")), lambda e: F.concat(F.lower("lemma"), e))).alias("token")).distinct()
    fresh = grown.join(known.select(F.lower("lemma").alias("token")), "token", "left_anti")
    words = table(s, d, "corpus_rows").select("label", F.explode(X.words(F.lower("text"))).alias("token"))
    return words.join(fresh, "token").groupBy("token").agg(F.count_if(F.col("label") == "toxic").alias("toxic"), F.count_if(F.col("label") == "clean").alias("clean"))


#: Spanish entries (id, pos, lemma) for the plural rule, which no German entry falls under.
SPANISH = [("ES00001", "n", "payaso"), ("ES00002", "N", "nuez"), ("ES00003", "a", "banal"), ("ES00004", "a", "gris"), ("ES00005", "v", "pegar"), ("ES00006", "n", "cara dura"), ("ES00007", None, "tonto"), ("ES00008", "n", "feliz")]


def surface_patterns(entry, pos, lemma):
    """The forms of an entry: the lemma and, of a Spanish noun or adjective of one word, its plural."""
    nominal = F.upper(entry).startswith("ES") & F.lower(F.trim(pos)).isin("n", "a") & ~lemma.rlike(r"\s")
    stem = F.regexp_replace(lemma, "z$", "ces")
    plural = F.when(lemma.endswith("z"), stem).when(lemma.rlike("[aeiou]$"), F.concat(lemma, F.lit("s"))).when(lemma.endswith("l"), F.concat(lemma, F.lit("es"))).otherwise(lemma)
    return F.array_distinct(F.when(nominal, F.array(lemma, plural)).otherwise(F.array(lemma)))


def _with_spanish(s, d):
    fixture = s.createDataFrame(SPANISH, "id string, pos string, lemma string")
    return _lex(s, d).where("lemma is not null").select("id", "pos", "lemma").union(fixture)


def _lex(s, d):
    return table(s, d, "lexicon_de")


QUERIES = {
    "normalize_generic": lambda s, d: rows(s, d).select("row_id", X.normalize_generic(F.col("text")).alias("normalized")),
    "normalize_turkish": lambda s, d: rows(s, d).select("row_id", X.normalize_turkish(F.col("text")).alias("normalized")),
    "normalize_arabic": lambda s, d: rows(s, d).select("row_id", X.normalize_arabic(F.col("text")).alias("normalized")),
    "escape": lambda s, d: rows(s, d).select("row_id", X.escape(F.col("text")).alias("escaped")),
    "unescape": lambda s, d: table(s, d, "corpus_raw").select("raw_id", X.unescape(F.col("line")).alias("plain")),
    "word_tokens": lambda s, d: tokens(s, d).groupBy("row_id", "token").agg(F.count(F.lit(1)).alias("n"), F.max("clause").cast("long").alias("last_clause")),
    "view_normalized": lambda s, d: rows(s, d).select("row_id", F.array_join(X.words(F.lower("text")), " ").alias("view")),
    "view_evasion": _evasion,
    "leet_map": lambda s, d: table(s, d, "lexicon_matches").select("match_id", X.unleet(F.col("matched_text")).alias("plain")),
    "char_ngrams": lambda s, d: _lex(s, d).select("id", F.explode(F.expr("transform(sequence(1, length(lemma)), i -> substring(concat(char(2), lemma, char(3)), i, 3))")).alias("gram")),
    "caps_punct": _caps,
    "compact_segments": _segments,
    "context_tokens": lambda s, d: context_tokens(rows(s, d)).drop("quoted"),
    "quote_ranges": lambda s, d: quoted_spans(rows(s, d)),
    "rule_quote_ranges": lambda s, d: quoted_spans(rows(s, d), RULE_QUOTES),
    "normalize_hindi": lambda s, d: rows(s, d).select("row_id", X.nfkc(F.col("text")).alias("normalized")),
    "hindi_tokens": lambda s, d: rows(s, d).select("row_id", F.posexplode(X.hindi_words(X.nfkc(F.col("text")))).alias("pos", "token")),
    "span_map": lambda s, d: _matches(s, d).select("match_id", "first", "last", "surface"),
    "match_boundary": _boundary,
    "surface_patterns": lambda s, d: _with_spanish(s, d).select("id", F.explode(surface_patterns(F.col("id"), F.col("pos"), F.col("lemma"))).alias("surface")),
    "hash_word_unigram": lambda s, d: _lex(s, d).select("id", F.expr("aggregate(transform(sequence(1, octet_length(lemma)), k -> cast(conv(hex(substring(cast(lemma as binary), k, 1)), 16, 10) as int)), aggregate(array(87, 1, 0), 8997, (h, b) -> ((h ^ b) * 435) & 65535), (h, b) -> ((h ^ b) * 435) & 65535)").alias("bin")),
    "hash_char_gram": lambda s, d: QUERIES["char_ngrams"](s, d).select("id", "gram", F.expr("aggregate(transform(sequence(1, octet_length(gram)), k -> cast(conv(hex(substring(cast(gram as binary), k, 1)), 16, 10) as int)), aggregate(array(67, 3), 8997, (h, b) -> ((h ^ b) * 435) & 65535), (h, b) -> ((h ^ b) * 435) & 65535)").alias("bin")),
    "lexicon_match": lambda s, d: entry_matches(s, d).groupBy("row_id", "id").agg(F.count(F.lit(1)).alias("hits"), F.min("first").alias("first")),
    "view_confusable": _confusable,
    "lexicon_match_views": lambda s, d: view_matches(rows(s, d), _lex(s, d)),
    "lexicon_match_phrases": _phrases,
    "lexicon_markers": _markers,
    "match_dedupe": lambda s, d: table(s, d, "lexicon_matches").groupBy("row_id", "entry_id", "raw_start", "raw_end").agg(F.min(F.struct(_view_rank().alias("v"), "match_id")).alias("b")).select("row_id", "entry_id", "raw_start", "raw_end", "b.match_id"),
    "lexicon_representative": _representative,
    "lexicon_drops": lambda s, d: _lex(s, d).join(_drops(s, d), "lemma", "left_anti").select("id", "lemma"),
    "lexicon_stale_drops": lambda s, d: _drops(s, d).join(_lex(s, d), "lemma", "left_anti").select("lemma"),
    "lexicon_assign": lambda s, d: _assigned(s, d).select("id", "level"),
    "lexicon_pos": lambda s, d: _assigned(s, d).select("id", "pos"),
    "lexicon_siblings": _siblings,
    "lexicon_ids": lambda s, d: running(_lex(s, d).select("id", "category", "lemma"), [F.col("category"), F.col("lemma"), F.col("id")]).select("id", F.format_string("DE%05d", F.col("rank")).alias("new_id")),
    "lexical_evidence": _evidence,
    "collision_filter": lambda s, d: _evidence(s, d).groupBy("row_id").agg(F.max("points").alias("points"), F.count_if(F.col("points") == 0).alias("collisions")),
    "casefold_merge": lambda s, d: table(s, d, "lexicon_matches").where("entry_id is not null").groupBy(F.lower("matched_text").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("entry_id")), ",").alias("entries")),
    "harvest_merge": lambda s, d: (lambda first, more: first.unionByName(more.join(first, "lemma", "left_anti")))(_lex(s, d).where("level = 'conservative'").select("lemma", F.lit("native").alias("origin")).distinct(), _lex(s, d).where("level is null or level <> 'conservative'").select("lemma", F.lit("later").alias("origin")).distinct()),
    "category_filter": _category_filter,
    "variant_sweep": lambda s, d: _sweep(s, d, _lex(s, d), _lex(s, d)),
    "drops_sweep": lambda s, d: _sweep(s, d, _lex(s, d).where("stereotype = 'yes'"), _lex(s, d)),
}

_CLAUSES = "[" + X.CLAUSE_END + "]"
_SCOPES = "[" + X.CLAUSE_END + X.SCOPE_END + "]"
_DROPS = "(values " + ", ".join(f"('{x}')" for x in DROPS) + ") as drops(lemma)"
_UNLEET = r"case when regexp_matches({0}, '\p{{L}}') and regexp_matches({0}, '[0-9]') then translate({0}, '013457', 'oieast') else {0} end"
_GRAMS = "select id, unnest(list_transform(generate_series(1, length(lemma)), lambda i: substr(chr(2) || lemma || chr(3), i, 3))) as gram from lexicon_de"
_RANK = "case view when 'Normalized' then 0 when 'Confusable' then 1 when 'Evasion' then 2 else 3 end"
_SPANS = "spans as (select match_id, m.row_id, text, length(decode(encode(text)[1:raw_start])) as first, length(decode(encode(text)[1:raw_end])) as last, decode(encode(text)[raw_start + 1:raw_end]) as surface from lexicon_matches m join corpus_rows c on m.row_id = c.row_id)"
_LOOSE = r"[\p{L}\p{N}\p{M}\p{Cf}]+"
_FROM, _TO = ("".join(chr(k) for k in FOLDED), "".join(chr(v) if isinstance(v, int) else v for v in FOLDED.values()))


def _folded(x: str) -> str:
    return f"lower(translate({B.nfkc(f"regexp_replace({x}, '\\p{{Cf}}+', chr(0)[:0], 'g')")}, '{_FROM}', '{_TO}'))"


def _words_at(name: str, pattern: str, form: str) -> str:
    """(row_id, k, w, first, last) of the words of every text, in code points."""
    return f"""{name}_split as (select row_id, unnest(regexp_extract_all(text, '{pattern}')) as raw, unnest(regexp_split_to_array(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) as gap, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) as k from corpus_rows),
{name} as materialized (select * from (select row_id, k, {form} as w, (sum(length(gap) + length(raw)) over (partition by row_id order by k) - length(raw))::int as first, (sum(length(gap) + length(raw)) over (partition by row_id order by k))::int as last from {name}_split) where w <> chr(0)[:0])"""


def _runs(name: str, lemma: str, rank: int) -> str:
    return f"""select row_id, id, {rank} as v, first, last from {name} join {lemma} using (w) where n = 1 union all
    select row_id, id, {rank}, first, last2 from (select *, w || ' ' || lead(w) over o as ww, lead(last) over o as last2 from {name} window o as (partition by row_id order by first)) x join {lemma} l on l.w = x.ww and n = 2"""


_LEMMAS = f"""{_words_at("plain_words", B.WORD, B.clean("raw"))}, {_words_at("loose_words", _LOOSE, _folded("raw"))},
singles as (select *, k - row_number() over (partition by row_id, length(w) = 1 order by k) as island, length(w) = 1 as one from plain_words),
sized as (select *, count(*) over (partition by row_id, one, island) as many from singles),
undone as materialized (select row_id, string_agg(w, '' order by k) as w, min(first) as first, max(last) as last from sized where one and many >= 3 group by row_id, island
    union all select row_id, case when regexp_matches(w, '\\p{{L}}') and regexp_matches(w, '[0-9]') then translate(w, '{X.LEET[0]}', '{X.LEET[1]}') else w end, first, last from sized where not (one and many >= 3)),
named as (select id, array_to_string(list_transform(regexp_extract_all(lemma, '{B.WORD}'), lambda w: {B.clean("w")}), ' ') as w, len(regexp_extract_all(lemma, '{B.WORD}')) as n from lexicon_de where id is not null and lemma is not null),
looked as (select id, array_to_string(list_transform(regexp_extract_all(lemma, '{_LOOSE}'), lambda w: {_folded("w")}), ' ') as w, len(regexp_extract_all(lemma, '{_LOOSE}')) as n from lexicon_de where id is not null and lemma is not null),
every as ({_runs("plain_words", "named", 0)} union all {_runs("loose_words", "looked", 1)} union all {_runs("undone", "named", 2)}),
hits as materialized (select e.row_id, e.id, min(v) as v, e.first, e.last, any_value(lower(l.lemma)) as lemma, any_value(category) as category from every e join lexicon_de l on l.id = e.id group by e.row_id, e.id, e.first, e.last)"""
_SCORED = f"""{_LEMMAS}, places as (select distinct row_id, lemma, first, last from hits), evidence as (select p.*, case when lemma in ({", ".join(repr(c) for c in COLLISIONS)}) and not regexp_matches(lower(left(text, first)), '(^|[^\\p{{L}}\\p{{N}}])({"|".join(REVIVING)}) $') then 0 else 30 end as points
    from places p join corpus_rows c on c.row_id = p.row_id)"""


def _sweep_sql(base: str) -> str:
    return f"with grown as (select distinct unnest([lower(lemma) || 'n', lower(lemma) || 's']) as token from {base}), fresh as (select token from grown where token not in (select lower(lemma) from lexicon_de)), words as (select label, unnest(regexp_extract_all(lower(text), '{B.WORD}')) as token from corpus_rows) select token, count(*) filter (label = 'toxic') as toxic, count(*) filter (label = 'clean') as clean from words join fresh using (token) group by token"


SQL = {
    "normalize_generic": f"select row_id, {B.clean('text')} as normalized from corpus_rows",
    "normalize_turkish": f"select row_id, lower(translate({B.nfkc('text')}, 'Iİ', 'ıi')) as normalized from corpus_rows",
    "normalize_arabic": f"select row_id, translate(regexp_replace({B.nfkc('text')}, '{X.ARABIC_DROPPED}', '', 'g'), '{X.ALEF[0]}', '{X.ALEF[1]}') as normalized from corpus_rows",
    "escape": r"select row_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') as escaped from corpus_rows",
    "unescape": r"select raw_id, replace(replace(replace(replace(replace(line, '\\', chr(1)), '\t', chr(9)), '\n', chr(10)), '\r', chr(13)), chr(1), '\') as plain from corpus_raw",
    "word_tokens": f"with p as (select row_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as clause from (select row_id, regexp_split_to_array(lower(text), '{_CLAUSES}') as parts from corpus_rows)), t as (select row_id, clause, unnest(regexp_extract_all(part, '{B.WORD}')) as token from p) select row_id, token, count(*) as n, max(clause)::bigint as last_clause from t group by all",
    "view_normalized": f"select row_id, array_to_string(regexp_extract_all(lower(text), '{B.WORD}'), ' ') as view from corpus_rows",
    "view_evasion": f"""with l as (select row_id, list_transform(regexp_extract_all(lower(text), '{B.WORD}'), lambda w: {_UNLEET.format('w')}) as ws from corpus_rows),
        t as (select row_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from l), f as (select *, length(w) = 1 as one from t),
        g as (select *, case when one then pos - row_number() over (partition by row_id, one order by pos) else -pos end as island from f),
        i as (select row_id, island, min(pos) as begun, count(*) as n, string_agg(w, '' order by pos) as glued, string_agg(w, ' ' order by pos) as spaced from g group by row_id, island),
        v as (select row_id, string_agg(case when n >= 3 then glued else spaced end, ' ' order by begun) as view from i group by row_id) select c.row_id, case when c.text is null then null else coalesce(view, chr(0)[:0]) end as view from corpus_rows c left join v using (row_id)""",
    "leet_map": f"select match_id, {_UNLEET.format('matched_text')} as plain from lexicon_matches",
    "char_ngrams": _GRAMS,
    "caps_punct": rf"select row_id, len(list_filter(regexp_split_to_array(text, '{_CLAUSES}'), lambda c: regexp_matches(c, '\p{{Lu}}.*\p{{Lu}}.*\p{{Lu}}') and not regexp_matches(c, '\p{{Ll}}')))::bigint as loud_clauses, regexp_matches(text, '[!?][!?]') as punctuated from corpus_rows",
    "compact_segments": r"with k as (select row_id, list_filter(list_transform(regexp_split_to_array(text, '[\p{P}\p{S}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]+'), lambda p: regexp_replace(p, '\s+', '', 'g')), lambda p: p <> '') as k from corpus_rows) select row_id, len(k)::bigint as segments, length(array_to_string(k, ''))::bigint as characters from k",
    "context_tokens": f"""with l as (select row_id, regexp_split_to_array(text, '{B.WORD}') as gaps, regexp_extract_all(text, '{B.WORD}') as ws from corpus_rows), t as (select row_id, unnest(ws) as w, unnest(gaps[:len(ws)]) as gap, generate_subscripts(ws, 1) as k from l),
        c as (select *, sum(length(gap) + length(w)) over o as last, sum((k > 1 and regexp_matches(gap, '{_CLAUSES}'))::int) over o as clause, sum((k > 1 and regexp_matches(gap, '{_SCOPES}'))::int) over o as scope from t window o as (partition by row_id order by k))
        select row_id, (k - 1)::int as pos, lower(w) as token, (last - length(w))::int as first, last::int as last, clause::int as clause, scope::int as scope, gap[-1] = '@' as mention from c""",
    "span_map": f"with {_SPANS} select match_id, first::int as first, last::int as last, surface from spans",
    "match_boundary": rf"with {_SPANS}, n as (select match_id, first = 0 as start, text[first] as a, text[last + 1] as b from spans) select match_id, (start or not regexp_matches(a, '[\p{{L}}\p{{N}}]') or regexp_matches(a, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]')) and (b = '' or not regexp_matches(b, '[\p{{L}}\p{{N}}]') or regexp_matches(b, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]')) as bounded from n",
    "surface_patterns": f"with e as (select id, pos, lemma from lexicon_de where lemma is not null union all select * from (values {', '.join('(' + ', '.join('null' if x is None else repr(x) for x in r) + ')' for r in SPANISH)}) as v(id, pos, lemma)) select distinct id, unnest(case when starts_with(upper(id), 'ES') and lower(trim(pos)) in ('n', 'a') and not regexp_matches(lemma, '\\s') then [lemma, case when lemma like '%z' then left(lemma, length(lemma) - 1) || 'ces' when regexp_matches(lemma, '[aeiou]$') then lemma || 's' when lemma like '%l' then lemma || 'es' else lemma end] else [lemma] end) as surface from e",
    "hash_word_unigram": f"select id, {B.fnv16('[87, 1, 0]', 'lemma')}::int as bin from lexicon_de",
    "hash_char_gram": f"select id, gram, {B.fnv16('[67, 3]', 'gram')}::int as bin from ({_GRAMS})",
    "lexicon_match": f"with {_LEMMAS} select row_id, id, count(*) as hits, min(first) as first from hits group by all",
    "lexicon_match_views": f"with {_LEMMAS} select row_id, id, case v when 0 then 'Normalized' when 1 then 'Confusable' else 'Evasion' end as view, first, last from hits",
    "view_confusable": f"with {_words_at('loose_words', _LOOSE, _folded('raw'))} select c.row_id, coalesce(string_agg(w, ' ' order by k), chr(0)[:0]) as view from corpus_rows c left join loose_words l on l.row_id = c.row_id group by c.row_id",
    "lexicon_match_phrases": f"with p as (select row_id, regexp_extract_all(unnest(regexp_split_to_array(lower(text), '{_CLAUSES}')), '{B.WORD}') as ws from corpus_rows), r as (select row_id, array_to_string(ws[i:i + n - 1], ' ') as phrase from p, (select unnest([2, 3]) as n), lateral (select unnest(generate_series(1, len(ws) - n + 1)) as i)) select row_id, phrase, count(*) as hits from r where phrase in ({', '.join(repr(p) for p in PHRASES)}) group by all",
    "lexicon_markers": f"with {_LEMMAS}, c as (select distinct row_id, category from hits) select row_id, 'lexhit' || string_agg(' lexcat' || category, '' order by category) as markers from c group by row_id",
    "match_dedupe": f"select row_id, entry_id, raw_start, raw_end, arg_min(match_id, ({_RANK}) * 1000000000000 + match_id) as match_id from lexicon_matches group by 1, 2, 3, 4",
    "lexicon_representative": f"with m as (select m.*, case when level = 'conservative' then 30 else 20 end as points from lexicon_matches m join lexicon_de l on l.id = entry_id), r as (select *, row_number() over (partition by row_id, raw_start order by points desc, {_RANK}, entry_id desc) as k from m) select row_id, raw_start, points, entry_id from r where k = 1",
    "lexicon_drops": f"select id, lemma from lexicon_de where lemma not in (select lemma from {_DROPS})",
    "lexicon_stale_drops": f"select lemma from {_DROPS} where lemma not in (select lemma from lexicon_de)",
    "lexicon_assign": "select id, coalesce(level, case when pos = 'n' and category = 'an' then 'inclusive' end, 'conservative') as level from lexicon_de",
    "lexicon_pos": "select id, coalesce(pos, case when regexp_matches(lemma, '(en|ern|eln)$') then 'v' when regexp_matches(lemma, '(ig|isch|lich)$') then 'a' else 'n' end) as pos from lexicon_de",
    "lexicon_siblings": "with g as (select id as base, unnest([lower(lemma) || 'n', lower(lemma) || 's', lower(lemma) || 'e']) as form, category as c, level as l from lexicon_de) select base, form, x.id, case when x.id is not null then c <> category or l is distinct from level end as differs from g left join lexicon_de x on lower(x.lemma) = form",
    "lexicon_ids": "select id, format('DE{:05d}', row_number() over (order by category, lemma, id)) as new_id from lexicon_de",
    "lexical_evidence": f"with {_SCORED} select row_id, lemma, first, last, points from evidence",
    "collision_filter": f"with {_SCORED} select row_id, max(points) as points, count(*) filter (points = 0) as collisions from evidence group by row_id",
    "casefold_merge": "select lower(matched_text) as key, string_agg(distinct entry_id, ',' order by entry_id) as entries from lexicon_matches where entry_id is not null group by 1",
    "harvest_merge": "with n as (select distinct lemma from lexicon_de where level = 'conservative') select lemma, 'native' as origin from n union all select distinct lemma, 'later' from lexicon_de where level is distinct from 'conservative' and lemma not in (select lemma from n)",
    "category_filter": "select id, array_to_string(list_filter(['German ' || category, 'de:' || coalesce(pos, '?'), 'fr:' || category, 'Germanic ' || category], lambda c: starts_with(c, 'German ') or starts_with(c, 'de:')), ',') as kept from lexicon_de",
    "variant_sweep": _sweep_sql("lexicon_de"),
    "drops_sweep": _sweep_sql("lexicon_de where stereotype = 'yes'"),
    "normalize_hindi": f"select row_id, {B.nfkc('text')} as normalized from corpus_rows",
    "hindi_tokens": f"with t as (select row_id, regexp_extract_all({B.nfkc('text')}, '{B.WORD}') as ws from corpus_rows) select row_id, (unnest(generate_series(1, len(ws))) - 1)::int as pos, unnest(ws) as token from t",
}
