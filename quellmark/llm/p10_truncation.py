"""Problem 10: texts cut off by field limits or in transfer, found in pure SQL.

Words are what white space parts, with the punctuation they end in; names, mentions, tags, links and signature lines are each
written alike, as they are too rare to count. Word trigrams are counted inside texts and at ends, once for all copies of a text; a
final trigram that is frequent inside texts but at an end less often than a word in general marks its document as cut. Where the
trigram is too rare to tell (a word cut in two is), the trigram of its words' endings decides, or at last the ending of its last
word alone, both summed from the same counts. Nothing but these counts decides: which characters end a text is not given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellmark.runtime import Workspace, table

#: Ends that must be expected of a trigram, and of the trigrams that share their words' endings, if they ended texts as often as
#: words in general do, for their own share of ends to count: with fewer the next coarser count decides.
FREQUENT, BROAD = 1.0, 20.0
#: A last ending that is too rare inside texts to tell is a cut unless it makes so large a share of all ends.
USUAL = 0.001

#: One pass over each text: `line` is the text with names, mentions, tags, links and signatures written alike, `h` its hash, `at` the row's number; `g` are its last three words.
LINES = r"""
select doc_id, source, line, xxhash64(line) as h, monotonically_increasing_id() as at, reverse(regexp_extract(reverse(concat('^ ^ ', line)), r'^(\S+\s+\S+\s+\S+)', 1)) as g
from (select doc_id, source,
        regexp_replace(whole, r'(?m)^[ ]*(--)[^\n]*$|\x{FE0F}|https?(:)//\S+|(?<![\p{L}\p{N}&])([@#])[\p{L}\p{N}_]+|(\p{Lu})[\p{L}\p{M}\p{N}]*', '$1$2$3$4') as line
    from (select doc_id, source, trim(trailing ' \n\t\r' from text) as whole from {documents} where doc_id is not null and text is not null))
"""

#: Texts that occur again, with the row that counts for all their copies.
COPIES = "select h, min(at) as first from {lines} group by h having count(*) > 1"

#: The counts, the trigrams of word endings (what ends in a letter, digit or broken character is a word; closing marks count as one, symbols too), and the verdict.
METHOD = r"""
with once as (select g, line from {lines} l left join {copies} c on l.h = c.h where line <> '' and (c.h is null or l.at = c.first)),
seen as (select g, count(*) as n from (
    select explode(regexp_extract_all(concat('^ ^ ', line), r'(?<!\S)(?=(\S+\s+\S+\s+\S+))', 1)) as g from once) group by g),
final as (select g, count(*) as n from once group by g),
counted as (select coalesce(seen.g, final.g) as g, greatest(coalesce(seen.n, 0), coalesce(final.n, 0)) as n, coalesce(final.n, 0) as last
    from seen full join final on seen.g = final.g),
shaped as (select g, n, last, regexp_replace(g, r'\S*?([\p{L}\p{M}\p{N}_&;\\�]|\S)(?=\s|$)\s*', '$1 ') as k from counted),
named as (select g, n, last, regexp_replace(regexp_replace(regexp_replace(k, r'[\p{L}\p{M}\p{N}_&;\\�]', 'w'), r'[\p{Pe}\p{Pf}]', ')'), r'[\p{So}\p{Sk}]', '*') as k from shaped),
kinds as (select k, sum(n) as n, sum(last) as last from named group by k),
closes as (select substring_index(trim(k), ' ', -1) as c, sum(n) as n, sum(last) as last from kinds group by 1),
base as (select sum(last) / sum(n) as rate, sum(last) as ends from counted),
judged as (select named.g, named.n - named.last as inside, named.last as terminal, case
    when rate * (named.n - named.last) >= :frequent and named.last - 1 < rate * named.n then true
    when rate * (kinds.n - kinds.last) >= :broad then kinds.last - 1 < rate * kinds.n
    when rate * (closes.n - closes.last) >= :frequent then closes.last - 1 < rate * closes.n
    else closes.last <= :usual * ends end as cut, case
    when rate * (named.n - named.last) >= :frequent and named.last - 1 < rate * named.n then 'trigram'
    when rate * (kinds.n - kinds.last) >= :broad then 'endings' when rate * (closes.n - closes.last) >= :frequent then 'ending' else 'rare ending' end as decided_by
    from named join kinds on named.k = kinds.k join closes on substring_index(trim(named.k), ' ', -1) = closes.c
    cross join base where named.last > 0)
select l.doc_id, l.source, l.g as final_trigram, coalesce(inside, 0) as inside, coalesce(terminal, 0) as terminal, coalesce(cut, false) as cut, decided_by
from {lines} l left join judged on l.g = judged.g
"""


def _braces(sql: str, *kept: str) -> str:
    """The statement with its braces doubled, but for the tables it names."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in kept:
        sql = sql.replace("{{" + name + "}}", "{" + name + "}")
    return sql


def truncation(documents: DataFrame) -> DataFrame:
    """doc_id, source, final_trigram, inside, terminal, cut (by the counts), decided_by (the word trigram itself, or which coarser count).

    Null texts and ids are left out; an empty text is complete; repeated rows are judged alike; trailing white space
    doesn't count; of other columns only source is read. Trigrams are counted map-side first, so a hot one costs a row per task;
    `inside` and `terminal` count texts that are the same but for names once.
    """
    spark = documents.sparkSession
    first = _braces(LINES, "documents")
    work = Workspace(spark, "p10")
    lines = work.keep(spark.sql(first, documents=documents.select("doc_id", "text", "source")))
    copies = work.keep(spark.sql(COPIES, lines=lines))
    return spark.sql(_braces(METHOD, "lines", "copies"), args={"frequent": FREQUENT, "broad": BROAD, "usual": USUAL}, lines=lines, copies=copies)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p10_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the word trigrams themselves say of every document: its final one's counts, and whether it is frequent inside texts but almost never at ends.

    A word cut in two makes a trigram that is never inside, so most cuts aren't flagged; the more documents, the more trigrams can tell.
    """
    flagged = F.col("cut") & F.coalesce(F.col("decided_by") == "trigram", F.lit(False))
    return truncation(table(spark, sf_dir, "documents")).select("doc_id", "source", "final_trigram", "inside", "terminal", flagged.alias("flagged"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    found = truncation(table(spark, sf_dir, "documents"))
    return found.groupBy("source").agg({"cut": "count_if", "*": "count"}).selectExpr(
        "source", "`count_if(cut)` as cut", "`count(1)` as documents", "`count_if(cut)` / `count(1)` as share"
    )


QUERIES = {"p10_method": p10_method, "p10_found": p10_found, "p10_sources": p10_sources}

#: Characters that end a complete text, for the SQL only.
ENDS = ".!?…。！？؟।)]}»”\"』」）"
#: The plain rule that TESTDATA.md gives; the counts above don't know it.
_RULE = """with e as (select doc_id, source, rtrim(text, ' ' || chr(10) || chr(9) || chr(13)) as t from documents where text is not null),
r as (select doc_id, source, not (t = chr(0)[:0] or contains('{ends}', t[-1]) or regexp_matches(t[-1], '[\\p{{So}}\\p{{Sk}}]') and t[-1] <> '�'
    or regexp_matches(t, '(^|\\s)(#|https?://)\\S*$') or regexp_matches(t, '(^|\\n)[ ]*--[^\\n]*$')) as cut from e)""".format(ends=ENDS)
SQL = {
    "p10_found": f"{_RULE} select doc_id from r where cut",
    "p10_sources": f"{_RULE} select source, count(*) filter (cut) as cut, count(*) as documents, count(*) filter (cut) / count(*) as share from r group by 1",
}
