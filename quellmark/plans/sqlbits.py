"""Pieces of DuckDB SQL that several reference statements share."""

from quellmark.functions.text import CLAUSE_END

WORD = r"[\p{L}\p{N}\p{M}]+"
_WIDE = "".join(chr(p) for p in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(p) for p in range(0x21, 0x7F))
_SPACES = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """Compatibility composition for the characters of the test data: widths, spaces, ligatures and the ellipsis."""
    x = f"translate({x}, {_quoted(_WIDE + _SPACES)}, {_quoted(_PLAIN + ' ' * len(_SPACES))})"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("ﬀ", "ff")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize({x})"


def clean(x: str) -> str:
    return f"lower({nfkc(x)})"


def bytes_of(x: str) -> str:
    h = f"hex(encode({x}))"
    digit = "instr('123456789ABCDEF', {})"
    return f"list_transform(generate_series(1, length({h}), 2), lambda i: {digit.format(f'{h}[i]')} * 16 + {digit.format(f'{h}[i + 1]')})"


def fnv16(head: str, x: str) -> str:
    """16-bit FNV-1a of a list of head bytes and a string."""
    return f"list_reduce(list_concat({head}, {bytes_of(x)}), lambda h, b: (xor(h, b) * 435) & 65535, 8997)"


#: (row_id, bin) of every corpus row: words, neighbours within a clause, 3 to 5 characters within words.
BINS = f"""
texts as materialized (select row_id, split, label, {clean('text')} as t from corpus_rows where text is not null),
parts as materialized (select row_id, unnest(list_transform(regexp_split_to_array(t, '[{CLAUSE_END}]'), lambda p: regexp_extract_all(p, '{WORD}'))) as ws from texts),
tokens as materialized (select distinct row_id, unnest(ws) as w from parts),
pairs as materialized (select distinct row_id, unnest(list_zip(ws[:-2], ws[2:])) as p from parts where len(ws) > 1),
one as (select w, {fnv16("[87, 1, 0]", "w")} as bin from (select distinct w from tokens)),
two as (select p, list_reduce(list_concat([87, 2, 0], {bytes_of("p[1]")}, [0], {bytes_of("p[2]")}), lambda h, b: (xor(h, b) * 435) & 65535, 8997) as bin from (select distinct p from pairs)),
windows as (select distinct w, n, substr(chr(2) || w || chr(3), i, n) as g from (select distinct w from tokens), (select unnest([3, 4, 5]) as n), lateral (select unnest(generate_series(1, length(w) + 3 - n)) as i)),
hashed as materialized (select n, g, {fnv16("[67, n]", "g")} as bin from (select distinct n, g from windows)),
grams as (select distinct w, bin from windows join hashed using (n, g)),
token_bins as materialized (select w, bin from one union select w, bin from grams),
row_bins as materialized (select row_id, bin from tokens join token_bins using (w) union select row_id, bin from pairs join two using (p))
"""

MODEL = f"""{BINS},
dev as (select row_id, label from texts where split = 'development' and label is not null),
totals as (select count(*) filter (label = 'toxic') as nt, count(*) filter (label = 'clean') as nc from dev),
counts as materialized (select bin, count(*) filter (label = 'toxic') as toxic, count(*) filter (label = 'clean') as clean from row_bins join dev using (row_id) group by bin),
smooth as (select bin, (toxic + 1) / (nt + 2) as pt, (clean + 1) / (nc + 2) as pc from counts, totals where toxic + clean >= 2),
weights as (select bin, greatest(-32768, least(32767, round((ln(pt / (1 - pt)) - ln(pc / (1 - pc))) * 256)))::bigint as weight from smooth),
bias as (select round((ln(nt / nc) + (select sum(ln(1 - pt) - ln(1 - pc)) from smooth)) * 256)::bigint as bias from totals),
scores as materialized (select t.row_id, any_value(t.split) as split, any_value(t.label) as label, (coalesce(sum(weight), 0) + any_value(bias))::bigint as raw
    from texts t left join row_bins using (row_id) left join weights using (bin), bias group by t.row_id),
validation as (select * from scores where split = 'validation' and label is not null)
"""
CURVE = f"""{MODEL},
candidates as (select distinct b as boundary from (select unnest([raw, raw + 1]) as b from validation union all select 0) where b >= 0),
curve as materialized (select boundary, count(*) filter (label = 'toxic' and raw >= boundary) as tp, count(*) filter (label = 'clean' and raw >= boundary) as fp,
    count(*) filter (label = 'clean' and raw < boundary) as tn, count(*) filter (label = 'toxic' and raw < boundary) as fn from candidates, validation group by boundary),
passing as (select * from curve where 10000 * fp <= 300 * (fp + tn) and 100 * tp >= 90 * (tp + fp) and tp > 0),
best as materialized (select boundary, tp, fp, tn, fn from passing order by tp desc, fp, boundary desc limit 1),
ordered as (select raw, row_number() over (order by raw) - 1 as i, count(*) over () as n from validation),
scale as materialized (select greatest(1, max(abs(raw - boundary)))::bigint as scale from ordered, best where i in ((n - 1) // 10, (n - 1) * 9 // 10)),
verdicts as materialized (select row_id, split, label, raw, case when raw >= boundary then 50 + least(50, (raw - boundary) * 50 // scale)
    else 50 - least(50, ((boundary - raw) * 50 + scale - 1) // scale) end::int as score from scores, best, scale)
"""
