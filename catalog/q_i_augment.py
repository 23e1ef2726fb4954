"""Augmentation jobs."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions import perturb as PT
from glyphmill.functions.units import explode_rows, pin
from glyphmill.operators import augment as A
from glyphmill.operators import profile as P
from glyphmill.operators import seqlabel as Q

from . import query
from . import sqlkit as q
from .common import docs, labelled, table
from .q_b_filters import ENGLISH_SQL, _sql_frac
from .q_h_text import rfind


def tr(table):
    src, dst = "".join(table), "".join(table.values())
    return f"translate(text, '{src}', '{dst}')"


CH = "[x for x in string_split({t}, '') if x <> '']"
ASCII = "".join(map(chr, range(0x21, 0x7F)))
FULL = "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F)) + "　"
TAGS = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
SQL = {
    **{op: tr(t) for op, t in PT.TABLES.items()},
    "zerowidth": f"array_to_string({CH.format(t='text')}, '\u200b')",
    "underline": "regexp_replace(text, '(\\p{L})', '\\1\u0332', 'g')",
    "bidi": "'\u202e' || array_to_string(list_reverse(string_split(text, '')), '') || '\u202c'",
    "fullwidth": f"translate(text, '{ASCII.replace(chr(39), chr(39) * 2)} ', '{FULL}')",
    "tags": f"translate(text, ' {ASCII.replace(chr(39), chr(39) * 2)}', '{TAGS}')",
    "upside": f"array_to_string(list_reverse(string_split(translate(text, '{PT.LOWER + PT.LOWER.upper()}', '{PT.UPSIDE * 2}'), '')), '')",
    "spaces": f"array_to_string({CH.format(t='text')}, ' ')",
    "dots": "array_to_string([array_to_string([x for x in string_split(w, '') if x <> ''], '.') for w in regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') if w <> ''], ' ')",
    "altcase": "array_to_string([case when i % 2 = 0 then case when x = 'ß' then 'SS' else upper(x) end else lower(x) end for x, i in " + CH.format(t="text") + "], '')",
}
for _op, _sql in SQL.items():
    _id = "i1" if _op in PT.TABLES else "i2" if _op in ("zerowidth", "underline", "bidi") else "i3"

    @query(f"{_id}_{_op}", f"select doc_id, md5({_sql}) as h from documents")
    def _(spark, d, _op=_op):
        return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(PT.perturb("text", _op, 1.0)).alias("h"))


@query("i1_homoglyph_half")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(PT.perturb("text", "homoglyph", 0.5, 1, "doc_id")).alias("h"))


@query("i2_varsel")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.length(PT.perturb("text", "varsel")).alias("n"))


@query("i4_typos")
def _(spark, d):
    t = PT.perturb("text", "typos", 0.08, 4, "doc_id")
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(t).alias("h"), (F.length(t) - F.length("text")).alias("longer"))


@query("i5_perturb_window", f"""with a as (select doc_id, text, {q.h32('5.s', 'doc_id')} % (greatest(length(text) - 400, 0) + 1) as s, {q.h32('5.e', 'doc_id')} % 301 + 100 as n from documents)
select doc_id, md5(substr(text, 1, s::INT) || translate(substr(text, (s + 1)::INT, n::INT), '{''.join(PT.TABLES['leet'])}', '{''.join(PT.TABLES['leet'].values())}') || substr(text, (s + n + 1)::INT)) as h from a""")
def _(spark, d):
    return A.perturb_window(docs(spark, d, "doc_id", "text"), "text", "doc_id", "leet", 100, 400, 5, 1.0).select("doc_id", F.md5("text").alias("h"))


RAND = ["fullwidth", "tags", "upside", "underline"]


@query("i6_perturb_random", f"""select doc_id, 'augment/' || ['fullwidth','tags','upside','underline'][({q.h32('6.op', 'doc_id')} % 4 + 1)::INT] as source,
 md5(case ({q.h32('6.op', 'doc_id')} % 4) when 0 then {SQL['fullwidth']} when 1 then {SQL['tags']} when 2 then {SQL['upside']} else {SQL['underline']} end) as h from documents""")
def _(spark, d):
    return A.perturb_random(docs(spark, d, "doc_id", "text"), "text", "doc_id", RAND, 6).select("doc_id", "source", F.md5("text").alias("h"))


FRAMES = ["{p}", "Note: {p}", "<!-- {p} -->", "[[ {p} ]]"]


@query("i7_insert_payloads", f"""with pl as (select conv_id as pid, arg_min(text, turn) as payload from conversations where role = 'user' group by conv_id), rk as (select *, row_number() over (order by {q.h32('7.r', 'pid')}, pid) as pr, count(*) over () as n from pl),
 c as (select doc_id, text, {q.u('7.a', 'doc_id')} < 0.5 as att, {q.h32('7.k', 'doc_id')} % (select count(*) from pl) + 1 as pr, ['{{p}}','Note: {{p}}','<!-- {{p}} -->','[[ {{p}} ]]'][({q.h32('7.f', 'doc_id')} % 4 + 1)::INT] as fr, {q.u('7.p', 'doc_id')} as up,
  substr(text, 1, ({q.h32('7.c', 'doc_id')} % (length(text) + 1))::INT) as hd from documents),
 j as (select c.*, replace(fr, '{{p}}', payload) as p, instr(reverse(hd), case when up < 0.8 then ' .' else chr(10) end) as back from c join rk using (pr)),
 k as (select *, case when back > 0 then length(hd) - back + 1 else 0 end as m from j)
select doc_id, att::INT::BIGINT as label, md5(case when not att then text when up < 0.2 then p || chr(10) || chr(10) || text when up < 0.4 or m = 0 then text || chr(10) || chr(10) || p
 else substr(text, 1, m::INT) || p || case when up < 0.8 then ' ' else chr(10) end || substr(text, (m + 1)::INT) end) as h from k""")
def _(spark, d):
    # first user messages are the payloads, documents the carriers
    pl = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("pid")).agg(F.min_by("text", "turn").alias("payload"))
    r = A.insert_payloads(docs(spark, d, "doc_id", "text"), pl, FRAMES, "doc_id", "pid", seed=7)
    return r.select("doc_id", "label", F.md5("text").alias("h"))


@query("i8_paired_contexts", """with t as (select doc_id, text, substr(text, 20, 60) as att from documents) select doc_id, 1::BIGINT as label, md5(text) as h from t where length(att) > 0
 union all select doc_id, 0, md5(trim(replace(text, att, ''))) from t where length(att) > 0""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").withColumn("att", F.substring("text", 20, 60))
    return A.paired_contexts(t, "text", "att", ["doc_id"]).select("doc_id", "label", F.md5("text").alias("h"))


def _sents(spark, d):
    return explode_rows(docs(spark, d, "doc_id", "lang", "text"), ["doc_id", "lang"], K.sentences("text", 10, 300), "s", "sid")


def _alphabet(spark, d):
    c = P.top_chars(docs(spark, d, "lang", "text"), "text", "lang", 80)
    return c.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ch"))), lambda x: x["ch"]).alias("chars"))


@query("i9_mild_gibberish")
def _(spark, d):
    s = _sents(spark, d).join(_alphabet(spark, d), "lang").withColumn("k", F.concat_ws(".", "doc_id", "sid"))
    g = A.mild_gibberish(F.filter(F.split("s", r"\s+"), lambda x: x != ""), "k", 9, F.col("chars"))
    return pin(s, "g", g).where("g is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("g") / F.length("s")).alias("ratio"))


SENTS = f"st as (select doc_id, lang, unnest(s) as s, unnest(range(0, len(s))) as sid from (select doc_id, lang, {q.sents('text', 10, 300)} as s from documents))"


@query("i10_word_salad", f"""with {SENTS}, rk as (select *, row_number() over (partition by lang order by {q.h32('10.g', 'doc_id', 'sid')}, doc_id, sid) as r from st), g as (select *, ((r - 1) // 3)::BIGINT as grp, [x for x in regexp_split_to_array(s, '{q.WS}+') if x <> ''] as ws from rk),
 w as (select lang, grp, r, unnest(ws) as w, unnest(range(0, len(ws))) as pos from g), o as (select *, row_number() over (partition by lang, grp order by {q.h32('10.o', 'lang', 'grp', 'r', 'pos')}, r, pos) as o, count(*) over (partition by lang, grp) as n from w)
select lang, grp, md5(string_agg(w, ' ' order by o)) as h from o where n >= 3 and o <= 3 + {q.h32('10.n', 'lang', 'grp')} % 14 group by lang, grp""")
def _(spark, d):
    return A.word_salad(_sents(spark, d), "lang", ["doc_id", "sid"], "s", 10).select("lang", "grp", F.md5("text").alias("h"))


@query("i11_noise")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang").join(_alphabet(spark, d), "lang")
    return t.select("doc_id", A.noise("doc_id", F.col("chars"), 11).alias("text"))


@query("i12_gibberish_set")
def _(spark, d):
    g = A.gibberish_set(_sents(spark, d), _alphabet(spark, d), "lang", ["doc_id", "sid"], "s", 12)
    return g.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("chars"))


@query("i13_payment_snippets")
def _(spark, d):
    s = A.payment_snippets(table(spark, d, "customer", "c_custkey", "c_name"), "c_custkey", "c_name", 13)
    return s.select("c_custkey", "text", "split", F.size("spans").alias("n_spans"))


@query("i14_folded_copies", f"""select doc_id, 0::BIGINT as copy, md5(text) as h from documents union all
 select doc_id, 1, md5(strip_accents(replace(text, 'ß', 'ss'))) from documents where {q.u(14, 'doc_id')} < 0.3 and strip_accents(replace(text, 'ß', 'ss')) <> text
 and length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))""")
def _(spark, d):
    return A.folded_copies(docs(spark, d, "doc_id", "text"), "text", "doc_id", 0.3, 14).select("doc_id", "copy", F.md5("text").alias("h"))


@query("i15_no_context_copies", f"""with t as (select c.conv_id * 1000 + c.turn as id, c.text, coalesce(p.text, '') as context from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1)
select id, md5(context) as h, 0::BIGINT as copy from t union all select id, md5(''), 1 from t where {q.u(15, 'id')} < 0.3 and context <> ''""")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    t = c.join(p, ["conv_id", "turn"], "left").fillna({"context": ""}).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "context")
    return A.no_context_copies(t, "context", "id", 0.3, 15).select("id", F.md5("context").alias("h"), "copy")


@query("i16_short_copies", f"""with a as (select doc_id, lang || '_Latn' as label, text as s, {q.h32('16.l', 'doc_id')} % 31 + 10 as n, {q.h32('16.s', 'doc_id')} as hs from documents),
 b as (select *, hs % (greatest(length(s) - n, 0) + 1) as ps from a), c as (select *, substr(s, (ps + 1)::INT, n::INT) as sp from b),
 e as (select *, instr(trim(sp, ' '), ' ') > 0 as spaced from c), f as (select *, case when spaced and ps > 0 then substr(sp, instr(sp, ' ') + 1) else sp end as hd from e), g as (select *, {rfind('hd')} as tl from f),
 o as (select doc_id, label, trim(case when length(s) > n then case when spaced and tl > 5 then substr(hd, 1, tl) else hd end else s end, ' ') as text from g),
 k as (select *, regexp_extract_all(lower(text), '[a-z]+') as w from o where length(text) >= 5)
select min(doc_id) as doc_id, arg_min(label, doc_id) as label, text from k where {_sql_frac(chr(92) + 'p{Latin}', '1.0')} >= 0.5 and not {ENGLISH_SQL} group by text""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "text").withColumn("label", F.concat(F.col("lang"), F.lit("_Latn")))
    return A.short_copies(t, "text", "doc_id", "label", seed=16).select("doc_id", "label", "text")


def _rule_score(t):
    """Share of a few frequent words: a stand-in for a model, so that the report has something to measure."""
    return F.when(t.rlike(r"(?i)(?<!\p{L})(the|la|der|que)(?!\p{L})"), 1.0).otherwise(0.0)


def _flag_sql(x):
    return f"regexp_matches(' ' || regexp_replace(lower({x}), '[^\\p{{L}}]', ' ', 'g') || ' ', ' (the|la|der|que) ')"


ROB_OPS = [op for op in PT.EVAL_OPS]
ROB = " union all ".join([f"select 'clean' as op, toxic as gold, {_flag_sql('text')} as f from t"] + [f"select '{op}', toxic, {_flag_sql(SQL[op])} from t" for op in ROB_OPS])


@query("n11_robustness", f"with t as (select d.text, l.toxic from documents d join labels l using (doc_id)), x as ({ROB}) select op, count(*)::BIGINT as n, round(avg(f::INT) filter (gold = 1), 6) as recall, round(avg(f::INT) filter (gold = 0), 6) as fpr from x group by op")
def _(spark, d):
    return A.robustness(labelled(spark, d, "text"), "text", "toxic", "doc_id", _rule_score, ROB_OPS)
