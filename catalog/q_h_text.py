"""Sentences, passages, text functions, sequence labels, compression."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions import text as X
from glyphmill.functions import units as U
from glyphmill.operators import compress as Z
from glyphmill.operators import joins as C
from glyphmill.operators import metrics as N
from glyphmill.operators import passages as P
from glyphmill.operators import sampling as E
from glyphmill.operators import seqlabel as Q
from glyphmill.session import materialise

from . import query
from . import sqlkit as q
from .common import docs, table
from .q_h_spans import WORDS


@query("h1_sentences", f"select doc_id, md5(s) as h from (select doc_id, unnest({q.sents('text', 15, 300)}) as s from documents)")
def _(spark, d):
    return P.sentence_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], "text", 15, 300).select("doc_id", F.md5("sentence").alias("h"))


def window_sql(seed, kmin, kmax, min_sent):
    return f"""w as (select doc_id, lang, array_to_string(s[({q.h32(f'{seed}.i', 'doc_id')} % len(s) + 1)::INT : ({q.h32(f'{seed}.i', 'doc_id')} % len(s) + {q.h32(f'{seed}.k', 'doc_id')} % {kmax - kmin + 1} + {kmin})::INT], ' ') as t
 from (select doc_id, lang, {q.sents('text', min_sent)} as s from documents) where len(s) > 0)"""


for _tag, _lo, _hi, _kmin, _kmax in (("h2_passages", 120, 1200, 2, 6), ("h2_passages_long", 20, 2000, 1, 8), ("h2_snippets", 1, 400, 1, 3)):
    @query(_tag, f"with {window_sql(3, _kmin, _kmax, 15)} select doc_id, lang, md5(t) as h, length(t)::BIGINT as n from w where length(t) between {_lo} and {_hi}")
    def _(spark, d, _a=(_kmin, _kmax, _lo, _hi)):
        p = P.passages(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", *_a, seed=3)
        return p.select("doc_id", "lang", F.md5("passage").alias("h"), F.length("passage").alias("n"))


@query("h3_chunk_sentences", f"""with recursive s as (select doc_id, {q.sents('text')} as s from documents),
 z as (select doc_id, s, 0::BIGINT as pos, 0::BIGINT as i, ('0x' || substr(md5('3:0:' || doc_id), 1, 8))::BIGINT % 3 + 1 as k from s where len(s) > 0
  union all select doc_id, s, pos + 1, i + k, ('0x' || substr(md5('3:' || (i + k) || ':' || doc_id), 1, 8))::BIGINT % 3 + 1 from z where i + k < len(s))
select doc_id, pos, md5(u) as h from (select doc_id, pos, array_to_string(s[i + 1:i + k], ' ') as u from z) where length(u) between 25 and 600""")
def _(spark, d):
    t = U.explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], U.chunk_sentences(K.sentences("text"), "doc_id", 3), "unit")
    return t.where(F.length("unit").between(25, 600)).select("doc_id", "pos", F.md5("unit").alias("h"))


def rfind(s):
    return f"case when instr(reverse({s}), ' ') = 0 then -1 else length({s}) - instr(reverse({s}), ' ') end"


@query("h4_short_span", f"""with a as (select doc_id, trim(regexp_replace(text, '{q.WS}+', ' ', 'g')) as s, {q.h32('4.l', 'doc_id')} % 46 + 15 as n, {q.h32('4.s', 'doc_id')} as hs from documents),
 b as (select *, hs % (greatest(length(s) - n, 0) + 1) as ps from a), c as (select *, substr(s, (ps + 1)::INT, n::INT) as sp from b),
 e as (select *, instr(trim(sp), ' ') > 0 as spaced from c), f as (select *, case when spaced and ps > 0 then substr(sp, instr(sp, ' ') + 1) else sp end as hd from e),
 g as (select *, {rfind('hd')} as tl from f)
select doc_id, trim(case when length(s) > n then case when spaced and tl > 5 then substr(hd, 1, tl) else hd end else s end) as span from g""")
def _(spark, d):
    flat = F.trim(F.regexp_replace("text", K.WS + "+", " "))
    t = docs(spark, d, "doc_id", "text").select("doc_id", flat.alias("s"))
    return t.select("doc_id", U.short_span("s", "doc_id", 4, 15, 60).alias("span"))


@query("h5_prefix_cut", f"""with a as (select doc_id, {q.strip('text')} as s, {q.h32(5, 'doc_id')} % 21 + 20 as n from documents), b as (select *, substr(s, 1, n::INT) as t from a)
select doc_id, case when length(s) <= n then s when {rfind('t')} >= 10 then substr(t, 1, {rfind('t')}) else t end as prefix from b""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").select("doc_id", K.strip("text").alias("s"))
    return t.select("doc_id", U.prefix_cut("s", "doc_id", 5).alias("prefix"))


@query("h6_lead_passage")
def _(spark, d):
    t = U.pin(docs(spark, d, "doc_id", "text"), "p", U.lead_passage("text", 60, 350))
    return t.where(F.col("p").isNotNull()).select("doc_id", F.md5("p").alias("h"), F.size(F.split("p", r"\s+")).alias("n"))


@query("h7_chunk", f"""with a as (select doc_id, text as t, {q.h32('7.l', 'doc_id')} % 2301 + 200 as n, {q.h32('7.s', 'doc_id')} as hs from documents), b as (select *, hs % (greatest(length(t) - n, 0) + 1) as ps from a),
 c as (select *, instr(substr(t, (ps + 1)::INT, 50), ' ') as bl from b), e as (select *, case when bl > 0 then ps + bl else ps end as st from c)
select doc_id, md5(case when length(t) <= 2500 then t else {q.strip('substr(t, (st + 1)::INT, n::INT)')} end) as h from e""")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(U.chunk("text", "doc_id", 7)).alias("h"))


@query("h8_head_tail", "select doc_id, md5(case when length(text) <= 12000 then text else substr(text, 1, 8000) || '\n[...]\n' || right(text, 4000) end) as h from documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(X.head_tail("text", 8000, 4000)).alias("h"))


@query("h9_windows", r"""with a as (select doc_id, [x for x in regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') if x <> ''] as w from documents)
select doc_id, i::BIGINT as win, md5(array_to_string(w[(i * 32 + 1)::INT : (i * 32 + 128)::INT], ' ')) as h from (select doc_id, w, unnest(range(0, (ceil(greatest(len(w) - 128, 0) / 32.0) + 1)::BIGINT)) as i from a)""")
def _(spark, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = P.window_rows(docs(spark, d, "doc_id", "text").withColumn("w", w), ["doc_id"], "w", 128, 32)
    return t.select("doc_id", F.col("pos").alias("win"), F.md5(F.array_join("window", " ")).alias("h"))


@query("h10_doc_max", f"""with s as (select doc_id, {q.u(10, 'doc_id', 'pos')} as score from (select doc_id, unnest(range(0, 1 + length(text) // 500)) as pos from documents)) select doc_id, round(max(score), 6) as score from s group by doc_id""")
def _(spark, d):
    w = U.explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int")), "w")
    return P.doc_max(w.withColumn("score", K.u(10, "doc_id", "pos")), "doc_id", "score")


@query("h11_strip_end", rf"""with s as (select doc_id, unnest({q.sents('text', 15, 300)}) as s from documents), c as (select doc_id, s, regexp_replace(regexp_replace(s, '(?:{q.WS}|[.!?。！？؟;…:،।։])+$', ''), '^[¿¡]+', '') as t from s)
select doc_id, md5(case when {q.u(11, 's')} < 0.5 then lower(t) else t end) as h from c""")
def _(spark, d):
    s = P.sentence_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], "text", 15, 300)
    return s.select("doc_id", F.md5(P.strip_end("sentence", "sentence", 11)).alias("h"))


@query("h12_is_question", rf"""with s as (select lang, unnest({q.sents('text', 2)}) as s from documents) select lang, count(*)::BIGINT as n, sum(regexp_matches(s, '[?？؟]{q.WS}*$')::INT)::BIGINT as questions from s group by lang""")
def _(spark, d):
    s = P.sentence_rows(docs(spark, d, "lang", "text"), ["lang"], "text", 2)
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(P.is_question("sentence", "lang").cast("int")).alias("questions"))


@query("h13_fold", "select doc_id, md5(strip_accents(replace(text, 'ß', 'ss'))) as h from documents where strip_accents(replace(text, 'ß', 'ss')) <> text")
def _(spark, d):
    t = U.pin(docs(spark, d, "doc_id", "text"), "f", X.fold("text"))
    return t.where("f <> text").select("doc_id", F.md5("f").alias("h"))


@query("h14_decode_obfuscation", "select doc_id, md5(nfc_normalize(text)) as h from documents")
def _(spark, d):
    # every text smuggled as tag characters with zero-width characters in between comes back as it was
    codes = range(0x20, 0x7F)
    tags = F.translate("text", "".join(chr(i) for i in codes), "".join(chr(0xE0000 + i) for i in codes))
    hidden = F.regexp_replace(tags, "(.)", "$1​")
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(X.decode_obfuscation(hidden)).alias("h"))


@query("h15_parse_json", """select event_id, (props->>'k')::BIGINT as k from events where event_id % 3 <> 0""")
def _(spark, d):
    # properties as a fenced answer with chatter around; every third one is broken
    e = table(spark, d, "events", "event_id", "props")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no json: "), F.replace("props", F.lit("}"), F.lit("")))).otherwise(
        F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")))
    return e.select("event_id", X.parse_json_block(raw, "k bigint")["k"].alias("k")).where("k is not null")


@query("h16_json_splice", """select event_id, (props->>'k') || case when event_id % 2 = 0 then ' payload' else '' end as k, case when event_id % 2 = 1 then 'payload' end as note from events""")
def _(spark, d):
    # the payload goes to the existing key or to a new one
    e = table(spark, d, "events", "event_id", "props")
    out = P.json_splice("props", F.when(F.col("event_id") % 2 == 0, "k").otherwise("note"), F.lit("payload"))
    r = e.select("event_id", F.from_json(out, "map<string,string>").alias("m"))
    return r.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("note")).alias("note"))


TPL = ["This is about {}.", "The topic is {}.", "{}"]


@query("h17_hypothesis", f"""with t as (select c_custkey, c_name || '_' || c_mktsegment as label, ['This is about {{}}.', 'The topic is {{}}.', '{{}}'][({q.h32('17.t', 'c_custkey')} % 3 + 1)::INT] as tpl, {q.u('17.s', 'c_custkey')} as us, {q.u('17.l', 'c_custkey')} as ul from customer),
 l as (select *, case when us < 0.8 then replace(label, '_', ' ') else label end as l1 from t)
select c_custkey, replace(tpl, '{{}}', case when ul < 0.5 then lower(l1) else l1 end) as hyp from l""")
def _(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").withColumn("label", F.concat_ws("_", "c_name", "c_mktsegment"))
    return c.select("c_custkey", P.hypothesis("label", TPL, "c_custkey", 17).alias("hyp"))


@query("h39_lower_keep_len", "select doc_id, md5(lower(text)) as h from documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(X.lower_keep_len("text")).alias("h"))


@query("h44_strip_p", rf"with {WORDS} select doc_id, count(*)::BIGINT as n, sum(length(regexp_replace(tok, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g')))::BIGINT as chars from words group by doc_id")
def _(spark, d):
    w = U.explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], F.filter(F.split("text", r"\s+"), lambda x: x != ""), "w")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(X.strip_p("w"))).alias("chars"))


@query("h48_drop_sentence", f"""with s as (select doc_id, {q.sents('text')} as s from documents), k as (select *, ({q.h32(48, 'doc_id')} % len(s))::INT as k from s where len(s) >= 3)
select doc_id, md5(array_to_string(s[1:k] || s[k + 2:], ' ')) as h, md5(s[k + 1]) as dropped from k""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").select("doc_id", K.sentences("text").alias("s")).where(F.size("s") >= 3)
    t = t.withColumn("k", K.pick(48, "doc_id", F.size("s")).cast("int"))
    return t.select("doc_id", F.md5(F.array_join(P.drop_sentence("s", "k"), " ")).alias("h"), F.md5(F.get("s", "k")).alias("dropped"))


@query("h48_sole_owner", f"""with s as (select doc_id, source, unnest(list_distinct({q.sents('text', 20)})) as s from documents) select source, md5(s) as fact, min(doc_id) as doc_id from s group by source, s having count(*) = 1""")
def _(spark, d):
    # facts that only one document of a source states
    s = U.explode_rows(docs(spark, d, "doc_id", "source", "text"), ["doc_id", "source"], F.array_distinct(K.sentences("text", 20)), "s")
    return P.sole_owner(s.withColumn("fact", F.md5("s")), ["source", "fact"], "doc_id")


@query("h49_concat_ctx", "select c.conv_id, c.turn, md5(s.text || chr(10) || chr(10) || c.text) as h from conversations c join conversations s on s.conv_id = c.conv_id and s.turn = 0 where c.turn > 0")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    s = c.where("turn = 0").select("conv_id", F.col("text").alias("task"))
    return c.where("turn > 0").join(s, "conv_id").select("conv_id", "turn", F.md5(F.concat_ws("\n\n", "task", "text")).alias("h"))


@query("h50_paragraph_runs", """with t as (select *, (lag(role) over w is distinct from role)::INT as chg from conversations window w as (partition by conv_id order by turn)), g as (select *, sum(chg) over (partition by conv_id order by turn) as run from t)
select conv_id, run::BIGINT as run, count(*)::BIGINT as n, md5(string_agg(text, ' ' order by turn)) as h from g group by conv_id, run""")
def _(spark, d):
    # consecutive turns of one role become one paragraph
    r = E.run_ids(table(spark, d, "conversations"), ["conv_id"], "turn", ["role"])
    return P.join_runs(r, ["conv_id", "run"], "turn", "text", block=2).select("conv_id", "run", "n", F.md5("text").alias("h"))


@query("h51_extract_blocks", r"""select distinct page_id, trim(b) as block from (select page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) as b from pages) where length(b) > 15""")
def _(spark, d):
    return P.extract_blocks(table(spark, d, "pages", "page_id", "html"), ["page_id"], "html", r"(?s)<li>(.*?)</li>", 15)


@query("h52_units", f"with {WORDS} select doc_id, count(*)::BIGINT as n, sum(s)::BIGINT as starts, sum(e)::BIGINT as ends from words group by doc_id")
def _(spark, d):
    w = U.explode_rows(docs(spark, d, "doc_id", "lang", "text"), ["doc_id"], U.word_units("text", "lang"), "x")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x.start").alias("starts"), F.sum("x.end").alias("ends"))


@query("h53_prefix", "select item_id, 'query: ' || text as text from benchmark union all select doc_id, 'passage: ' || text from documents")
def _(spark, d):
    a = table(spark, d, "benchmark").select("item_id", P.prefix("text", "query: ").alias("text"))
    return a.union(docs(spark, d, "doc_id", "text").select("doc_id", P.prefix("text", "passage: ").alias("text")))


# ---- punctuation and casing ---------------------------------------------------------------------------------------------

def _unit_docs(spark, d):
    """Sentences of the corpus as punctuation units (each with a number of its own)."""
    s = U.explode_rows(docs(spark, d, "doc_id", "lang", "text"), ["doc_id", "lang"], K.sentences("text", 30), "sent", "sid")
    return Q.punct_units(s, "sent", "lang")


@query("h36_punct_units")
def _(spark, d):
    t = _unit_docs(spark, d)
    return t.select("doc_id", "sid", F.size("units").alias("n"), F.array_join("units.lab", "").alias("labs"), F.md5(F.array_join("units.word", " ")).alias("h"))


@query("h36_label_counts", rf"""with s as (select doc_id, unnest({q.sents('text', 30)}) as s from documents), w as (select unnest([x for x in regexp_split_to_array(s, '{q.WS}+') if x <> '']) as w from s),
 c as (select w, regexp_extract(w, '([^\p{{L}}\p{{N}}]*)$', 1) as run from w)
select case when regexp_matches(run, '[?？؟]') then '?' when regexp_matches(run, '[.!;…。！।]') then '.' when regexp_matches(run, '[:：]') then ':' when regexp_matches(run, '[,，、،]') then ',' else '0' end as lab, count(*)::BIGINT as n
from c where regexp_matches(w, '[\p{{L}}\p{{N}}]') group by 1""")
def _(spark, d):
    # labels over all sentences; abbreviations and free marks do not occur in this corpus
    return U.explode_rows(_unit_docs(spark, d), [], "units", "x").where(F.col("x.word").rlike(r"[\p{L}\p{N}]")).groupBy(F.col("x.lab").alias("lab")).agg(F.count(F.lit(1)).alias("n"))


@query("h37_unit_windows")
def _(spark, d):
    t = Q.punct_units(docs(spark, d, "doc_id", "lang", "text"), "text", "lang")
    w = Q.unit_windows(t, "doc_id", "units", "lang")
    return w.select("doc_id", "window", F.size("ends").alias("n"), F.element_at("ends", -1).alias("last_end"), F.length("text_w").alias("chars"))


@query("h38_restore", rf"""with s as (select doc_id, unnest({q.sents('text', 30)}) as s from documents), v as (select doc_id, s from s where not regexp_matches(s, '[!;:…()\"]|[.,][^\s]|\s-|[^\p{{L}}\p{{N}}\s.,?]'))
select doc_id, md5(trim(regexp_replace(s, '{q.WS}+', ' ', 'g'))) as h from v""")
def _(spark, d):
    # restoring the units of plain sentences gives the sentence back
    t = _unit_docs(spark, d).where(~F.col("sent").rlike(r'[!;:…()"]|[.,][^\s]|\s-|[^\p{L}\p{N}\s.,?]'))
    return t.select("doc_id", F.md5(Q.restore("units", "lang")).alias("h"))


def _held(c):
    """Points, commas and colons between digits as private characters; a digit may stand between two of them."""
    for mark, held in ((r"\.", "\ue000"), (",", "\ue001"), (":", "\ue002")):
        for _ in range(2):
            c = rf"regexp_replace({c}, '(\p{{Nd}}){mark}(\p{{Nd}})', '\1{held}\2', 'g')"
    return c


_BARE = f"translate(regexp_replace({_held('text')}, '[{Q._OTHER.replace(chr(39), chr(39) * 2)}.,:{Q.DROPPED}]', '', 'g'), '\ue000\ue001\ue002', '.,:')"


@query("h40_strip_marks_text", f"select doc_id, length(t)::BIGINT as n, md5(t) as h from (select doc_id, {_BARE} as t from documents)")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.length(Q.strip_marks_text("text")).alias("n"), F.md5(Q.strip_marks_text("text")).alias("h"))


CASE_SQL = r"""case when length(regexp_replace(tok, '[^\p{Lu}\p{Ll}\p{Lt}]', '', 'g')) >= 2 and regexp_matches(regexp_replace(tok, '[^\p{Lu}\p{Ll}\p{Lt}]', '', 'g'), '^\p{Lu}+$') then 2
 when regexp_matches(regexp_replace(tok, '[^\p{Lu}\p{Ll}\p{Lt}]', '', 'g'), '^\p{Lu}') then 1 else 0 end"""


@query("h41_case_of", f"with {WORDS} select doc_id, ({CASE_SQL})::BIGINT as k, count(*)::BIGINT as n from words group by all")
def _(spark, d):
    w = U.explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], F.filter(F.split("text", r"\s+"), lambda x: x != ""), "w")
    return w.groupBy("doc_id", Q.case_of("w").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("h41_apply_case", rf"""with {WORDS}, k as (select doc_id, tok, {CASE_SQL} as k from words) select doc_id, count(*)::BIGINT as n, sum((case k when 2 then upper(lower(tok)) = tok when 1 then lower(tok) <> tok else lower(tok) = tok end)::INT)::BIGINT as same from k
 where not (k = 0 and lower(tok) <> tok) and not (k = 1 and length(regexp_replace(tok, '[^\p{{Lu}}]', '', 'g')) > 1) group by doc_id""")
def _(spark, d):
    # lower-casing a word and applying its class again gives the word back, for words in one of the three shapes
    w = U.explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], F.filter(F.split("text", r"\s+"), lambda x: x != ""), "w").withColumn("k", Q.case_of("w"))
    w = w.where(~((F.col("k") == 0) & (F.lower("w") != F.col("w"))) & ~((F.col("k") == 1) & (F.length(F.regexp_replace("w", r"[^\p{Lu}]", "")) > 1)))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((Q.apply_case(F.lower("w"), F.col("k")) == F.col("w")).cast("int")).alias("same"))


def _unit_rows(spark, d):
    t = Q.punct_units(docs(spark, d, "doc_id", "lang", "text"), "text", "lang")
    # the window over a document's units finds them together
    return U.explode_rows(Q.deal_units(t.select("doc_id", "lang", "units"), "units", ["doc_id"]), ["doc_id", "lang"], "units", "x").select("doc_id", "lang", "pos", "x.word", "x.lab")


@query("h42_rule_case")
def _(spark, d):
    r = Q.rule_case(_unit_rows(spark, d), "doc_id", "pos", "word", "lab", "lang").withColumn("gold", Q.case_of("word"))
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("case").alias("caps"), F.avg((F.col("case") == F.col("gold")).cast("int")).alias("acc"))


def _probabilities(spark, d):
    """Hashed mark and case probabilities per unit, favouring the gold label."""
    r = _unit_rows(spark, d)
    m = F.map_from_arrays(F.array(*[F.lit(l) for l in Q.LABELS]), F.array(*[K.u(f"m{i}", "doc_id", "pos") * 0.6 + (F.col("lab") == l).cast("int") * 0.4 for i, l in enumerate(Q.LABELS)]))
    c = F.array(*[K.u(f"c{i}", "doc_id", "pos") * 0.6 + (Q.case_of("word") == i).cast("int") * 0.4 for i in range(3)])
    return r.withColumn("marks", m).withColumn("cases", c).withColumn("gc", Q.case_of("word"))


@query("j12_decode_boundary")
def _(spark, d):
    r = Q.decode_boundary(_probabilities(spark, d), "doc_id", "pos", "marks", "cases", 0.5)
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pm") == F.col("lab")).cast("int")).alias("mark_acc"), F.avg((F.col("pc") == F.col("gc")).cast("int")).alias("case_acc"))


@query("n13_boundary_events")
def _(spark, d):
    r = Q.decode_boundary(_probabilities(spark, d), "doc_id", "pos", "marks", "cases", 1.0)
    return Q.boundary_events(r, "doc_id", "pos", "pm", "pc", "lab", "gc", ["lang"])


# words with the mark at their end as units: the same operators where SQL can follow
UW = f"""uw as (select doc_id, i - 1 as pos, case when right(tok, 1) in ('.', '?', ',') then right(tok, 1) else '0' end as lab, case when right(tok, 1) in ('.', '?', ',') and length(tok) > 1 then substr(tok, 1, length(tok) - 1) else tok end as word from words),
 un as (select uw.*, d.lang, {CASE_SQL.replace('tok', 'word')} as gc, regexp_matches(word, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') as cased from uw join documents d using (doc_id)),
 rc as (select *, case when (coalesce(last_value(case when cased or lab in ('.', '?') then lab in ('.', '?') end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), true) and cased) or (lang = 'en' and word = 'i') then 1 else 0 end as k from un)"""


def _word_units(spark, d):
    w = U.explode_rows(docs(spark, d, "doc_id", "lang", "text"), ["doc_id", "lang"], F.filter(F.split("text", r"\s+"), lambda x: x != ""), "w", by=["doc_id"])
    end = F.substring("w", -1, 1)
    marked = end.isin(".", "?", ",")
    word = F.when(marked & (F.length("w") > 1), F.substring(F.col("w"), F.lit(1), F.length("w") - 1)).otherwise(F.col("w"))
    return w.select("doc_id", "lang", "pos", word.alias("word"), F.when(marked, end).otherwise("0").alias("lab"))


@query("h42_rule_case_words", f"with {WORDS}, {UW} select lang, count(*)::BIGINT as n, sum(k)::BIGINT as caps, round(avg((k = gc)::INT), 6) as acc from rc group by lang")
def _(spark, d):
    r = Q.rule_case(_word_units(spark, d), "doc_id", "pos", "word", "lab", "lang").withColumn("gold", Q.case_of("word"))
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("case").alias("caps"), F.avg((F.col("case") == F.col("gold")).cast("int")).alias("acc"))


@query("n12_case_metrics", f"""with {WORDS}, {UW}, c as (select lang, count(*) as n, sum((k = gc)::INT) as ok, sum((k = gc and gc <> 0)::INT) as tp, sum((k <> 0)::INT) as pp, sum((gc <> 0)::INT) as gg from rc group by lang)
select lang, n::BIGINT as n, round(ok / n, 6) as acc, round(case when tp = 0 then 0 else 2 * tp / (pp + gg) end, 6) as f1 from c""")
def _(spark, d):
    # F1 of the exact casing class over words that aren't lower case in gold or prediction
    r = Q.rule_case(_word_units(spark, d), "doc_id", "pos", "word", "lab", "lang")
    return N.mark_metrics(r.select("lang", Q.case_of("word").cast("string").alias("g"), F.col("case").cast("string").alias("p")), "g", "p", ["lang"])


def _decode_sql(beta):
    m = ", ".join(f"{q.u(f'm{i}', 'doc_id', 'pos')} * 0.6 + (lab = '{l}')::INT * 0.4 as m{i}" for i, l in enumerate(Q.LABELS))
    c = ", ".join(f"{q.u(f'c{i}', 'doc_id', 'pos')} * 0.6 + (gc = {i})::INT * 0.4 as c{i}" for i in range(3))
    at = {l: f"m{i}" for i, l in enumerate(Q.LABELS)}
    labels, ms = "[" + ", ".join(f"'{l}'" for l in Q.LABELS) + "]", "[" + ", ".join(f"m{i}" for i in range(len(Q.LABELS))) + "]"
    return f"""pr as (select *, {m}, {c} from un), am as (select *, {labels}[list_position({ms}, list_max({ms}))] as pm, list_position([c0, c1, c2], greatest(c0, c1, c2)) - 1 as pc from pr),
 ld as (select *, lead(c0) over w as n0, lead(c1) over w as n1, lead(pc) over w as np, {at[',']} as mc, greatest({at['.']}, {at['?']}) as ms, case when {at['.']} >= {at['?']} then '.' else '?' end as stop from am window w as (partition by doc_id order by pos)),
 td as (select *, case when pm = ',' and np = 1 and ms * n1 >= mc * n1 * {beta} and ms * n1 >= mc * n0 then 'break' when pm = ',' and np = 1 and mc * n0 > mc * n1 * {beta} then 'lower' end as todo from ld),
 dc as (select doc_id, lang, pos, lab, gc, case when todo = 'break' then stop else pm end as pm, case when lag(todo) over (partition by doc_id order by pos) = 'lower' then 0 else pc end as pc from td)"""


def _word_probabilities(spark, d):
    r = _word_units(spark, d)
    m = F.map_from_arrays(F.array(*[F.lit(l) for l in Q.LABELS]), F.array(*[K.u(f"m{i}", "doc_id", "pos") * 0.6 + (F.col("lab") == l).cast("int") * 0.4 for i, l in enumerate(Q.LABELS)]))
    c = F.array(*[K.u(f"c{i}", "doc_id", "pos") * 0.6 + (Q.case_of("word") == i).cast("int") * 0.4 for i in range(3)])
    return r.withColumn("marks", m).withColumn("cases", c).withColumn("gc", Q.case_of("word"))


@query("j12_decode_words", f"with {WORDS}, {UW}, {_decode_sql(0.5)} select lang, count(*)::BIGINT as n, round(avg((pm = lab)::INT), 6) as mark_acc, round(avg((pc = gc)::INT), 6) as case_acc from dc group by lang")
def _(spark, d):
    r = Q.decode_boundary(_word_probabilities(spark, d), "doc_id", "pos", "marks", "cases", 0.5)
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pm") == F.col("lab")).cast("int")).alias("mark_acc"), F.avg((F.col("pc") == F.col("gc")).cast("int")).alias("case_acc"))


@query("n13_boundary_words", f"""with {WORDS}, {UW}, {_decode_sql(1.0)}, nx as (select *, lead(pc) over w as npc, lead(gc) over w as ngc from dc window w as (partition by doc_id order by pos)),
 kd as (select lang, case when pm = ',' and npc = 1 then case when lab in ('.', '?') and ngc = 1 then 'b' when ngc = 1 then 'c' when ngc = 0 then 'l' else 'o' end end as k from nx)
select lang, count(*)::BIGINT as words, count(k)::BIGINT as total, count(*) filter (k = 'b')::BIGINT as gold_sentence_break, count(*) filter (k = 'c')::BIGINT as gold_comma_cap, count(*) filter (k = 'l')::BIGINT as gold_lower, count(*) filter (k = 'o')::BIGINT as other from kd group by lang""")
def _(spark, d):
    r = Q.decode_boundary(_word_probabilities(spark, d), "doc_id", "pos", "marks", "cases", 1.0)
    return Q.boundary_events(r, "doc_id", "pos", "pm", "pc", "lab", "gc", ["lang"])


@query("i17_lowercase_share", f"select doc_id, md5(case when {q.u(17, 'doc_id')} < 0.5 then lower(text) else text end) as h from documents")
def _(spark, d):
    return Q.lowercase_share(docs(spark, d, "doc_id", "text"), "text", 0.5, 17, "doc_id").select("doc_id", F.md5("text").alias("h"))


# ---- compression ----------------------------------------------------------------------------------------------------------

TOP = f"""{WORDS}, sc as (select doc_id, i, tok, s, e, {{k}} as g, {q.u(2, "{kk}", 'i - 1')} as sc from words {{j}}), rk as (select *, row_number() over (partition by doc_id, g order by sc desc, i) as r, count(*) over (partition by doc_id, g) as n from sc),
 kp as (select * from rk where r <= greatest(1, round_even(0.3 * n, 0)))"""


@query("g2_top_units", f"with {TOP.format(k='0', kk='doc_id', j='')} select doc_id, count(*)::BIGINT as n_kept, md5(string_agg(tok, ' ' order by i)) as h from kp group by doc_id")
def _(spark, d):
    r = Z.compress_random(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", 0.3, "lang", seed=2).where("n_units > 0")
    return r.select("doc_id", "n_kept", F.md5("context").alias("h"))


PARA = r"""pl as (select doc_id, unnest(regexp_split_to_array(text, '\n[ \t\n\x0B\f\r]*\n')) as t, unnest(range(0, len(regexp_split_to_array(text, '\n[ \t\n\x0B\f\r]*\n')))) as para from documents),
 pw as (select doc_id, para, [x for x in regexp_split_to_array(t, '[ \t\n\x0B\f\r]+') if x <> ''] as m from pl), un as (select doc_id, para, unnest(range(0, len(m))) as i, unnest(m) as tok from pw)"""


@query("g3_top_units_by_paragraph", f"""with {PARA}, sc as (select *, {q.u(2, "doc_id || '.' || para", 'i')} as sc from un), rk as (select *, row_number() over (partition by doc_id, para order by sc desc, i) as r, count(*) over (partition by doc_id, para) as n from sc)
select doc_id, count(*)::BIGINT as n_kept, md5(string_agg(tok, ' ' order by para, i)) as h from rk where r <= greatest(1, round_even(0.3 * n, 0)) group by doc_id""")
def _(spark, d):
    r = Z.compress_random(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", 0.3, "lang", seed=2, by_paragraph=True).where("n_units > 0")
    return r.select("doc_id", "n_kept", F.md5("context").alias("h"))


def _compressed(spark, d):
    """A text and its compressed form: the same with three words in ten left out."""
    t = docs(spark, d, "doc_id", "lang", "text")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    out = F.array_join(F.filter(words, lambda x: K.u(43, "doc_id", x) >= 0.3), " ")
    return t.withColumn("out", out)


@query("h43_align_units", rf"""with w as (select doc_id, unnest([x for x in regexp_split_to_array(text, '{q.WS}+') if x <> '']) as w from documents)
select doc_id, count(*)::BIGINT as n_units, sum(({q.u(43, 'doc_id', 'w')} >= 0.3)::INT)::BIGINT as n_out from w group by doc_id""")
def _(spark, d):
    # the SQL twin checks sizes; tests/ compare kept units with a direct computation
    return Z.align_units(_compressed(spark, d), "text", "out", "lang").where("n_units > 0").select("doc_id", "n_units", "n_out")


@query("h43_align_quality")
def _(spark, d):
    a = Z.align_units(_compressed(spark, d), "text", "out", "lang").where("n_units > 0")
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("faithful").alias("faithful"), F.avg("kept").alias("kept"))


@query("h45_join_kept", rf"""with {WORDS} select doc_id, md5(string_agg(tok, ' ' order by i)) as h from words where i % 2 = 1 group by doc_id""")
def _(spark, d):
    t = U.pin(docs(spark, d, "doc_id", "lang", "text"), "units", U.word_units("text", "lang"))
    t = t.withColumn("kept", F.filter("units", lambda x, i: i % 2 == 0))
    return t.where(F.size("kept") > 0).select("doc_id", F.md5(Z.join_kept("text", "kept")).alias("h"))


@query("h46_compress_rate", f"with {TOP.format(k='0', kk='doc_id', j='')}, a as (select doc_id, count(*) as n from words group by doc_id), b as (select doc_id, count(*) as k from kp group by doc_id) select d.lang, round(avg(b.k / a.n), 6) as kept_units from a join b using (doc_id) join documents d using (doc_id) group by d.lang")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "text")
    r = Z.compress_random(t, "doc_id", "text", 0.3, "lang", seed=2).where("n_units > 0")
    return r.join(t.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg(F.col("n_kept") / F.col("n_units")).alias("kept_units"))


def _asr(spark, d):
    """Words of every sentence and a degraded copy with dropped and changed words."""
    s = U.explode_rows(docs(spark, d, "doc_id", "lang", "text"), ["doc_id", "lang"], K.sentences("text", 30), "sent", "sid")
    s = U.pin(s, "gold", F.filter(F.split("sent", r"\s+"), lambda x: x != ""))
    drawn = F.transform("gold", lambda x, i: F.struct(x.alias("w"), K.u(47, "doc_id", "sid", i).alias("r")))
    asr = F.filter(F.transform(drawn, lambda x: F.when(x["r"] < 0.1, "").when(x["r"] < 0.2, F.concat(x["w"], F.lit("x"))).otherwise(x["w"])), lambda x: x != "")
    return materialise(U.pin(s, "asr", asr).select("doc_id", "lang", "sid", "gold", "asr"))  # two or three tables read it


@query("h47_align_words")
def _(spark, d):
    t = _asr(spark, d)
    a = Z.align_words(t, ["doc_id", "sid"], "gold", "asr")
    n = t.select("doc_id", "sid", "lang", F.size("gold").alias("n_gold"))
    c = a.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("aligned"))
    return n.join(c, ["doc_id", "sid"], "left").na.fill(0).groupBy("lang").agg(F.sum("n_gold").alias("n_gold"), F.sum("aligned").alias("aligned"))


@query("j16_transfer_labels")
def _(spark, d):
    # labels of the degraded words (the mark they end with) carried to the original words
    t, key = _asr(spark, d), ["doc_id", "sid"]
    a = Z.align_words(t, key, "gold", "asr", by=key)
    # marks are taken in the arrays, so that they move by key instead of the words
    marks = lambda words: F.transform(words, lambda w: F.when(w.rlike(r"\.$"), ".").when(w.rlike(",$"), ",").otherwise("0"))
    labels = U.explode_rows(t.select(*key, marks("asr").alias("w")), key, "w", "label", "b_pos", by=key)
    words = U.explode_rows(t.select(*key, marks("gold").alias("w")), key, "w", "own", "a_pos", by=key)
    r = Z.transfer_labels(words, a, labels, key)
    return r.groupBy("own", "label").agg(F.count(F.lit(1)).alias("n"))


QA = rf"""qa as (select conv_id, turn, lower(text) as pred, [lower(substr(text, 20)), lower(substr(text, 1, length(text) // 2))] as ans from conversations),
 x as (select conv_id, turn, pred, unnest(ans) as an, unnest([0, 1]) as a from qa), tk as (select conv_id, turn, a, [t for t in regexp_split_to_array(regexp_replace(pred, '[\p{{P}}\p{{S}}]', ' ', 'g'), '{q.WS}+') if t not in ('', 'a', 'an', 'the')] as p,
 [t for t in regexp_split_to_array(regexp_replace(an, '[\p{{P}}\p{{S}}]', ' ', 'g'), '{q.WS}+') if t not in ('', 'a', 'an', 'the')] as g from x),
 pc as (select conv_id, turn, a, t, count(*) as n from (select conv_id, turn, a, unnest(p) as t from tk) group by all), gc as (select conv_id, turn, a, t, count(*) as n from (select conv_id, turn, a, unnest(g) as t from tk) group by all),
 ov as (select conv_id, turn, a, sum(least(pc.n, gc.n)) as o from pc join gc using (conv_id, turn, a, t) group by all),
 f as (select tk.conv_id, tk.turn, case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::INT else 2 * coalesce(o, 0) / (len(p) + len(g)) end as f1, (p = g)::INT as em from tk left join ov using (conv_id, turn, a)),
 qf as (select conv_id, turn, max(f1) as f1, max(em) as em from f group by all)"""


def _qa(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    # the prediction is the whole turn, the answers are all but its beginning and its first half
    part = lambda a, n: F.lower(F.col("text").substr(F.lit(a), n))
    n = F.length("text")
    return c.select(F.struct("conv_id", "turn").alias("qid"), "role", F.lower("text").alias("pred"), F.array(part(20, n), part(1, F.floor(n / 2).cast("int"))).alias("ans"))


@query("n18_qa_f1", f"with {QA} select conv_id, turn, round(f1, 6) as f1, em::BIGINT as em from qf")
def _(spark, d):
    return Z.qa_f1(_qa(spark, d), "qid", "pred", "ans").select("qid.conv_id", "qid.turn", "f1", "em")


@query("n19_qa_summary", f"with {QA}, l as (select role, conv_id % 3 as lang, avg(f1) as v from qf join conversations using (conv_id, turn) group by all) select role, round(avg(v), 6) as f1, count(*)::BIGINT as n_langs from l group by role")
def _(spark, d):
    t = _qa(spark, d)
    s = Z.qa_f1(t, "qid", "pred", "ans").join(t.select("qid", "role"), "qid").withColumn("lang", F.col("qid.conv_id") % 3)
    return Z.qa_summary(s, ["role"], "lang", "f1")


@query("n23_topk_overlap", f"""with {WORDS}, g as (select doc_id, i, (length(tok) >= 6)::INT as keep, {q.u(23, 'doc_id', 'i - 1')} + (length(tok) >= 6)::INT * 0.3 as sc from words), r as (select *, row_number() over (partition by doc_id order by sc desc, i) as rk, sum(keep) over (partition by doc_id) as k from g)
select doc_id, max(k)::BIGINT as k, round(case when max(k) = 0 then 0 else sum(case when rk <= k then keep else 0 end) / max(k) end, 6) as f1 from r group by doc_id""")
def _(spark, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = docs(spark, d, "doc_id", "text").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    long_ = lambda x: (F.length(x) >= 6).cast("int")
    t = t.select("doc_id", F.transform("w", long_).alias("keep"), F.transform("w", lambda x, i: K.u(23, "doc_id", i) + long_(x) * 0.3).alias("sc"))
    return Z.topk_overlap(t, "keep", "sc").select("doc_id", "k", "f1")
