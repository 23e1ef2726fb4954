"""Joins: decontamination, merges, lookups, ranking rows, contexts, span overlap."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import dedup as D
from glyphmill.operators import joins as C

from . import query
from . import sqlkit as q
from .common import PREDS, docs, labelled, predictions, table


def _bench_plus(spark, d):
    """Evaluation texts: benchmark items, and for whole-text hits the upper-cased text of every 40th page-sized document."""
    b = table(spark, d, "benchmark", "text")
    return b.unionByName(docs(spark, d, "doc_id", "text").where("doc_id % 40 = 0").select(F.upper("text").alias("text")))


EVALS = "ev as (select text from benchmark union all select upper(text) from documents where doc_id % 40 = 0)"
EVK = f"evk as (select distinct {q.k1('text')} as k from ev)"


@query("c1_decontaminate_text", f"with {EVALS}, {EVK} select doc_id, lang from documents where {q.k1('text')} not in (select k from evk)")
def _(spark, d):
    return D.decontaminate(docs(spark, d, "doc_id", "lang", "text"), "text", _bench_plus(spark, d)).drop("text")


PAIRS = """p as (select c.conv_id, c.turn, c.text, coalesce(e.text, '') as text_pair from conversations c left join conversations e on e.conv_id = c.conv_id and e.turn = c.turn + 1),
 pe as (select text from conversations where conv_id % 9 = 0 and turn = 1)"""


def _pairs(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    e = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_pair"))
    return c.join(e, ["conv_id", "turn"], "left").fillna({"text_pair": ""})


@query("c2_decontaminate_pair", f"""with {PAIRS}, k as (select distinct {q.k1('text')} as k from pe)
select conv_id, turn from p where {q.k1('text')} not in (select k from k) and (text_pair = '' or {q.k1('text_pair')} not in (select k from k))""")
def _(spark, d):
    ev = table(spark, d, "conversations").where("conv_id % 9 = 0 and turn = 1")
    return D.decontaminate_pair(_pairs(spark, d), "text", "text_pair", ev).select("conv_id", "turn")


def sentence_hit_sql(min_len, key=q.k1):
    return f"""es as (select unnest({q.sents('text')}) as s from benchmark union all select text from benchmark),
 ek as (select distinct {key('s')} as k from es where length(s) > {min_len}),
 ds as (select doc_id, unnest({q.sents('text')}) as s from documents),
 hits as (select distinct doc_id from ds where length(s) > {min_len} and {key('s')} in (select k from ek))"""


for _n in (25, 40):
    @query(f"c3_decontaminate_sentences_{_n}", f"with {sentence_hit_sql(_n)} select doc_id, lang from documents where doc_id not in (select doc_id from hits)")
    def _(spark, d, _n=_n):
        return D.decontaminate_sentences(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", table(spark, d, "benchmark"), min_len=_n).select("doc_id", "lang")


@query("c4_decontaminate_samples", f"""with s as (select doc_id, {q.sents('text', 15)} as ss from documents),
 t as (select doc_id, ss[({q.h32(2, 'doc_id')} % len(ss) + 1)::INT : ({q.h32(2, 'doc_id')} % len(ss) + 2)::INT] as w from s where len(ss) > 0),
 bad as (select distinct {q.k2('s')} as k from (select unnest({q.sents('text')}) as s from benchmark union all select text from benchmark))
select doc_id, array_to_string(w, ' ') as sample from t
where {q.k2("array_to_string(w, ' ')")} not in (select k from bad) and doc_id not in (select doc_id from (select doc_id, unnest(w) as x from t) where {q.k2('x')} in (select k from bad))""")
def _(spark, d):
    # two consecutive sentences per document; dropped when the sample or one of its sentences is in the evaluation set
    s = docs(spark, d, "doc_id", "text").select("doc_id", K.sentences("text", 15).alias("ss")).where(F.size("ss") > 0)
    t = s.select("doc_id", F.slice("ss", (K.pick(2, "doc_id", F.size("ss")) + 1).cast("int"), F.lit(2)).alias("w"))
    t = t.select("doc_id", F.array_join("w", " ").alias("sample"), "w")
    b = table(spark, d, "benchmark", "text")
    ek = b.select(F.explode(K.sentences("text")).alias("s")).union(b).select(D._digest([K.norm_ws("s")]).alias("_k")).distinct()
    cand = t.select("doc_id", F.explode(F.concat(F.array("sample"), "w")).alias("s")).select("doc_id", D._digest([K.norm_ws("s")]).alias("_k"))
    bad = cand.join(ek, "_k", "left_semi").select("doc_id").distinct()
    return t.join(bad, "doc_id", "left_anti").select("doc_id", "sample")


@query("c5_overlap_report", f"with {EVALS}, {EVK} select count(*)::BIGINT as n, sum(({q.k1('text')} in (select k from evk))::INT)::BIGINT as overlap from documents")
def _(spark, d):
    return D.overlap_report(docs(spark, d, "text"), _bench_plus(spark, d), "text", "text")


@query("c6_merge_new", f"""with {EVALS}, {EVK}, old as (select doc_id, text from documents where doc_id % 2 = 0), new as (select doc_id, text from documents where doc_id % 2 = 1)
select doc_id, 'old' as part from old union all select doc_id, 'new' from new where {q.k1('text')} not in (select k from evk) and {q.k1('text')} not in (select {q.k1('text')} from old)""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text")
    old, new = t.where("doc_id % 2 = 0").withColumn("part", F.lit("old")), t.where("doc_id % 2 = 1").withColumn("part", F.lit("new"))
    return D.merge_new(old, new, _bench_plus(spark, d)).select("doc_id", "part")


@query("c7_unseen_prompts", f"select conv_id, turn from conversations where conv_id % 4 = 0 and {q.k1('text')} not in (select {q.k1('text')} from conversations where conv_id % 4 <> 0)")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return D.unseen(c.where("conv_id % 4 = 0"), c.where("conv_id % 4 <> 0"), "text", "text").select("conv_id", "turn")


@query("c8_lookup", "select d.doc_id, d.lang, coalesce(l.quality, -1)::BIGINT as quality from documents d left join labels l using (doc_id)")
def _(spark, d):
    return D.lookup(docs(spark, d, "doc_id", "lang"), table(spark, d, "labels", "doc_id", "quality"), "doc_id").fillna({"quality": -1})


@query("c9_ranking_rows", f"""with qs as (select doc_id as qid, lang, text as query from documents where doc_id in (select doc_id from labels)),
 cand as (select qs.qid, j as pos, (({q.h32(4, 'qs.qid')} + j * 37) % (select max(doc_id) + 1 from documents))::BIGINT as cid from qs, range(8) r(j)),
 x as (select c.qid, c.pos, c.cid, case when dd.lang = qs.lang then 1 else 0 end as rel, dd.text as doc from cand c join documents dd on dd.doc_id = c.cid join qs on qs.qid = c.qid)
select qid, md5(any_value(qs.query)) as query_h, string_agg(cid::VARCHAR, ',' order by pos) as cids, string_agg(rel::VARCHAR, ',' order by pos) as rels, md5(string_agg(doc, '|' order by pos)) as docs_h
from x join qs using (qid) group by qid having max(rel) = 1 and min(rel) = 0""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "text")
    qs = t.join(table(spark, d, "labels", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), "lang", F.col("text").alias("query"))
    n = t.agg((F.max("doc_id") + 1).alias("n"))
    top = qs.crossJoin(n).select("qid", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.pmod(K.h32(4, "qid") + j * 37, F.col("n"))).alias("cands"))
    corpus = t.select(F.col("doc_id").alias("cid"), F.col("text").alias("doc"))
    langs = t.select(F.col("doc_id").alias("cid"), F.col("lang").alias("clang"))
    qrels = top.select("qid", F.explode("cands").alias("cid")).distinct().join(langs, "cid").join(qs.select("qid", "lang"), "qid").where("clang = lang").select("qid", "cid", F.lit(1).alias("rel"))
    r = C.ranking_rows(corpus, qs.select("qid", "query"), qrels, top)
    return r.select("qid", F.md5("query").alias("query_h"), F.array_join("cids", ",").alias("cids"), F.array_join("rels", ",").alias("rels"), F.md5(F.array_join("docs", "|")).alias("docs_h"))


@query("c10_pad_candidates", f"""with pool as (select doc_id as did, lang, row_number() over (partition by lang order by {q.h32(0, 'doc_id')}, doc_id) as rk, count(*) over (partition by lang) as n from documents),
 qs as (select doc_id as qid, lang, [doc_id] as p, list_distinct([doc_id + 1, doc_id, doc_id + 2]) as ng from documents where doc_id in (select doc_id from labels)),
 have as (select qid, lang, [qid, qid + 1, qid + 2] as h from qs),
 fill as (select h.qid, j, pool.did from have h join (select distinct lang, n from pool) m using (lang) cross join range(10) r(j) join pool on pool.lang = h.lang and pool.rk = ({q.h32(0, 'h.qid')} + j) % m.n + 1
   where j < m.n and not list_contains(h.h, pool.did))
select h.qid, array_to_string((h.h || coalesce(list(f.did order by f.j) filter (f.did is not null), []))[1:10], ',') as cands from have h left join fill f using (qid) group by h.qid, h.h""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang")
    qs = t.join(table(spark, d, "labels", "doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("qid"), "lang", F.array("doc_id").alias("pos_ids"), F.array(F.col("doc_id") + 1, F.col("doc_id"), F.col("doc_id") + 2).alias("neg_ids"))
    r = C.pad_candidates(qs, t.withColumnRenamed("doc_id", "did"), "lang", 10)
    return r.select("qid", F.array_join("cands", ",").alias("cands"))


@query("c11_distractor_context", f"""with p as (select doc_id as pid, source as title, text from documents),
 ti as (select title, cnt, row_number() over (order by {q.h32('0.t', 'title')}, title) as tr, count(*) over () - 1 as t from (select title, count(*) as cnt from p group by title)),
 pr as (select *, row_number() over (partition by title order by {q.h32('0.p', 'pid')}, pid) as k from p),
 qs as (select pid * 10 as qid, title, pid as gold from p where pid in (select doc_id from labels)),
 want as (select qid, j, (tr - 1 + 1 + ({q.h32('0.d', 'qid')} + j) % t) % (t + 1) + 1 as tr from qs join ti using (title) cross join range(4) r(j) where j < t),
 x as (select w.qid, pr.pid, pr.text, 0 as g from want w join ti o on o.tr = w.tr join pr on pr.title = o.title and pr.k = {q.h32('0.i', 'w.qid', 'w.j')} % o.cnt + 1 union all select qid, gold, text, 1 from qs join p on p.pid = qs.gold)
select qid, (list_position(list(g order by {q.h32('0.o', 'qid', 'pid')}, pid), 1) - 1)::BIGINT as gold_pos, string_agg(pid::VARCHAR, ',' order by {q.h32('0.o', 'qid', 'pid')}, pid) as pids,
 md5(string_agg(text, chr(10) || chr(10) order by {q.h32('0.o', 'qid', 'pid')}, pid)) as h from x group by qid""")
def _(spark, d):
    # title = source, paragraph = document; every labelled document is the gold paragraph of one question
    t = docs(spark, d, "doc_id", "source", "text").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")
    qs = t.join(table(spark, d, "labels", "doc_id").withColumnRenamed("doc_id", "pid"), "pid", "left_semi").select(
        (F.col("pid") * 10).alias("qid"), "title", "pid")
    r = C.distractor_context(qs, t, 4)
    return r.select("qid", "gold_pos", F.array_join("pids", ",").alias("pids"), F.md5("context").alias("h"))


@query("c12_assemble_shards", f"""select d.doc_id, round({q.u(13, 'd.doc_id')}, 6) as score from documents d""")
def _(spark, d):
    base = docs(spark, d, "doc_id")
    shards = base.where("doc_id % 2 = 0").unionByName(base.where("doc_id % 2 = 1")).withColumn("score", K.u(13, "doc_id"))
    return C.assemble_shards(base, shards, "doc_id")


@query("c12_shard_gaps", "select (select count(*) from documents)::BIGINT as expected, count(distinct x)::BIGINT as delivered, (select count(*) from documents where doc_id not in (select doc_id from labels))::BIGINT as missing, 0::BIGINT as unknown, sum((x % 3 = 0)::INT)::BIGINT as repeated from (select doc_id as x from labels)")
def _(spark, d):
    l = table(spark, d, "labels", "doc_id")
    return C.shard_gaps(docs(spark, d, "doc_id"), l.unionByName(l.where("doc_id % 3 = 0")), "doc_id")


@query("c13_blend_scores", f"select d.doc_id, round(coalesce(0.7 * l.toxic + 0.3 * {q.u(14, 'd.doc_id')}, {q.u(14, 'd.doc_id')}), 6) as score from documents d left join labels l using (doc_id)")
def _(spark, d):
    old = docs(spark, d, "doc_id").withColumn("score", K.u(14, "doc_id"))
    return C.blend_scores(old, table(spark, d, "labels").withColumn("score", F.col("toxic").cast("double")), 0.7, "doc_id")


@query("c14_native_labels", f"""with t as (select doc_id, lang, case when quality = 1 then 'good' else 'poor' end as g, {q.u(0, 'doc_id')} as u from documents join labels using (doc_id))
select doc_id, case when lang in ('de', 'fr') and u < 0.5 then lang || ':good,' || lang || ':poor' else 'good,poor' end as labels,
 case when lang in ('de', 'fr') and u < 0.5 then lang || ' {{}}' else 'a {{}} text' end as template, case when lang in ('de', 'fr') and u < 0.5 then lang || ':' || g else g end as gold,
 (lang in ('de', 'fr') and u < 0.5)::INT::BIGINT as native from t""")
def _(spark, d):
    t = labelled(spark, d, "lang").select(
        "doc_id", "lang", F.array(F.lit("good"), F.lit("poor")).alias("labels"), F.lit("a {} text").alias("template"),
        F.array(F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("gold"))
    # the dictionary of translated label sets, one row per language that has one
    dim = t.where("lang in ('de', 'fr')").select("lang", "labels", "template").distinct().withColumn(
        "native_labels", F.transform("labels", lambda x: F.concat("lang", F.lit(":"), x))).withColumn("native_template", F.concat("lang", F.lit(" {}")))
    r = C.native_labels(t, dim, 0.5, key="doc_id")
    return r.select("doc_id", F.array_join("labels", ",").alias("labels"), "template", F.array_join("gold", ",").alias("gold"), "native")


@query("c15_nli_pairs", """select d.doc_id, i::BIGINT as label_idx, md5(d.text) as h, 'The language is ' || ['de','en','es','fr'][(i + 1)::INT] || '.' as text_pair,
 (['de','en','es','fr'][(i + 1)::INT] = d.lang)::INT::BIGINT as label from documents d, range(4) r(i)""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text", "lang").select("doc_id", "text", F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]).alias("labels"),
                                                        F.array("lang").alias("gold"), F.lit("The language is {}.").alias("template"))
    return C.nli_pairs(t, ["doc_id"], "text", "labels", "gold", "template").select("doc_id", "label_idx", F.md5("text").alias("h"), "text_pair", "label")


@query("c16_span_overlap", """with w as (select event_id, user_id as doc_id, (event_id % 500)::BIGINT as s, (event_id % 500 + 3 + event_id % 5)::BIGINT as e, event_type as label from events),
 p as (select * from w where event_id % 2 = 0), g as (select * from w where event_id % 2 = 1)
select p.doc_id, p.s as p_start, p.e as p_end, p.label as p_label, g.s as g_start, g.e as g_end, g.label as g_label from p join g on p.doc_id = g.doc_id and p.s < g.e and p.e > g.s""")
def _(spark, d):
    # events as spans on a line per user: even ids are predictions, odd ids gold
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    w = e.select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 500).alias("start"),
                 (F.col("event_id") % 500 + 3 + F.col("event_id") % 5).alias("end"), F.col("event_type").alias("label"))
    return C.span_overlap(w.where("event_id % 2 = 0"), w.where("event_id % 2 = 1"), "doc_id")


@query("c17_lang_match", f"with {PREDS} select source, count(*)::BIGINT as n, round(avg((gold = pred)::INT), 6) as match from preds group by source")
def _(spark, d):
    return C.lang_match(predictions(spark, d), "gold", "pred", ["source"])
