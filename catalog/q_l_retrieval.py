"""Vectors and retrieval."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import retrieval as L
from glyphmill.operators import sampling as E

from . import query
from . import sqlkit as q
from .common import docs, table

V = "embedding::DOUBLE[]"


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def _split(spark, d):
    e = emb(spark, d)
    qs = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label", "vec")
    return qs, e.select(F.col("vec_id").alias("pid"), "label", "vec")


NN = f"nn as (select a.vec_id as qid, b.vec_id as pid, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as s from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0), rk as (select *, row_number() over (partition by qid order by s desc, pid) as r from nn)"


@query("l1_l2norm", f"select vec_id, round(list_inner_product({V}, {V}) / list_inner_product({V}, {V}), 6) as norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product({V}, {V})), 6) as first from embeddings")
def _(spark, d):
    n = emb(spark, d).withColumn("v", L.l2norm("vec"))
    return n.select("vec_id", L.norm("v").alias("norm"), F.get("v", F.lit(0)).alias("first"))


@query("l2_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) as cos from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = emb(spark, d)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("nxt"))
    return e.join(n, "vec_id").select("vec_id", L.cosine("vec", "nxt").alias("cos"))


@query("l3_mine", f"with {NN} select qid, pid, round(s, 6) as score, r::BIGINT as rank from rk where r <= 8")
def _(spark, d):
    qs, ps = _split(spark, d)
    return L.mine(qs, ps, 8, "label").select("qid", "pid", "score", "rank")


@query("l3_mine_blocks", f"with {NN} select qid, pid, r::BIGINT as rank from rk where r <= 5")
def _(spark, d):
    # blocks of seven rows: every key is cut into many pieces, the merged lists stay the same
    qs, ps = _split(spark, d)
    return L.mine(qs, ps, 5, "label", block=7).select("qid", "pid", "rank")


@query("l4_cross_index", f"with nn as (select a.vec_id as qid, b.vec_id as pid, list_cosine_similarity((a.embedding[2:] || a.embedding[:1])::DOUBLE[], b.embedding::DOUBLE[]) as s from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select qid, pid, round(s, 6) as score, (row_number() over (partition by qid order by s desc, pid))::BIGINT as rank from nn qualify rank <= 3")
def _(spark, d):
    # queries come from another space than the index: here their dimensions are turned by one place
    qs, ps = _split(spark, d)
    qs = qs.withColumn("vec", F.concat(F.slice("vec", F.lit(2), F.size("vec") - 1), F.slice("vec", 1, 1)))
    return L.mine(qs, ps, 3, "label").select("qid", "pid", "score", "rank")


@query("l5_subsample", f"""with {NN}, c as (select qid, array_to_string(([qid] || list(pid order by r))[1:4], ',') as cands from rk where r <= 8 group by qid), x as (select c.*, e.label from c join embeddings e on e.vec_id = c.qid)
select qid, label::BIGINT as label, cands from x qualify row_number() over (partition by label order by {q.h32(5, 'qid')}, qid) <= 3""")
def _(spark, d):
    qs, ps = _split(spark, d)
    c = L.candidates(L.mine(qs, ps, 8, "label"), qs, 4).join(qs.select("qid", "label"), "qid")
    return E.quota(c, ["label"], 3, 5, ["qid"]).select("qid", "label", F.array_join("cands", ",").alias("cands"))


FAQ = f"""t as (select c.conv_id * 1000 + c.turn as id, c.conv_id % 7 as site, c.text as qu, e.text as an, 'https://' || (c.conv_id % 7) || '.example.com/' || case when c.conv_id % 11 = 0 then 'casino' else 'faq' end as url from conversations c join conversations e on e.conv_id = c.conv_id and e.turn = c.turn + 1 where c.role = 'user' and e.role = 'assistant'),
 o as (select * from t where length(qu) between 10 and 600 and length(an) between 50 and 3000 and not regexp_matches(url, 'casino')), a as (select * from o qualify row_number() over (partition by {q.k1('qu')} order by id) = 1), b as (select * from a qualify row_number() over (partition by {q.k1('an')} order by id) = 1)"""


@query("l6_faq_pool", f"with {FAQ} select id, site::BIGINT as site from b qualify row_number() over (partition by site order by id) <= 15")
def _(spark, d):
    c = table(spark, d, "conversations")
    e = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("an"))
    site = F.col("conv_id") % 7
    url = F.concat(F.lit("https://"), site.cast("string"), F.lit(".example.com/"), F.when(F.col("conv_id") % 11 == 0, "casino").otherwise("faq"))
    t = c.where("role = 'user'").join(e, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), site.alias("site"), F.col("text").alias("qu"), "an", url.alias("url"))
    return L.faq_pool(t, "qu", "an", "site", "url", "id", "casino", (10, 600), (50, 3000), 15).select("id", "site")


RANK = f"""rr as (select qid, r as pos, case when pid % 3 = 0 then 2 when pid % 3 = 1 then 1 else 0 end as rel, round(s + {q.u(16, 'qid', 'pid')} * 0.5, 2) as sa, round(s + {q.u(17, 'qid', 'pid')} * 0.3, 2) as sb from rk where r <= 12)"""


def _ranking(spark, d):
    qs, ps = _split(spark, d)
    m = L.mine(qs, ps, 12, "label")
    rel = F.when(F.col("pid") % 3 == 0, 2).when(F.col("pid") % 3 == 1, 1).otherwise(0)
    return m.select("qid", F.col("rank").alias("pos"), rel.alias("rel"), F.round(F.col("score") + K.u(16, "qid", "pid") * 0.5, 2).alias("sa"), F.round(F.col("score") + K.u(17, "qid", "pid") * 0.3, 2).alias("sb"))


@query("l7_top1_agree", f"with {NN}, {RANK}, g as (select qid, arg_max(pos, sa * 1000 - pos * 0.001) as a, arg_max(pos, sb * 1000 - pos * 0.001) as b from rr group by qid) select count(*)::BIGINT as n, round(avg((a = b)::INT), 6) as agree from g")
def _(spark, d):
    return L.top1_agree(_ranking(spark, d), "qid", "pos", "sa", "sb")


@query("l8_text_pool", "select md5(text) as h, min(source) as source from (select text, 'documents:text' as source from documents union all select text, 'benchmark:text' from benchmark union all select text, 'conversations:text' from conversations) group by text")
def _(spark, d):
    t = L.text_pool([(docs(spark, d, "text"), "text", "documents:text"), (table(spark, d, "benchmark"), "text", "benchmark:text"), (table(spark, d, "conversations"), "text", "conversations:text")])
    return t.select(F.md5("text").alias("h"), "source")


@query("l9_space_agreement", """with a as (select x.vec_id as q, arg_max(y.vec_id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) as p from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id group by 1),
 b as (select x.vec_id as q, arg_max(y.vec_id, list_cosine_similarity([v + 0.05 for v in x.embedding::DOUBLE[]], [v + 0.05 for v in y.embedding::DOUBLE[]])) as p from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id group by 1)
select (select count(*) from embeddings)::BIGINT as n, (select round(avg(list_cosine_similarity(embedding::DOUBLE[], [v + 0.05 for v in embedding::DOUBLE[]])), 6) from embeddings) as mean_cosine, (select round(avg((a.p = b.p)::INT), 6) from a join b using (q)) as top1_agree""")
def _(spark, d):
    # the second space is the first one with a constant shift
    a = emb(spark, d).withColumn("vec", F.col("vec").cast("array<double>"))
    return L.space_agreement(a, a.withColumn("vec", F.transform("vec", lambda x: x + 0.05)), "vec_id", "label")


@query("n16_ranking_metrics", f"""with {NN}, {RANK}, o as (select *, row_number() over (partition by qid order by sa desc, pos) as r, row_number() over (partition by qid order by rel desc, pos) as i from rr),
 g as (select qid, sum(case when r <= 10 then (2 ** rel - 1) / log2(r + 1) else 0 end) as d, sum(case when i <= 10 then (2 ** rel - 1) / log2(i + 1) else 0 end) as b, min(case when rel > 0 and r <= 10 then r end) as f from o group by qid)
select qid, round(case when b > 0 then d / b else 0 end, 6) as ndcg, round(coalesce(1.0 / f, 0), 6) as mrr from g""")
def _(spark, d):
    return L.ranking_metrics(_ranking(spark, d), "qid", "pos", "rel", "sa")
