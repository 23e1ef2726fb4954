"""Sampling, quotas, splits."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import sampling as E

from . import query
from . import sqlkit as q
from .common import SCORES, docs, labelled, scores, table

RN = lambda seed, part="": f"row_number() over ({'partition by ' + part if part else ''} order by {q.h32(seed, 'doc_id')}, doc_id)"


@query("e1_sample_n", f"select doc_id, lang from documents qualify {RN(1)} <= 137")
def _(spark, d):
    return E.sample_n(docs(spark, d, "doc_id", "lang"), 137, 1, ["doc_id"])


@query("e2_quota", f"select doc_id, lang from documents qualify {RN(2, 'lang')} <= case lang when 'en' then 150 when 'es' then 20 else 70 end")
def _(spark, d):
    return E.quota(docs(spark, d, "doc_id", "lang"), ["lang"], 70, 2, ["doc_id"], overrides={"en": 150, "es": 20})


@query("e3_balanced", f"select doc_id, toxic::BIGINT as toxic from labels qualify {RN(3, 'toxic')} <= 60 // 2")
def _(spark, d):
    return E.balanced(table(spark, d, "labels", "doc_id", "toxic"), "toxic", 60, 3, ["doc_id"])


@query("e4_stratified", f"select doc_id, lang from documents qualify {RN(4, 'lang')} <= round_even(333 * (count(*) over (partition by lang)) / (count(*) over ()), 0)")
def _(spark, d):
    return E.stratified(docs(spark, d, "doc_id", "lang"), "lang", 333, 4, ["doc_id"])


@query("e5_balance_to_min", f"select doc_id, toxic::BIGINT as toxic from labels qualify {RN(5, 'toxic')} <= (select min(n) from (select count(*) as n from labels group by toxic))")
def _(spark, d):
    return E.balance_to_min(table(spark, d, "labels", "doc_id", "toxic"), "toxic", 5, ["doc_id"])


@query("e6_cap_share", f"""with {SCORES}, t as (select *, (source in ('src1','src2','src3','src4')) as web, (score < 0.5) as neutral from scores),
 cap as (select floor(sum((web and not neutral)::INT) * (0.4 / (1 - 0.4))) as c from t)
select doc_id, source from t where not (web and neutral) union all
select doc_id, source from (select * from t where web and neutral qualify {RN(6)} <= (select c from cap))""")
def _(spark, d):
    t = scores(spark, d)
    return E.cap_share(t, F.col("score") < 0.5, F.col("source").isin("src1", "src2", "src3", "src4"), 0.4, 6, ["doc_id"]).select("doc_id", "source")


@query("e7_repeat", "select doc_id, source, i::BIGINT as copy from documents, range(1, 4) r(i) where i = 1 or source in ('src5', 'src6')")
def _(spark, d):
    return E.repeat(docs(spark, d, "doc_id", "source"), F.col("source").isin("src5", "src6"), 3)


@query("e8_split_exact", f"select doc_id, case when {RN(8)} <= greatest(20, floor((select count(*) from documents) * 0.03)) then 'val' else 'train' end as split from documents")
def _(spark, d):
    return E.split_exact(docs(spark, d, "doc_id"), 0.03, 8, ["doc_id"], minimum=20)


@query("e9_split_hash", f"select doc_id, case when {q.u(9, 'doc_id')} < 0.1 then 'val' else 'train' end as split from documents")
def _(spark, d):
    return E.split_hash(docs(spark, d, "doc_id"), ["doc_id"], 0.1, 9)


@query("e10_split_group", f"select conv_id, turn, case when {q.u(10, 'conv_id')} < 0.2 then 'val' else 'train' end as split from conversations")
def _(spark, d):
    return E.split_group(table(spark, d, "conversations", "conv_id", "turn"), ["conv_id"], 0.2, 10)


@query("e11_leakage", f"select source from (select source, case when {q.u(11, 'doc_id')} < 0.02 then 'val' else 'train' end as split from documents) group by source having count(distinct split) > 1")
def _(spark, d):
    return E.leakage(E.split_hash(docs(spark, d, "doc_id", "source"), ["doc_id"], 0.02, 11), "source")


@query("e12_run_ids", """with t as (select event_id, event_type, (event_id // 1000)::BIGINT as file, lag(event_type) over (partition by event_id // 1000 order by event_id) as p from events)
select event_id, file, (sum((p is null or p <> event_type)::INT) over (partition by file order by event_id))::BIGINT as run from t""")
def _(spark, d):
    t = table(spark, d, "events", "event_id", "event_type").withColumn("file", F.floor(F.col("event_id") / 1000))
    return E.run_ids(t, ["file"], "event_id", ["event_type"]).select("event_id", "file", "run")


@query("e13_thread_group", """with c as (select conv_id, turn, text, case when turn % 2 = 1 then (select x.text from conversations x where x.conv_id = c.conv_id and x.turn = c.turn - 1) else '' end as context from conversations c),
 a as (select * from c union all select conv_id + 100000, turn, text, '' from c where turn % 2 = 1 and conv_id % 3 = 0),
 k as (select text, min(md5(context)) as g from a where coalesce(context, '') <> '' group by text)
select conv_id, turn, case when coalesce(context, '') <> '' then md5(context) else coalesce(k.g, md5(a.text)) end as grp from a left join k on a.text = k.text""")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    t = c.join(prev, ["conv_id", "turn"], "left").withColumn("context", F.when(F.col("turn") % 2 == 1, F.col("context")).otherwise(""))
    copies = t.where("turn % 2 = 1 and conv_id % 3 = 0").withColumn("conv_id", F.col("conv_id") + 100000).withColumn("context", F.lit(""))
    return E.thread_group(t.unionByName(copies), "text", "context").select("conv_id", "turn", "grp")


@query("e14_head_per_group", f"select doc_id, source from documents qualify {RN(14, 'source')} <= 3")
def _(spark, d):
    return E.head_per_group(docs(spark, d, "doc_id", "source"), ["source"], 3, 14, ["doc_id"])


@query("e15_min_support", "select doc_id, lang from documents where lang in (select lang from documents group by lang having count(*) >= 120)")
def _(spark, d):
    return E.min_support(docs(spark, d, "doc_id", "lang"), "lang", 120)


@query("e16_shard", "select doc_id, (doc_id % 7)::BIGINT as shard from documents")
def _(spark, d):
    return E.with_shard(docs(spark, d, "doc_id"), "doc_id", 7)


@query("e17_round_robin", "select doc_id, ['German','French','Spanish'][(doc_id % 3 + 1)::INT] as target from documents")
def _(spark, d):
    return E.round_robin(docs(spark, d, "doc_id"), ["German", "French", "Spanish"], "doc_id")


@query("e18_sample_grid", f"""select doc_id, ['email','page','table'][({q.h32('18.0', 'doc_id')} % 3 + 1)::INT] as kind, ['law','shop'][({q.h32('18.1', 'doc_id')} % 2 + 1)::INT] as domain,
 ['de','en','es','fr'][({q.h32('18.2', 'doc_id')} % 4 + 1)::INT] as job_lang from documents""")
def _(spark, d):
    return E.assign_grid(docs(spark, d, "doc_id"), "doc_id", {"kind": ["email", "page", "table"], "domain": ["law", "shop"], "job_lang": ["de", "en", "es", "fr"]}, 18)


@query("e19_mixture", f"""with {SCORES}, t as (select *, case when gold = 1 then 'harm' when score >= 0.4 then 'edgy' else 'benign' end as part from scores)
select doc_id, part from t qualify {RN(19, 'part')} <= case part when 'harm' then 25 when 'edgy' then 15 else 10 end""")
def _(spark, d):
    parts = {"harm": (F.col("gold") == 1, 25), "edgy": (F.col("score") >= 0.4, 15), "benign": (F.lit(True), 10)}
    return E.mixture(scores(spark, d), parts, 19, ["doc_id"]).select("doc_id", "part")


@query("e20_cap_list", "select conv_id, array_to_string(list(turn order by turn)[1:3], ',') as turns from conversations group by conv_id")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    return c.select("conv_id", F.array_join(F.slice("l", 1, 3), ",").alias("turns"))


@query("e21_quota_backfill", f"""with t as (select doc_id, lang, n_chars > 3000 as c from documents), f as (select doc_id from t where c qualify {RN(21, 'lang')} <= 20)
select doc_id, lang from t qualify row_number() over (partition by lang order by (doc_id not in (select doc_id from f))::INT, {q.h32(21, 'doc_id')}, doc_id) <= 40""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "n_chars")
    return E.quota_backfill(t, "lang", F.col("n_chars") > 3000, 40, 21, ["doc_id"]).select("doc_id", "lang")


@query("e22_sample_groups", f"select conv_id, turn from conversations where {q.u(22, 'conv_id')} < 0.3")
def _(spark, d):
    return E.sample_groups(table(spark, d, "conversations", "conv_id", "turn"), ["conv_id"], 0.3, 22)


@query("e23_sample_per_target", f"""with {SCORES}, t as (select doc_id, unnest(['German','French']) as target, (score >= 0.5)::INT::BIGINT as above from scores)
select doc_id, target, above from t qualify row_number() over (partition by target, above order by {q.h32(23, 'target', 'doc_id')}, target, doc_id) <= 30""")
def _(spark, d):
    return E.sample_per_target(scores(spark, d), ["German", "French"], 60, "score", 0.5, 23, ["doc_id"]).select("doc_id", "target", "above")


@query("e24_slices", f"select doc_id, lang, case when {RN(24, 'lang')} <= 10 then 'test' else 'train' end as split from documents qualify {RN(24, 'lang')} <= 60")
def _(spark, d):
    return E.slices(docs(spark, d, "doc_id", "lang"), ["lang"], 10, 50, 24, ["doc_id"])


@query("e25_flag_share", f"select doc_id, (lang <> 'en' and {q.u(25, 'doc_id')} < 0.15)::INT::BIGINT as flag from documents")
def _(spark, d):
    return E.flag_share(docs(spark, d, "doc_id", "lang"), F.col("lang") != "en", 0.15, 25, ["doc_id"]).select("doc_id", "flag")


@query("e26_remix", f"""with t as (select doc_id, case when regexp_matches(text, '[0-9]') then 0 when text like '%?%' or length(text) > 900 then 1 end as label from documents),
 m as (select min(n) as n from (select count(*) as n from t where label is not null group by label))
select doc_id, label::BIGINT as label from t where label is not null qualify {RN(26, 'label')} <= (select n from m)""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text")
    return E.remix(t, "text", F.col("text").rlike("[0-9]"), F.col("text").contains("?") | (F.length("text") > 900), 26, ["doc_id"]).select("doc_id", "label")
