"""Composite jobs."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions.units import explode_rows
from glyphmill.operators import augment as A
from glyphmill.operators import metrics as N
from glyphmill.operators import spans as S
from glyphmill.plans import jobs as W
from glyphmill.session import materialise
from glyphmill.sources import build_report

from . import query
from . import sqlkit as q
from .common import PREDS, SCORES, docs, labelled, predictions, scores, table
from .q_c_joins import sentence_hit_sql
from .q_h_spans import CLEAN, GOLD
from .q_i_augment import FRAMES, RAND, SQL, _alphabet, _sents
from .q_j_labels import CLAIMS, ISO, LP, logprobs
from .q_l_retrieval import NN, RANK, _ranking, _split
from .q_n_metrics import GRID, REG, _regression, auc_sql, bin_sql, mc_sql, sweep_sql

TRAIN = f"""{sentence_hit_sql(25)}, bk as (select distinct {q.k1('text')} as k from benchmark),
 base as (select d.doc_id, d.text, d.lang, d.source, l.quality as label, {q.k1('d.text')} as k from documents d join labels l using (doc_id) where length(d.text) >= 4 and not regexp_matches(d.source, '^(?:src13)')),
 ok as (select * from base where k not in (select k from bk) and doc_id not in (select doc_id from hits)),
 sv as (select min(doc_id) as doc_id from ok group by k having min(label) = max(label)),
 train as (select o.doc_id, o.lang, o.source, o.label, case when {q.u(0, 'o.source')} < 0.2 then 'val' else 'train' end as split from ok o join sv using (doc_id))"""


def train_table(spark, d):
    t = labelled(spark, d, "text", "lang", "source").select("doc_id", "text", "lang", "source", F.col("quality").alias("label"))
    return W.training_table(t, table(spark, d, "benchmark"), drop_rx="src13", val=0.2)


@query("w1_training_table", f"with {TRAIN} select doc_id, lang, source, label::BIGINT as label, split from train")
def _(spark, d):
    return train_table(spark, d).select("doc_id", "lang", "source", "label", "split")


@query("w1_training_report", f"""with {TRAIN} select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' when grouping(split) = 0 then 'split' else 'total' end as dim,
 coalesce(lang, source, split, '') as value, count(*)::BIGINT as n, round(avg(label), 6) as mean_label from train group by grouping sets ((lang), (source), (split), ())""")
def _(spark, d):
    return build_report(train_table(spark, d), ["lang", "source", "split"], "label")


@query("w2_merge_version", f"""with bk as (select distinct {q.k1('text')} as k from benchmark), t as (select d.doc_id, d.source, l.toxic as label, {q.k1('d.text')} as k from documents d join labels l using (doc_id)),
 old as (select *, 'train' as split from t where doc_id % 3 = 0), fr as (select * from t where doc_id % 3 <> 0 and k not in (select k from bk) and k not in (select k from old)),
 sv as (select min(doc_id) as doc_id from fr group by k having min(label) = max(label))
select doc_id, label::BIGINT as label, split from old union all select f.doc_id, f.label, case when {q.u(2, 'f.source')} < 0.1 then 'val' else 'train' end from fr f join sv using (doc_id)""")
def _(spark, d):
    t = labelled(spark, d, "text", "source").select("doc_id", "text", "source", F.col("toxic").alias("label"))
    old = t.where("doc_id % 3 = 0").withColumn("split", F.lit("train"))
    return W.merge_version(old, t.where("doc_id % 3 <> 0"), table(spark, d, "benchmark"), "doc_id", "text", "label", "source", 0.1, 2).select("doc_id", "label", "split")


PAGE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


@query("w3_passage_pool", f"""with src as (select 'doc' as pool, doc_id::VARCHAR as key, lang, text from documents union all select 'page', page_id::VARCHAR, regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1), {PAGE} from pages),
 s as (select pool, key, lang, {q.sents('text', 15)} as s from src), w as (select pool, pool || ':' || key as key, lang, array_to_string(s[({q.h32('3.i', 'key')} % len(s) + 1)::INT : ({q.h32('3.i', 'key')} % len(s) + {q.h32('3.k', 'key')} % 5 + 2)::INT], ' ') as p from s where len(s) > 0),
 o as (select min(key) as key from w where length(p) between 120 and 1200 group by p)
select key, lang, pool, md5(p) as h from w join o using (key) where length(p) between 120 and 1200 qualify row_number() over (partition by lang order by {q.h32(3, 'key')}, key) <= case when lang = 'en' then 120 else 60 end""")
def _(spark, d):
    a = docs(spark, d, "doc_id", "lang", "text").select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    p = W.passage_pool([(a, "doc"), (W.page_table(table(spark, d, "pages")), "page")], 60, {"en": 120}, seed=3)
    return p.select("key", "lang", "pool", F.md5("passage").alias("h"))


URLS = {"mobile": r"^https?://m\.", "fr": "/fr/", "paged": r"[?&]page="}


@query("w3_url_pool", f"""with src as (select 'page:' || page_id as key, case when regexp_matches(url, '^https?://m\\.') then 'mobile' when regexp_matches(url, '/fr/') then 'fr' when regexp_matches(url, '[?&]page=') then 'paged' else 'other' end as cls,
   regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1) as lang, {PAGE} as text, page_id::VARCHAR as id from pages),
 s as (select key, cls, lang, id, {q.sents('text', 15)} as s from src where cls not in ('mobile', 'paged')), w as (select key, cls, lang, array_to_string(s[({q.h32('6.i', 'id')} % len(s) + 1)::INT : ({q.h32('6.i', 'id')} % len(s) + {q.h32('6.k', 'id')} % 5 + 2)::INT], ' ') as p from s where len(s) > 0),
 o as (select min(key) as key from w where length(p) between 120 and 1200 group by p),
 c as (select key, cls, lang, p from w join o using (key) qualify row_number() over (partition by lang order by {q.h32(6, 'key')}, key) <= 40)
select (row_number() over (order by {q.h32(5, 'key')}, key) - 1)::BIGINT as pid, key, lang, cls, md5(p) as h from c""")
def _(spark, d):
    p = W.url_pool(table(spark, d, "pages"), URLS, ["mobile", "paged"], 40, seed=6)
    return p.select("pid", "key", "lang", "cls", F.md5("passage").alias("h"))


@query("w4_language_id_table")
def _(spark, d):
    code = F.when(F.col("lang") == "de", "deu_Latn").when(F.col("lang") == "fr", "fra_Latn").when(F.col("lang") == "es", "spa_Latn").otherwise("eng_Latn")
    t = docs(spark, d, "doc_id", "lang", "text").withColumn("label", code)
    r = W.language_id_table(t, table(spark, d, "benchmark"), "doc_id", "label", "text", min_rows=10, seed=4)
    return r.select("doc_id", "label", "kind", "split", F.md5("text").alias("h"))


@query("w5_redact_corpus", f"""with {CLEAN}, sp as (select doc_id, text, unnest(c) as z, unnest(range(1, len(c) + 1)) as i from cl),
 pc as (select *, lag(z.e, 1, 0) over (partition by doc_id order by i) as pe, max(i) over (partition by doc_id) as n from sp),
 rd as (select doc_id, string_agg(substr(text, (pe + 1)::INT, (z.s - pe)::INT) || '[' || z.l || ']' || case when i = n then substr(text, (z.e + 1)::INT) else '' end, '' order by i) as r from pc group by doc_id)
select d.doc_id, md5(coalesce(rd.r, d.text)) as h from documents d left join rd using (doc_id)""")
def _(spark, d):
    return W.redact_corpus(docs(spark, d, "doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("redacted").alias("h"))


@query("w5_label_counts", f"with {CLEAN} select z.l as label, count(*)::BIGINT as n from (select unnest(c) as z from cl) group by 1")
def _(spark, d):
    r = W.redact_corpus(docs(spark, d, "doc_id", "text"), "doc_id", "text")
    return S.explode_spans(r, "doc_id", "spans").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("w5_redact_conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return W.redact_corpus(c, "id", "text", seed_names=True).select("id", F.size("spans").alias("n"), F.md5("redacted").alias("h"))


@query("w6_redaction_benchmark", f"""with {GOLD}, ln as (select d.lang, g.doc_id, g.s, length(regexp_replace(substr(d.text, (g.s + 1)::INT, (g.e - g.s)::INT), '{q.WS}+', '', 'g')) as n, ({q.u(77, 'g.doc_id', 'g.s')} >= 0.1)::INT as kept from gold g join documents d using (doc_id)),
 a as (select lang, sum(n * kept) as hit, sum(n) as want, sum(kept) as ek, count(*) as en from ln group by lang), l as (select distinct lang from documents),
 m as (select l.lang as set, coalesce(hit, 0) / greatest(coalesce(want, 0), 1) as r, coalesce(hit, 0) / greatest(coalesce(hit, 0), 1) as p, coalesce(ek, 0) / greatest(coalesce(en, 0), 1) as er, coalesce(case when en > 0 then 2 * ek / (ek + en) end, 0.0) as ef from l left join a using (lang)),
 f as (select set, r as redact_recall, p as redact_precision, er as entity_recall, 2 * r * p / greatest(r + p, 1e-9) as redact_f1, ef as entity_f1 from m)
select set, round(redact_recall, 6) as redact_recall, round(redact_precision, 6) as redact_precision, round(entity_recall, 6) as entity_recall, round(redact_f1, 6) as redact_f1, round(entity_f1, 6) as entity_f1 from f
 union all select 'macro', round(avg(redact_recall), 6), round(avg(redact_precision), 6), round(avg(entity_recall), 6), round(avg(redact_f1), 6), round(avg(entity_f1), 6) from f""")
def _(spark, d):
    # predictions are the gold spans with one in ten missing
    t = docs(spark, d, "doc_id", "lang", "text").withColumn("gold", S.clean_spans("text", S.detect_pii("text")))
    t = t.withColumn("pred", F.filter("gold", lambda x: K.u(77, "doc_id", x["start"]) >= 0.1)).withColumn("may", F.array().cast(S.SPANS))
    return W.redaction_benchmark(t, "lang", "text", "gold", "may", "pred")


@query("w7_punctuation_windows")
def _(spark, d):
    w = W.punctuation_windows(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", "lang", table(spark, d, "benchmark"), val=0.1)
    return w.select("doc_id", "window", "lang", "split", F.size("labs").alias("n"), F.md5("text_w").alias("h"))


@query("w8_ingest_teacher", f"""with {LP}, yn as (select doc_id, sum(case when lower(trim(token)) = 'yes' then exp(logprob) else 0 end) as y, sum(case when lower(trim(token)) = 'no' then exp(logprob) else 0 end) as n from lp group by doc_id),
 py as (select doc_id, case when y + n > 0 then y / (y + n) else 0.5 end as p_yes from yn), {ISO.replace(SCORES, 'scores as (select doc_id, toxic as gold, p_yes as score from py join labels using (doc_id))')},
 xs as (select distinct p_yes from py), cal as (select p_yes, coalesce((select min(yhat) from iso where x >= p_yes), (select max(yhat) from iso)) as c from xs),
 so as (select doc_id, p_yes, case when toxic is null then c else 0.7 * c + 0.3 * toxic end as soft from py join cal using (p_yes) left join labels using (doc_id)),
 cap as (select floor(sum((not soft between 0.4 and 0.6)::INT) * (0.3 / (1 - 0.3))) as n from so)
select doc_id, round(p_yes, 6) as p_yes, round(soft, 6) as soft from so where not soft between 0.4 and 0.6 union all
select doc_id, round(p_yes, 6), round(soft, 6) from (select * from so where soft between 0.4 and 0.6 qualify row_number() over (order by {q.h32(8, 'doc_id')}, doc_id) <= (select n from cap))""")
def _(spark, d):
    return W.ingest_teacher(logprobs(spark, d), table(spark, d, "labels"), "doc_id", "toxic", 0.7, 0.3, 8)


@query("w9_mine_candidates", f"""with {NN}, c as (select qid, array_to_string(([qid] || list(pid order by r))[1:7], ',') as cands from rk where r <= 6 group by qid)
select c.qid, e.label::BIGINT as label, c.cands from c join embeddings e on e.vec_id = c.qid qualify row_number() over (partition by e.label order by {q.h32(9, 'c.qid')}, c.qid) <= 4""")
def _(spark, d):
    qs, ps = _split(spark, d)
    return W.mine_candidates(qs, ps, 6, "label", 4, 9).select("qid", "label", F.array_join("cands", ",").alias("cands"))


@query("w10_retrieval_report", f"""with {NN}, {RANK}, o as (select *, row_number() over (partition by qid order by sa desc, pos) as r, row_number() over (partition by qid order by rel desc, pos) as i from rr),
 g as (select qid % 20 as fam, qid % 3 as mem, qid, sum(case when r <= 10 then (2 ** rel - 1) / log2(r + 1) else 0 end) as d, sum(case when i <= 10 then (2 ** rel - 1) / log2(i + 1) else 0 end) as b, min(case when rel > 0 and r <= 10 then r end) as f from o group by qid),
 qm as (select fam, mem, case when b > 0 then d / b else 0 end as ndcg, coalesce(1.0 / f, 0) as mrr from g), a as (select fam, mem, avg(ndcg) as ndcg, avg(mrr) as mrr from qm group by all), b as (select fam, avg(ndcg) as ndcg, avg(mrr) as mrr from a group by fam)
select 2::BIGINT as level, fam || '/' || mem as key, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr from a union all select 1, fam::VARCHAR, round(ndcg, 6), round(mrr, 6) from b union all select 0, '', round(avg(ndcg), 6), round(avg(mrr), 6) from b""")
def _(spark, d):
    r = _ranking(spark, d).withColumn("fam", F.col("qid") % 20).withColumn("mem", F.col("qid") % 3)
    return W.retrieval_report(r, "qid", "pos", "rel", "sa", "fam", "mem")


@query("w11_augment_table")
def _(spark, d):
    t = labelled(spark, d, "text", "source").select("doc_id", "text", "source", F.col("toxic").alias("label"))
    return W.augment_table(t, table(spark, d, "benchmark"), "doc_id", "text", "label", 40, ["leet", "fullwidth", "typos", "homoglyph"], 11).select(
        "doc_id", "label", "source", "augmented", F.md5("text").alias("h"))


def _junk(spark, d):
    return W.junk_predictions(A.gibberish_set(_sents(spark, d), _alphabet(spark, d), "lang", ["doc_id", "sid"], "s", 12), "text", "label", seed=12)


@query("w12_junk_rates")
def _(spark, d):
    # flag rate of a detector that never saw the row, per language and class
    score = F.when(F.col("pred") != "clean", 1.0).otherwise(0.0)
    return N.flag_rates(_junk(spark, d).withColumn("score", score), ["lang", "label"])


@query("w12_junk_classes", "select 1::BIGINT as accurate, 4::BIGINT as classes")
def _(spark, d):
    p = materialise(_junk(spark, d).select("label", "pred"))
    f1 = N.multiclass(p, "label", "pred").select((F.col("macro_f1") >= 0.5).alias("accurate"))
    return f1.crossJoin(p.agg(F.count_distinct("label").alias("classes")))


EV = f"""{SCORES.replace('scores as (', 'sc0 as (')}, scores as (select source as set, unnest([lang, 'all']) as lang, gold, score from sc0),
 {bin_sql('set, lang').replace('group by set, lang', 'group by set, lang')}"""


@query("w13_evaluation_report", f"""with {EV}, au as (select * from {auc_sql('set, lang')}), w as (select bm.set, bm.lang, acc, precision, recall, f1, fpr, fnr, auc from bm join au on au.set = bm.set and au.lang = bm.lang)
select set, lang, metric, round(value, 6) as value from (unpivot w on acc, precision, recall, f1, fpr, fnr, auc into name metric value value)""")
def _(spark, d):
    return W.evaluation_report(scores(spark, d).withColumnRenamed("source", "set"))


@query("w13_tuned_report", f"""with {SCORES.replace('scores as', 'every as')}, scores as (select * from every where {q.u('13', 'doc_id')} < 0.5), {sweep_sql('lang')},
 pooled as (select threshold from (select threshold, sum(tp) as tp, sum(fp) as fp, sum(pos) as pos from sw group by threshold) order by (case when tp = 0 then 0 else 2 * tp / (tp + fp + pos) end) desc, threshold limit 1),
 own as (select lang, pos, threshold from swm qualify row_number() over (partition by lang order by f1 desc, threshold) = 1), cut as (select lang, case when pos >= 8 then threshold else (select threshold from pooled) end as threshold from own),
 c as (select e.lang, any_value(threshold) as threshold, count(*) as n, sum(gold) as pos, sum((score >= threshold)::INT) as flagged, sum((score >= threshold)::INT * gold) as tp from every e join cut using (lang) where {q.u('13', 'doc_id')} >= 0.5 group by e.lang)
select lang, threshold, n::BIGINT as n, pos::BIGINT as pos, round(case when flagged = 0 then 0 else tp / flagged end, 6) as precision, round(case when pos = 0 then 0 else tp / pos end, 6) as recall, round(case when tp = 0 then 0 else 2 * tp / (flagged + pos) end, 6) as f1 from c""")
def _(spark, d):
    return W.tuned_report(scores(spark, d), GRID, "doc_id", seed=13)


MODELS = f"""sc as (select source, lang, gold, score, {q.u(131, 'doc_id')} as noise from scores), every as (select 'rule' as model, source as set, gold, score from sc union all select 'blend', source, gold, 0.5 * score + 0.5 * noise from sc
  union all select 'chance', source, gold, noise from sc)"""


@query("w13_leaderboard", f"""with {SCORES}, {MODELS}, c as (select model, set, sum((gold = 1 and score >= 0.5)::INT) as tp, sum((gold = 0 and score >= 0.5)::INT) as fp, sum((gold = 1 and score < 0.5)::INT) as fn from every group by all),
 f as (select model, set, case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as v from c), b as (select model, max(v) filter (set = 'src0') as src0, max(v) filter (set = 'src1') as src1, max(v) filter (set = 'src2') as src2 from f group by model)
select model, round(src0, 6) as src0, round(src1, 6) as src1, round(src2, 6) as src2, round((src0 + src1 + src2) / 3, 6) as macro, rank() over (order by src0 + src1 + src2 desc)::BIGINT as rank from b""")
def _(spark, d):
    noise = K.u(131, "doc_id")
    models = F.array(*[F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in (("rule", F.col("score")), ("blend", 0.5 * F.col("score") + 0.5 * noise), ("chance", noise))])
    p = scores(spark, d).select(F.col("source").alias("set"), "lang", "gold", F.explode(models).alias("m")).select("m.model", "set", "lang", "gold", "m.score")
    return W.model_leaderboard(p, ["src0", "src1", "src2"])


@query("w13_full_report", f"""with {EV}, au as (select * from {auc_sql('set, lang')}), w as (select bm.set, bm.lang, acc, precision, recall, f1, fpr, fnr, auc from bm join au on au.set = bm.set and au.lang = bm.lang),
 {PREDS}, {mc_sql('source')}, mc as (select 'class:' || source as set, sum(tp) / sum(support) as acc, avg(f1) as macro_f1, avg(tp / support) filter (support > 0) as bacc from cc group by source),
 {REG}, rr as (select *, rank() over (partition by lang order by g) + (count(*) over (partition by lang, g) - 1) / 2.0 as rg, rank() over (partition by lang order by p) + (count(*) over (partition by lang, p) - 1) / 2.0 as rp from reg),
 rg as (select 'value:' || lang as set, corr(rg, rp) as spearman, corr(g, p) as pearson from rr group by lang),
 langs as (select unnest(['all', 'x']) as lang)
select set, lang, metric, round(value, 6) as value from (unpivot w on acc, precision, recall, f1, fpr, fnr, auc into name metric value value)
union all select set, lang, metric, round(value, 6) from (unpivot mc on acc, macro_f1, bacc into name metric value value), langs
union all select set, lang, metric, round(value, 6) from (unpivot rg on spearman, pearson into name metric value value), langs""")
def _(spark, d):
    c = predictions(spark, d).select(F.concat(F.lit("class:"), "source").alias("set"), F.lit("x").alias("lang"), "gold", "pred")
    v = _regression(spark, d).select(F.concat(F.lit("value:"), "lang").alias("set"), F.lit("x").alias("lang"), F.col("g").alias("gold"), F.col("p").alias("pred"))
    return W.full_report(scores(spark, d).withColumnRenamed("source", "set"), c, v)


@query("w14_prompt_pool", f"""with f as (select conv_id, min(turn) as t0, arg_min(text, turn) as prompt from conversations where role = 'user' group by conv_id),
 r as (select c.conv_id, arg_min(c.text, c.turn) as response from conversations c join f on f.conv_id = c.conv_id and c.turn > f.t0 where role = 'assistant' group by c.conv_id),
 pr as (select conv_id, 'prompt' as kind, prompt as text, '' as text_pair from f union all select conv_id, 'response', prompt, response from f join r using (conv_id)),
 o as (select min(conv_id) as conv_id, kind from pr where length(text) between 10 and 1500 group by kind, {q.k1('text')}, text_pair)
select conv_id, kind, case when row_number() over (partition by kind order by {q.h32(14, 'conv_id')}, conv_id) <= 10 then 'test' else 'train' end as split from o qualify row_number() over (partition by kind order by {q.h32(14, 'conv_id')}, conv_id) <= 60""")
def _(spark, d):
    return W.prompt_pool(table(spark, d, "conversations"), 10, 1500, 10, 50, 14).select("conv_id", "kind", "split")


@query("w15_compression_report")
def _(spark, d):
    return W.compression_report(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "text", "lang", [0.3, 0.5], 2)


@query("w16_claim_table", f"with {CLAIMS} select conv_id, claim, label::BIGINT as label, case when {q.u(0, 'conv_id')} < 0.2 then 'val' else 'train' end as split from al qualify row_number() over (partition by label order by {q.h32(0, 'conv_id', 'claim')}, conv_id, claim) <= (select n from m)")
def _(spark, d):
    a = table(spark, d, "conversations").where("role = 'assistant'")
    it = a.groupBy("conv_id").agg(F.min_by("text", "turn").alias("supported"), F.min("turn").alias("t0")).withColumn("passage", F.lit(""))
    rest = a.join(it.select("conv_id", "t0"), "conv_id").where("turn > t0").select("conv_id", F.col("turn").alias("rid"), "text")
    return W.claim_table(it.drop("t0"), rest, "conv_id").select("conv_id", "claim", "label", "split")


DOM = f"dm as (select doc_id, lang, case when a >= b and a >= c then 'law' when b >= c then 'shop' else 'news' end as domain from (select doc_id, lang, {q.u('d0', 'doc_id')} as a, {q.u('d1', 'doc_id')} as b, {q.u('d2', 'doc_id')} as c from documents))"


def _domains(spark, d):
    return docs(spark, d, "doc_id", "lang").select("doc_id", "lang", *[K.u(f"d{i}", "doc_id").alias(x) for i, x in enumerate("abc")])


@query("w17_domain_profile", f"with {DOM} select lang, domain, count(*)::BIGINT as n, round(count(*) / sum(count(*)) over (partition by lang), 6) as share from dm group by lang, domain")
def _(spark, d):
    return W.domain_profile(_domains(spark, d), ["a", "b", "c"], ["law", "shop", "news"], "lang")


@query("w17_rebalance", f"with {DOM} select doc_id, domain from dm qualify row_number() over (partition by domain order by {q.h32(17, 'doc_id')}, doc_id) <= case domain when 'law' then 100 when 'shop' then 60 else 40 end")
def _(spark, d):
    return W.rebalance(_domains(spark, d), ["a", "b", "c"], ["law", "shop", "news"], {"law": 0.5, "shop": 0.3, "news": 0.2}, 200, "doc_id", 17).select("doc_id", "domain")
