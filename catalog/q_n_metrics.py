"""Evaluation metrics."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import metrics as N

from . import query
from . import sqlkit as q
from .common import PREDS, SCORES, docs, predictions, scores, table

GRID = [round(0.05 * i, 2) for i in range(1, 20)]
GRID_SQL = "[" + ",".join(str(t) for t in GRID) + "]::DOUBLE[]"


def bin_sql(by, op=">="):
    sel = f"{by}, " if by else ""
    return f"""c as (select {sel} count(*) as n, sum(gold) as pos, sum((gold = 1 and score {op} 0.5)::INT) as tp, sum((gold = 0 and score {op} 0.5)::INT) as fp, sum((gold = 1 and not score {op} 0.5)::INT) as fn,
  sum((gold = 0 and not score {op} 0.5)::INT) as tn from scores {'group by ' + by if by else ''}),
 bm as (select {sel} n::BIGINT as n, pos::BIGINT as pos, (tp + tn) / n as acc, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when pos = 0 then 0 else tp / pos end as recall,
  case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1, case when fp + tn = 0 then 0 else fp / (fp + tn) end as fpr, case when pos = 0 then 0 else fn / pos end as fnr from c)"""


BM = "n, pos, round(acc, 6) as acc, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(fpr, 6) as fpr, round(fnr, 6) as fnr"


@query("n1_binary_metrics", f"with {SCORES}, {bin_sql('')} select {BM} from bm")
def _(spark, d):
    return N.binary_metrics(scores(spark, d))


@query("n1_binary_metrics_gt", f"with {SCORES}, {bin_sql('source', '>')} select source, {BM} from bm")
def _(spark, d):
    return N.binary_metrics(scores(spark, d), op="gt", by=["source"])


@query("n2_language_metrics", f"with {SCORES}, {bin_sql('lang')} select round(avg(f1), 6) as mean, round(avg(f1) filter (lang = 'en'), 6) as english, round(avg(f1) filter (lang <> 'en'), 6) as non_english from bm")
def _(spark, d):
    return N.language_summary(N.binary_metrics(scores(spark, d), by=["lang"]), "f1")


def auc_sql(by, score="score", src="scores"):
    part, grp, sel = (f"partition by {by}", f"group by {by}", f"{by}, ") if by else ("", "", "")
    return f"""(with d as (select {sel} {score} as s, sum(gold) as p, sum(1 - gold) as q from {src} group by all),
  e as (select *, coalesce(sum(q) over ({part} order by s rows between unbounded preceding and 1 preceding), 0) as below from d)
  select {sel} sum(p + q)::BIGINT as n, case when sum(p) > 0 and sum(q) > 0 then sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) end as auc from e {grp})"""


for _by in ("", "lang"):
    @query("n3_auc" + ("_by_lang" if _by else ""), f"with {SCORES} select {_by + ',' if _by else ''} n, round(auc, 6) as auc from {auc_sql(_by)}")
    def _(spark, d, _by=_by):
        return N.auc(scores(spark, d), by=[_by] if _by else [])


def mc_sql(by=""):
    sel = f"{by}, " if by else ""
    on = f"p1.{by} = p2.{by} and" if by else ""
    return f"""u as (select {sel} gold as class, (gold = pred)::INT as tp, 0 as fp, (gold <> pred)::INT as fn from preds union all select {sel} pred, 0, 1, 0 from preds where pred <> gold),
 cc as (select {sel} class, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tp + fn) as support, case when sum(tp) = 0 then 0 else 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) end as f1 from u group by all)"""


@query("n4_multiclass_union", f"with {PREDS}, {mc_sql('source')} select source, sum(support)::BIGINT as n, round(sum(tp) / sum(support), 6) as acc, round(avg(f1), 6) as macro_f1 from cc group by source")
def _(spark, d):
    return N.multiclass(predictions(spark, d), "gold", "pred", ["source"])


@query("n4_multiclass_fixed", f"with {PREDS}, {mc_sql('source')} select source, sum(support)::BIGINT as n, round(sum(tp) / sum(support), 6) as acc, round(coalesce(sum(f1) filter (class in ('de','en','es','fr','it')), 0) / 5, 6) as macro_f1 from cc group by source")
def _(spark, d):
    return N.multiclass(predictions(spark, d), "gold", "pred", ["source"], classes=["de", "en", "es", "fr", "it"])


@query("n4_multiclass_min_support", f"with {PREDS}, {mc_sql('source')} select source, sum(support)::BIGINT as n, round(sum(tp) / sum(support), 6) as acc, round(coalesce(avg(f1) filter (support >= 10), 0), 6) as macro_f1 from cc group by source")
def _(spark, d):
    return N.multiclass(predictions(spark, d), "gold", "pred", ["source"], label_set="gold", min_support=10)


@query("n5_balanced_accuracy", f"with {PREDS}, r as (select source, gold, avg((gold = pred)::INT) as rec from preds group by all) select source, round(avg(rec), 6) as bacc from r group by source")
def _(spark, d):
    return N.balanced_accuracy(predictions(spark, d), "gold", "pred", ["source"])


REG = f"reg as (select doc_id, lang, round({q.u(71, 'doc_id')} * 5, 1) as g, round(least(greatest(({q.u(71, 'doc_id')} * 5) * 0.7 + {q.u(72, 'doc_id')} * 2, 0), 5), 1) as p from documents)"


def _regression(spark, d):
    g = K.u(71, "doc_id") * 5
    return docs(spark, d, "doc_id", "lang").select("doc_id", "lang", F.round(g, 1).alias("g"), F.round(F.least(F.greatest(g * 0.7 + K.u(72, "doc_id") * 2, F.lit(0.0)), F.lit(5.0)), 1).alias("p"))


@query("n6_regression_metrics", f"""with {REG}, r as (select *, rank() over (partition by lang order by g) + (count(*) over (partition by lang, g) - 1) / 2.0 as rg, rank() over (partition by lang order by p) + (count(*) over (partition by lang, p) - 1) / 2.0 as rp from reg)
select lang, count(*)::BIGINT as n, round(corr(rg, rp), 6) as spearman, round(corr(g, p), 6) as pearson, round(avg((round_even(g, 0) = round_even(p, 0))::INT), 6) as acc,
 round(2 * sum((g >= 3 and p >= 3)::INT) / (2 * sum((g >= 3 and p >= 3)::INT) + sum((g < 3 and p >= 3)::INT) + sum((g >= 3 and p < 3)::INT)), 6) as f1 from r group by lang""")
def _(spark, d):
    return N.regression_metrics(_regression(spark, d), "g", "p", ["lang"])


ML = f"ml as (select doc_id, label, ({q.u(81, 'doc_id', 'label')} < 0.3)::INT as gold, {q.u(81, 'doc_id', 'label')} * -0.5 + {q.u(82, 'doc_id', 'label')} * 0.5 + 0.5 as score from (select doc_id, unnest(['anger','joy','fear']) as label from documents))"


def _multilabel(spark, d):
    t = docs(spark, d, "doc_id").select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("anger", "joy", "fear")])).alias("label"))
    a, b = K.u(81, "doc_id", "label"), K.u(82, "doc_id", "label")
    return t.select("doc_id", "label", (a < 0.3).cast("int").alias("gold"), (a * -0.5 + b * 0.5 + 0.5).alias("score"))


@query("n7_multilabel_metrics", f"""with {ML}, c as (select label, sum((gold = 1 and score >= 0.5)::INT) as tp, sum((gold = 0 and score >= 0.5)::INT) as fp, sum((gold = 1 and score < 0.5)::INT) as fn,
 avg(-(gold * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - gold) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) as bce from ml group by label)
select label, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(bce, 6) as bce from c""")
def _(spark, d):
    return N.multilabel_metrics(_multilabel(spark, d), "doc_id", "label", "gold", "score")


@query("n7_exact_match", f"with {ML}, i as (select doc_id, bool_and((gold = 1) = (score >= 0.5)) as ok from ml group by doc_id) select count(*)::BIGINT as n, round(avg(ok::INT), 6) as exact from i")
def _(spark, d):
    return N.exact_match(_multilabel(spark, d), "doc_id", "gold", "score")


def sweep_sql(by=""):
    sel = f"{by}, " if by else ""
    return f"""g as (select unnest({GRID_SQL}) as threshold), tot as (select {sel} sum(gold) as pos, sum(1 - gold) as neg from scores {'group by ' + by if by else ''}),
 sw as (select {sel} threshold, pos, neg, coalesce(sum(s.gold) filter (s.score >= threshold), 0) as tp, coalesce(sum(1 - s.gold) filter (s.score >= threshold), 0) as fp
   from g, scores s {'join tot using (' + by + ')' if by else ', tot'} group by all),
 swm as (select {sel} threshold, pos, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when pos = 0 then 0 else tp / pos end as recall, case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + pos - tp) end as f1, case when neg = 0 then 0 else fp / neg end as fpr from sw)"""


TUNE = lambda order: f"""with {SCORES}, {sweep_sql('lang')}, own as (select lang, any_value(pos) as pos, max_by(threshold, f1 * 1000000 + threshold * {order}) as t from (select lang, pos, threshold, round(f1, 9) as f1 from swm) group by lang)"""


@query("n8_tune_thresholds", f"""with {SCORES}, {sweep_sql('lang')}, pooled as (select threshold from (select threshold, sum(tp) as tp, sum(fp) as fp, sum(pos) as pos from sw group by threshold) order by (case when tp = 0 then 0 else 2 * tp / (tp + fp + pos) end) desc, threshold limit 1),
 own as (select lang, pos, threshold from swm qualify row_number() over (partition by lang order by f1 desc, threshold) = 1)
select lang, pos::BIGINT as pos, case when pos >= 8 then threshold else (select threshold from pooled) end as threshold from own""")
def _(spark, d):
    return N.tune_thresholds(scores(spark, d), GRID, by=["lang"], min_pos=8)


@query("n8_apply_thresholds", f"""with {SCORES}, {sweep_sql('lang')}, own as (select lang, threshold from swm qualify row_number() over (partition by lang order by f1 desc, threshold desc) = 1)
select s.doc_id, s.lang, (s.score >= o.threshold)::INT::BIGINT as pred from scores s join own o using (lang)""")
def _(spark, d):
    s = scores(spark, d)
    t = N.tune_thresholds(s, GRID, by=["lang"], min_pos=0, prefer_high=True)
    return N.apply_thresholds(s, t, ["lang"]).select("doc_id", "lang", "pred")


@query("n9_sweep", f"with {SCORES}, {sweep_sql()} select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(fpr, 6) as fpr, pos::BIGINT as pos from swm")
def _(spark, d):
    return N.sweep(scores(spark, d), GRID)


BUCKET = "case when n_chars <= 200 then '(0,200]' when n_chars <= 1000 then '(200,1000]' when n_chars <= 5000 then '(1000,5000]' else '>5000' end"


@query("n10_flag_rates", f"with {SCORES} select lang, {BUCKET} as bucket, count(*)::BIGINT as n, sum((score >= 0.5)::INT)::BIGINT as flagged, round(avg((score >= 0.5)::INT), 6) as rate from scores where gold = 0 group by all")
def _(spark, d):
    t = scores(spark, d).where("gold = 0").withColumn("bucket", N.length_bucket("n_chars", [200, 1000, 5000]))
    return N.flag_rates(t, ["lang", "bucket"])


@query("n12_mark_metrics", f"with {PREDS}, m as (select source, case when gold = 'en' then '0' else gold end as g, case when pred = 'en' then '0' else pred end as p from preds), c as (select source, count(*) as n, sum((g = p)::INT) as ok, sum((g = p and g <> '0')::INT) as tp, sum((p <> '0')::INT) as pp, sum((g <> '0')::INT) as gg from m group by source) select source, n::BIGINT as n, round(ok / n, 6) as acc, round(case when tp = 0 then 0 else 2 * tp / (pp + gg) end, 6) as f1 from c")
def _(spark, d):
    # English plays the part of the empty label
    z = lambda c: F.when(F.col(c) == "en", "0").otherwise(F.col(c))
    return N.mark_metrics(predictions(spark, d).select("source", z("gold").alias("g"), z("pred").alias("p")), "g", "p", ["source"])


@query("n12_per_mark", f"""with {PREDS}, m as (select source, case when gold = 'en' then '0' else gold end as g, case when pred = 'en' then '0' else pred end as p from preds),
 l as (select source, unnest([g, p]) as mark, unnest([(g = p)::INT, 0]) as tp, unnest([1, 0]) as g, unnest([0, 1]) as p from m), s as (select source, mark, sum(tp) as tp, sum(g) as g, sum(p) as p from l where mark <> '0' group by all)
select mark, round(2 * sum(tp) / sum(g + p), 6) as pooled, round(avg(2 * tp / (g + p)), 6) as by_group from s group by mark""")
def _(spark, d):
    z = lambda c: F.when(F.col(c) == "en", "0").otherwise(F.col(c))
    return N.per_mark_f1(predictions(spark, d).select("source", z("gold").alias("g"), z("pred").alias("p")), "g", "p", "source")


@query("n17_zero_shot", f"""with l as (select doc_id, lang, unnest([0, 1, 2, 3]) as idx, unnest(['de','en','es','fr']) as lab from documents), s as (select *, round({q.u(17, 'doc_id', 'idx')} * 0.8 + (lab = lang)::INT * 0.3, 2) as score, list_position(['de','en','es','fr'], lang) - 1 as gold from l),
 b as (select doc_id, any_value(gold) as gold, arg_max(idx, score * 1000 - idx * 0.001) as best from s group by doc_id) select count(*)::BIGINT as n, round(avg((best = gold)::INT), 6) as acc from b""")
def _(spark, d):
    labs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    l = docs(spark, d, "doc_id", "lang").select("doc_id", "lang", F.posexplode(labs).alias("idx", "lab"))
    s = l.select("doc_id", "idx", (F.array_position(labs, F.col("lang")) - 1).alias("gold"), F.round(K.u(17, "doc_id", "idx") * 0.8 + (F.col("lab") == F.col("lang")).cast("int") * 0.3, 2).alias("score"))
    return N.zero_shot(s, "doc_id", "idx", "gold", "score")


@query("n20_by_functionality", f"with {SCORES} select source, count(*)::BIGINT as n, round(avg(((score >= 0.5)::INT = gold)::INT), 6) as acc from scores group by source")
def _(spark, d):
    return N.binary_metrics(scores(spark, d), by=["source"]).select("source", "n", "acc")


CATS = ["violence", "fraud", "spam"]
CATSQL = f"""cs as (select doc_id, unnest(['violence','fraud','spam']) as category from documents join labels using (doc_id) where quality = 1), scores as (select category, ({q.u(91, 'doc_id', 'category')} < 0.3)::INT as gold, round((1 - {q.u(91, 'doc_id', 'category')}) * 0.5 + {q.u(92, 'doc_id', 'category')} * 0.5, 2) as score from cs)"""


@query("n21_category_metrics", f"""with {CATSQL}, {bin_sql('category')}, {sweep_sql('category')}, bf as (select category, max(f1) as best_f1 from swm group by category)
select category, n, pos, round(f1, 6) as f1, round(auc, 6) as auc, round(best_f1, 6) as best_f1 from bm join (select category, auc from {auc_sql('category')}) using (category) join bf using (category) where pos >= 10""")
def _(spark, d):
    t = table(spark, d, "labels").where("quality = 1").select("doc_id")
    g = lambda c: K.u(91, "doc_id", F.lit(c))
    cats = F.array_compact(F.array(*[F.when(g(c) < 0.3, F.lit(c)) for c in CATS]))
    sc = F.create_map(*[x for c in CATS for x in (F.lit(c), F.round((1 - g(c)) * 0.5 + K.u(92, "doc_id", F.lit(c)) * 0.5, 2))])
    return N.category_metrics(t.select(cats.alias("cats"), sc.alias("sc")), "cats", CATS, "sc", GRID)


@query("n22_restricted", f"""with l as (select doc_id, unnest(['de','en','es','fr']) as lab from documents), s as (select *, round({q.u(22, 'doc_id', 'lab')}, 1) as score from l where lab in ('de','fr','es'))
select doc_id, lab as pred from s qualify row_number() over (partition by doc_id order by score desc, lab) = 1""")
def _(spark, d):
    l = docs(spark, d, "doc_id").select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("lab"))
    return N.restricted_argmax(l.withColumn("score", F.round(K.u(22, "doc_id", "lab"), 1)), "doc_id", "lab", "score", ["de", "fr", "es"])


@query("n24_score_agreement", f"with {SCORES}, j as (select score as a, round(score * 4) / 4 as b from scores) select count(*)::BIGINT as n, round(avg(((a >= 0.5) = (b >= 0.5))::INT), 6) as same, round(avg(abs(a - b)), 6) as mean_diff, round(max(abs(a - b)), 6) as max_diff from j")
def _(spark, d):
    s = scores(spark, d)
    return N.score_agreement(s, s.withColumn("score", F.round(F.col("score") * 4) / 4), "doc_id")


# ---- result tables: three systems on the sources as sets, value = share of correct rows --------------------------------

RES = f"""res as (select model, source as set, lang, 'acc' as metric, round(avg((({q.u(100, 'doc_id', 'model')}) < case model when 'org/small/' then 0.7 when 'org/base/best' then 0.8 else 0.75 end)::INT), 9) as value
 from (select doc_id, source, lang, unnest(['org/small/', 'org/base/best', 'org/large_20260101']) as model from documents) group by model, source, lang),
 rs as (select model, set, metric, round(avg(value), 6) as value from res group by all)"""


def results(spark, d, by_lang=False):
    t = docs(spark, d, "doc_id", "source", "lang").withColumn("model", F.explode(F.array(*[F.lit(x) for x in ("org/small/", "org/base/best", "org/large_20260101")])))
    cut = F.when(F.col("model") == "org/small/", 0.7).when(F.col("model") == "org/base/best", 0.8).otherwise(0.75)
    r = t.groupBy("model", F.col("source").alias("set"), "lang").agg(F.round(F.avg((K.u(100, "doc_id", "model") < cut).cast("int")), 9).alias("value")).withColumn("metric", F.lit("acc"))
    return r if by_lang else r.groupBy("model", "set", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


@query("n25_macro", f"with {RES} select model, round(avg(value), 6) as macro, count(*)::BIGINT as n from rs where set in ('src1', 'src2', 'src3') group by model")
def _(spark, d):
    spec = docs(spark, d, "source").where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("set"), F.lit("acc").alias("metric")).distinct()
    return N.macro(results(spark, d), spec)


@query("n25_gates", f"with {RES} select model, min((value >= 0.68)::INT)::BIGINT as passed from rs where set in ('src1', 'src2') group by model")
def _(spark, d):
    spec = docs(spark, d, "source").where("source in ('src1', 'src2')").select(F.col("source").alias("set"), F.lit("acc").alias("metric"), F.lit(0.68).alias("minimum")).distinct()
    return N.gates(results(spark, d), spec)


@query("n26_leaderboard", f"""with {RES}, w as (select model, max(value) filter (set = 'src1') as src1, max(value) filter (set = 'src2') as src2, max(value) filter (set = 'src3') as src3 from rs group by model)
select model, src1, src2, src3, round((src1 + src2 + src3) / 3, 6) as macro from w""")
def _(spark, d):
    return N.leaderboard(results(spark, d), ["src1", "src2", "src3"])


@query("n27_clean_names", f"with {RES} select distinct model, case model when 'org/small/' then 'small' when 'org/base/best' then 'base' else 'large' end as name from rs")
def _(spark, d):
    return results(spark, d).select("model", N.clean_names("model").alias("name")).distinct()


@query("n28_snapshot_diff", """with a as (select user_id, count(*) as n from events where ts < '2024-01-20' group by 1), b as (select user_id, count(*) as n from events where ts < '2024-01-10' and user_id % 5 <> 0 group by 1)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, 0)::BIGINT as current, coalesce(b.n, 0)::BIGINT as previous, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT as delta from a full join b on a.user_id = b.user_id""")
def _(spark, d):
    e = table(spark, d, "events", "user_id", "ts")
    cnt = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return N.snapshot_diff(cnt(e.where("ts < timestamp'2024-01-20'")), cnt(e.where("ts < timestamp'2024-01-10' and user_id % 5 <> 0")), "user_id", "n")


@query("n29_ahead", f"with {RES} select r.set, string_agg(r.model, ',' order by r.model) as models from rs r join rs m on m.set = r.set and m.model = 'org/small/' where r.value > m.value group by r.set")
def _(spark, d):
    return N.ahead(results(spark, d), "org/small/")


@query("n30_best_per_set", f"with {RES} select set, model, round(value, 6) as value from rs qualify rank() over (partition by set order by value desc nulls last) = 1")
def _(spark, d):
    return N.best_per_set(results(spark, d))


@query("n31_paired", f"""with {RES}, l as (select model, lang, avg(value) as value from res group by all), p as (select lang, max(value) filter (model = 'org/base/best') as a, max(value) filter (model = 'org/small/') as b from l group by lang)
select lang, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as gap, (abs(a - b) >= 0.1)::INT::BIGINT as large from p""")
def _(spark, d):
    per = results(spark, d, by_lang=True).groupBy("model", "lang").agg(F.avg("value").alias("value"))
    return N.paired(per, "org/base/best", "org/small/", 0.1)


@query("n32_ablation", f"with {SCORES}, s2 as (select gold, score, round(score * 0.5 + {q.u(32, 'doc_id')} * 0.5, 2) as other from scores) select w.n, round(w.auc, 6) as auc_with, round(o.auc, 6) as auc_without, round(w.auc - o.auc, 6) as delta from {auc_sql('', 'score', 's2')} w, {auc_sql('', 'other', 's2')} o")
def _(spark, d):
    t = scores(spark, d).withColumn("other", F.round(F.col("score") * 0.5 + K.u(32, "doc_id") * 0.5, 2))
    return N.ablation(t, "score", "other")


@query("n33_subset_rate", f"with {SCORES}, dim as (select doc_id, case when n_chars > 2000 then 'long' else 'short' end as subset from documents where doc_id % 3 <> 0) select coalesce(subset, 'rest') as subset, count(*)::BIGINT as n, sum((score >= 0.5)::INT)::BIGINT as flagged, round(avg((score >= 0.5)::INT), 6) as rate from scores left join dim using (doc_id) group by 1")
def _(spark, d):
    dim = docs(spark, d, "doc_id", "n_chars").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("subset"))
    return N.subset_rate(scores(spark, d), dim, "doc_id", "subset")
