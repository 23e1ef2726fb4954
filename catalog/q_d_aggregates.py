"""Dedup, conflicts, annotator votes, profiles, set operations, sorts."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import dedup as D
from glyphmill.operators import profile as P
from glyphmill.operators import ranking as R
from glyphmill.operators import sampling as E

from . import query
from . import sqlkit as q
from .common import PREDS, SCORES, docs, labelled, predictions, scores, table


@query("d1a_dedup_exact", "select min(doc_id) as doc_id from documents group by text")
def _(spark, d):
    return D.dedup(docs(spark, d, "doc_id", "text"), ["text"], "doc_id").select("doc_id")


@query("d1b_dedup_norm", f"select min(doc_id) as doc_id from documents group by {q.k1('text')}")
def _(spark, d):
    return D.dedup_norm(docs(spark, d, "doc_id", "text"), "text", "doc_id").select("doc_id")


@query("d1c_dedup_pair", "select min(doc_id) as doc_id from documents group by text, lang, source")
def _(spark, d):
    return D.dedup(docs(spark, d, "doc_id", "text", "lang", "source"), ["text", "lang", "source"], "doc_id").select("doc_id")


CONF = "t as (select doc_id, text, quality from documents join labels using (doc_id) union all select doc_id + 1000000, upper(text), 1 - quality from documents join labels using (doc_id) where doc_id % 37 = 0)"


def _conflicted(spark, d):
    t = labelled(spark, d, "text").select("doc_id", "text", "quality")
    bad = t.where("doc_id % 37 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.upper("text").alias("text"), (1 - F.col("quality")).alias("quality"))
    return t.unionByName(bad)


@query("d2a_drop_conflicts", f"with {CONF} select doc_id, quality::BIGINT as quality from t where {q.k1('text')} not in (select {q.k1('text')} from t group by 1 having min(quality) <> max(quality))")
def _(spark, d):
    return D.drop_conflicts(_conflicted(spark, d), K.norm_key("text"), "quality").select("doc_id", "quality")


@query("d2a_conflicts_and_dedup", f"with {CONF} select min(doc_id) as doc_id from t group by {q.k1('text')} having min(quality) = max(quality)")
def _(spark, d):
    return D.drop_conflicts(_conflicted(spark, d), K.norm_key("text"), "quality", keep_one="doc_id").select("doc_id")


@query("d3a_source_dedup", f"select min(doc_id) as doc_id, source from documents where length(text) >= 40 group by source, {q.k1('text')}")
def _(spark, d):
    return D.dedup(docs(spark, d, "doc_id", "source", "text").where(F.length("text") >= 40), [F.col("source"), K.norm_key("text")], "doc_id").select("doc_id", "source")


@query("d4a_unique_both", f"""with t as (select 'd' || doc_id as id, source, length(text) // 2 as n, text from documents),
 a as (select * from t qualify row_number() over (partition by {q.k1('substr(text, 1, n)')} order by id) = 1),
 b as (select * from a qualify row_number() over (partition by {q.k1('substr(text, n + 1)')} order by id) = 1)
select id, source from b qualify row_number() over (partition by source order by id) <= 12""")
def _(spark, d):
    # the two sides are the halves of the text; ids are strings
    n = F.floor(F.length("text") / 2).cast("int")
    t = docs(spark, d, "doc_id", "source", "text").select(F.concat(F.lit("d"), "doc_id").alias("id"), "source", F.col("text").substr(F.lit(1), n).alias("a"), F.col("text").substr(n + 1, F.length("text")).alias("b"))
    return D.unique_both(t, "a", "b", "source", 12, "id").select("id", "source")


@query("d5a_majority", """select user_id, round(avg(v), 6) as mean_label, count(*)::BIGINT as votes, arg_min(event_type, event_id) as event_type, (avg(v) > 0.5)::INT::BIGINT as label
from (select *, (value > 10)::INT as v from events) group by user_id having avg(v) <> 0.5""")
def _(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumn("v", (F.col("value") > 10).cast("int"))
    return D.majority(e, "user_id", "v", "event_type", "event_id")


@query("d6a_profile", """select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' when grouping(toxic) = 0 then 'toxic' else 'total' end as dim,
 coalesce(lang, source, toxic::VARCHAR, '') as value, count(*)::BIGINT as n, round(avg(quality), 6) as mean_label
 from documents join labels using (doc_id) group by grouping sets ((lang), (source), (toxic), ())""")
def _(spark, d):
    from glyphmill.sources import build_report

    return build_report(labelled(spark, d, "lang", "source"), ["lang", "source", "toxic"], "quality")


@query("d7a_crosstab", """select source, sum((lang = 'de')::INT)::BIGINT as de, sum((lang = 'en')::INT)::BIGINT as en, sum((lang = 'es')::INT)::BIGINT as es, sum((lang = 'fr')::INT)::BIGINT as fr from documents group by source""")
def _(spark, d):
    return P.crosstab(docs(spark, d, "source", "lang"), "source", "lang", ["de", "en", "es", "fr"])


@query("d8a_top_chars", r"""with c as (select lang, unnest(string_split(lower(regexp_replace(text, '[^\p{L}]+', '', 'g')), '')) as ch from documents)
select lang, ch, count(*)::BIGINT as n, (row_number() over (partition by lang order by count(*) desc, ch))::BIGINT as rank from c where ch <> '' group by lang, ch qualify rank <= 15""")
def _(spark, d):
    return P.top_chars(docs(spark, d, "lang", "text"), "text", "lang", 15)


@query("d9a_confusion", f"with {PREDS} select source, gold, pred, count(*)::BIGINT as n from preds group by all")
def _(spark, d):
    return P.confusion(predictions(spark, d), "gold", "pred", ["source"])


@query("d10a_rollup_means", f"""with {SCORES}, a as (select source, lang, avg(score) as v from scores group by all), b as (select source, avg(v) as v from a group by source)
select 2::BIGINT as level, source || '/' || lang as key, round(v, 6) as value from a union all select 1, source, round(v, 6) from b union all select 0, '', round(avg(v), 6) from b""")
def _(spark, d):
    return P.rollup_means(scores(spark, d), ["source", "lang"], "score")


@query("d10a_pooled_mean", f"with {SCORES} select round(avg(score), 6) as value from scores")
def _(spark, d):
    return P.pooled_mean(scores(spark, d), "score")


@query("d11a_span_counts", r"""with s as (select unnest(regexp_extract_all(text, '\d+')) as m from documents) select case when length(m) > 3 then 'LONG_NUMBER' else 'NUMBER' end as label, count(*)::BIGINT as n from s group by 1""")
def _(spark, d):
    m = F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))
    spans = F.transform(m, lambda x: F.struct(F.when(F.length(x) > 3, "LONG_NUMBER").otherwise("NUMBER").alias("label")))
    return P.span_counts(docs(spark, d, "text").select(spans.alias("spans")))


@query("d12a_distinct_label_sets", "select distinct lang, case when n_chars > 500 then 'topic,tone' else 'topic' end as labels, 'About {}.' as template from documents")
def _(spark, d):
    labels = F.when(F.col("n_chars") > 500, F.array(F.lit("topic"), F.lit("tone"))).otherwise(F.array(F.lit("topic")))
    t = docs(spark, d, "lang", "n_chars").select("lang", labels.alias("labels"), F.lit("About {}.").alias("template"))
    return P.distinct_label_sets(t, ["lang", "labels", "template"]).select("lang", F.array_join("labels", ",").alias("labels"), "template")


# ---- set operations ---------------------------------------------------------------------------------------------------

@query("f1_union_versions", "select doc_id as id, 'documents' as source, lang from documents union all select conv_id * 100 + turn, 'conversations', null from conversations")
def _(spark, d):
    a = docs(spark, d, "doc_id", "lang").select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"), "lang")
    b = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit("conversations").alias("source"), "role")
    return D.union_versions([a, b], ["id", "source", "lang"])


@query("f2_sentence_except", f"""with t as (select c.conv_id, c.turn, {q.sents('c.text')} as a, {q.sents("coalesce(e.text, '')")} as b from conversations c left join conversations e on e.conv_id = c.conv_id and e.turn = c.turn + 2)
select conv_id, turn, len(list_distinct([x for x in a if not list_contains(b, x)]))::BIGINT as n from t""")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    e = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    t = c.join(e, ["conv_id", "turn"], "left").fillna({"other": ""})
    return t.select("conv_id", "turn", F.size(D.sentence_except("text", "other")).alias("n"))


@query("f3_rows_not_in", "select doc_id, lang from documents where (lang, source) not in (select lang, source from documents join labels using (doc_id) where toxic = 1)")
def _(spark, d):
    return D.rows_not_in(docs(spark, d, "doc_id", "lang", "source"), labelled(spark, d, "lang", "source").where("toxic = 1"), ["lang", "source"]).select("doc_id", "lang")


@query("f4_label_union", "select lang as label from documents union select event_type from events")
def _(spark, d):
    return D.label_union([docs(spark, d, "lang").withColumnRenamed("lang", "label"), table(spark, d, "events", "event_type").withColumnRenamed("event_type", "label")], "label")


# ---- sorts, limits, top-k ---------------------------------------------------------------------------------------------

@query("g1_rank_candidates", f"with {SCORES} select (doc_id // 16)::BIGINT as qid, doc_id, (row_number() over (partition by doc_id // 16 order by score desc, doc_id))::BIGINT as rank from scores")
def _(spark, d):
    return R.rank_candidates(scores(spark, d).withColumn("qid", F.floor(F.col("doc_id") / 16)), "qid", "score", "doc_id").select("qid", "doc_id", "rank")


@query("g4_top_flagged", f"with {SCORES} select doc_id, round(greatest(score, {q.u(8, 'doc_id')}), 6) as top from scores order by greatest(score, {q.u(8, 'doc_id')}) desc, doc_id limit 25")
def _(spark, d):
    t = scores(spark, d).withColumn("other", K.u(8, "doc_id"))
    return R.top_flagged(t, ["score", "other"], 25, "doc_id").select("doc_id", "top")


@query("g5_worst_groups", f"with {SCORES} select source, round(avg(score), 6) as value from scores group by source order by avg(score), source limit 5")
def _(spark, d):
    return E.worst(scores(spark, d).groupBy("source").agg(F.avg("score").alias("value")), "value", 5, "source")


@query("g5_below_cut", f"with {SCORES} select lang, round(avg(score), 6) as value from scores group by lang having avg(score) < 0.36")
def _(spark, d):
    return scores(spark, d).groupBy("lang").agg(F.avg("score").alias("value")).where("value < 0.36")


@query("g6_pool_caps", f"select doc_id, lang from documents qualify row_number() over (partition by lang order by {q.h32(16, 'doc_id')}, doc_id) <= case when lang = 'en' then 200 else 50 end")
def _(spark, d):
    return E.quota(docs(spark, d, "doc_id", "lang"), ["lang"], 50, 16, ["doc_id"], overrides={"en": 200})
