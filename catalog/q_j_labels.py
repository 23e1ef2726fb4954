"""Teacher scores, soft labels, calibration."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import labels as J

from . import query
from . import sqlkit as q
from .common import SCORES, docs, labelled, scores, table

# answer log-probabilities: six tokens per document with hashed probabilities
TOKENS = ["Yes", "yes ", "No", "neg", "neutral", "positi", "3", "5", "0", "A", "B", "C"]
TOK_SQL = "[" + ",".join(f"'{t}'" for t in TOKENS) + "]"
LP = f"lp as (select doc_id, token, ln({q.u(61, 'doc_id', 'token')} + 0.001) as logprob from (select doc_id, unnest({TOK_SQL}) as token from documents) where {q.u(62, 'doc_id', 'token')} < 0.5)"


def logprobs(spark, d):
    t = docs(spark, d, "doc_id").withColumn("token", F.explode(F.array(*[F.lit(x) for x in TOKENS]))).where(K.u(62, "doc_id", "token") < 0.5)
    return t.withColumn("logprob", F.log(K.u(61, "doc_id", "token") + 0.001))


@query("j1_class_probs", f"""with {LP}, t as (select doc_id, lower(trim(token)) as t, exp(logprob) as p from lp), s as (select doc_id, sum(case when length(t) >= 3 and starts_with('negative', t) then p else 0 end) as a,
 sum(case when length(t) >= 3 and starts_with('neutral', t) then p else 0 end) as b, sum(case when length(t) >= 3 and starts_with('positive', t) then p else 0 end) as c from t group by doc_id)
select doc_id, round(case when a + b + c > 0 then a / (a + b + c) else 1 / 3 end, 6) as negative, round(case when a + b + c > 0 then b / (a + b + c) else 1 / 3 end, 6) as neutral, round(case when a + b + c > 0 then c / (a + b + c) else 1 / 3 end, 6) as positive from s""")
def _(spark, d):
    return J.class_probs(logprobs(spark, d), ["doc_id"], ["negative", "neutral", "positive"])


@query("j2_p_yes", f"""with {LP}, s as (select doc_id, sum(case when lower(trim(token)) = 'yes' then exp(logprob) else 0 end) as y, sum(case when lower(trim(token)) = 'no' then exp(logprob) else 0 end) as n from lp group by doc_id)
select doc_id, round(case when y + n > 0 then y / (y + n) else 0.5 end, 6) as p_yes from s""")
def _(spark, d):
    return J.p_yes(logprobs(spark, d), ["doc_id"])


@query("j3_expected_score", f"""with {LP}, s as (select doc_id, sum(trim(token)::INT * exp(logprob)) / sum(exp(logprob)) as score from lp where regexp_matches(trim(token), '^[0-5]$') group by doc_id) select doc_id, round(score, 6) as score from s""")
def _(spark, d):
    return J.expected_score(logprobs(spark, d), ["doc_id"]).where("score is not null")


@query("j4_choice_probs", f"""with {LP}, s as (select doc_id, sum(case when token = 'A' then exp(logprob) else 0 end) as a, sum(case when token = 'B' then exp(logprob) else 0 end) as b, sum(case when token = 'C' then exp(logprob) else 0 end) as c from lp where length(trim(token)) = 1 group by doc_id)
select doc_id, round(case when a + b + c > 0 then a / (a + b + c) else 1 / 3 end, 6) as "A", round(case when a + b + c > 0 then b / (a + b + c) else 1 / 3 end, 6) as "B", round(case when a + b + c > 0 then c / (a + b + c) else 1 / 3 end, 6) as "C" from s""")
def _(spark, d):
    return J.choice_probs(logprobs(spark, d), ["doc_id"], 3)


@query("j5_soft_targets", f"""with t as (select doc_id, toxic, {q.u(65, 'doc_id')} as pu, {q.u(66, 'doc_id')} * 0.5 as pc from labels), s as (select *, least(greatest(pu + 0.5 * pc, 0), 1) as soft from t)
select doc_id, round(soft, 6) as soft, round(0.7 * soft + 0.3 * toxic, 6) as mixed, round(greatest(soft, toxic), 6) as upper, (soft > 0.5)::INT::BIGINT as hard from s""")
def _(spark, d):
    t = table(spark, d, "labels").withColumn("pu", K.u(65, "doc_id")).withColumn("pc", K.u(66, "doc_id") * 0.5)
    s = t.withColumn("soft", J.soft_target("pu", "pc"))
    return s.select("doc_id", "soft", J.mix("soft", "toxic", 0.7).alias("mixed"), F.greatest("soft", F.col("toxic").cast("double")).alias("upper"), J.harden("soft").alias("hard"))


@query("j6_agreement", f"with {SCORES} select source, count(*)::BIGINT as n, round(avg(((score > 0.5)::INT = gold)::INT), 6) as agree, round(avg(score), 6) as mean_soft from scores group by source")
def _(spark, d):
    return J.agreement(scores(spark, d), "score", "gold", ["source"])


# pooling of adjacent violators per distinct score, spelled as the max-min formula for isotonic regression
ISO = f"""{SCORES}, g as (select score as x, avg(gold) as y, count(*) as w from scores group by score), o as (select *, sum(w) over (order by x) as cw, sum(w * y) over (order by x) as cy from g),
 pr as (select a.x as xi, b.x as xj, c.x as x, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) as m from o a join o b on a.x <= b.x join o c on c.x between a.x and b.x),
 mn as (select x, xi, min(m) as m from pr group by x, xi), iso as (select x, max(m) as yhat from mn group by x)"""


@query("j7_pav_fit", f"with {ISO} select round(max(iso.x), 6) as x_max, round(sum(g.w * g.y) / sum(g.w), 6) as y_mean, sum(g.w)::BIGINT as n from iso join g on g.x = iso.x group by round(yhat, 12)")
def _(spark, d):
    return J.pav_fit(scores(spark, d), "score", "gold")


@query("j7_pav_apply", f"with {ISO} select s.doc_id, round(iso.yhat, 6) as calibrated from scores s join iso on iso.x = s.score")
def _(spark, d):
    s = scores(spark, d)
    return J.pav_apply(s, J.pav_fit(s, "score", "gold"), "score", "calibrated").select("doc_id", "calibrated")


@query("j8_calibration_table", f"with {ISO}, p as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) as raw) select raw, round(coalesce((select min(yhat) from iso where x >= raw), (select max(yhat) from iso)), 6) as calibrated from p")
def _(spark, d):
    return J.calibration_table(J.pav_fit(scores(spark, d), "score", "gold"), [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


@query("j9_canon_labels", "select case lang when 'es' then 'fr' else lang end as label, count(*)::BIGINT as n from documents where lang <> 'de' group by 1")
def _(spark, d):
    c = J.canon("lang", {"es": "fr"}, ["de"])
    return docs(spark, d, "lang").withColumn("label", c).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


for _how in ("sum", "max"):
    @query(f"j10_group_scores_{_how}", f"""with l as (select doc_id, unnest(['joy','love','anger','fear']) as label from documents), s as (select *, {q.u(10, 'doc_id', 'label')} as score, case when label in ('joy','love') then 'pos' else 'neg' end as class from l)
select doc_id, class, round({_how}(score), 6) as score from s group by all""")
    def _(spark, d, _how=_how):
        l = docs(spark, d, "doc_id").withColumn("label", F.explode(F.array(*[F.lit(x) for x in ("joy", "love", "anger", "fear")])))
        mapping = l.select("label").distinct().withColumn("class", F.when(F.col("label").isin("joy", "love"), "pos").otherwise("neg"))
        return J.group_scores(l.withColumn("score", K.u(10, "doc_id", "label")), mapping, "doc_id", "label", "score", _how)


CLAIMS = f"""a as (select * from conversations where role = 'assistant'), it as (select conv_id, arg_min(text, turn) as sup, min(turn) as t0 from a group by conv_id),
 ss as (select conv_id, {q.sents('sup', 16)} as s from it), pos as (select distinct conv_id, unnest(s) as claim, 1 as label from ss),
 neg as (select distinct conv_id, claim, 0 as label from (select a.conv_id, unnest({q.sents('a.text', 16)}) as claim from a join it on it.conv_id = a.conv_id and a.turn > it.t0) x where not list_contains((select s from ss where ss.conv_id = x.conv_id), claim)),
 al as (select * from pos union all select * from neg), m as (select min(n) as n from (select count(*) as n from al group by label))"""


@query("j11_claim_pairs", f"with {CLAIMS} select conv_id, claim, label::BIGINT as label from al qualify row_number() over (partition by label order by {q.h32(0, 'conv_id', 'claim')}, conv_id, claim) <= (select n from m)")
def _(spark, d):
    # the first assistant answer is the supported one, later answers are the variants
    a = table(spark, d, "conversations").where("role = 'assistant'")
    it = a.groupBy("conv_id").agg(F.min_by("text", "turn").alias("supported"), F.min("turn").alias("t0")).withColumn("passage", F.lit(""))
    rest = a.join(it.select("conv_id", "t0"), "conv_id").where("turn > t0").select("conv_id", F.col("turn").alias("rid"), "text")
    return J.claim_pairs(it, rest, "conv_id").select("conv_id", "claim", "label")


@query("j13_scores_by_candidate", f"with {SCORES} select (doc_id // 16)::BIGINT as qid, md5(string_agg(round(score * 100)::INT::VARCHAR, ',' order by doc_id)) as h, count(*)::BIGINT as n from scores group by 1")
def _(spark, d):
    r = J.scores_by_candidate(scores(spark, d).withColumn("qid", F.floor(F.col("doc_id") / 16)), "qid", "doc_id", "score")
    ints = F.transform("scores", lambda x: F.round(x * 100).cast("int").cast("string"))
    return r.select("qid", F.md5(F.array_join(ints, ",")).alias("h"), F.size("scores").alias("n"))


W = {"a": 0.35, "b": 0.25, "c": 0.15, "d": 0.15, "e": 0.05, "f": 0.05}


@query("j14_composite", "select doc_id, round(" + " + ".join(f"{w} * {q.u('w' + k, 'doc_id')}" for k, w in W.items()) + ", 6) as composite, round((0 * " + q.u("wa", "doc_id") + " + 1 * " + q.u("wb", "doc_id") + " + 2 * " + q.u("wc", "doc_id") + ") / 2, 6) as level from documents")
def _(spark, d):
    t = docs(spark, d, "doc_id").select("doc_id", *[K.u("w" + k, "doc_id").alias(k) for k in W])
    return t.select("doc_id", J.composite(W).alias("composite"), J.weighted_class_value({"a": 0, "b": 1, "c": 2}, 2).alias("level"))


@query("j15_inherit_labels", "select t.lang as target, d.doc_id, coalesce(l.toxic, -1)::BIGINT as toxic from (select unnest(['German','French']) as lang) t, documents d left join labels l using (doc_id)")
def _(spark, d):
    tr = docs(spark, d, "doc_id").withColumn("target", F.explode(F.array(F.lit("German"), F.lit("French"))))
    return J.inherit_labels(tr, table(spark, d, "labels"), "doc_id", ["toxic"]).fillna({"toxic": -1}).select("target", "doc_id", "toxic")
