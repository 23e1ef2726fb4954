"""Spark ML models and the scorer seam."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.operators import metrics as N
from glyphmill.operators import ml as M
from glyphmill.operators import sampling as E

from . import query
from . import sqlkit as q
from .common import docs, labelled, table
from .q_n_metrics import _regression


def _lid(spark, d):
    return E.split_hash(docs(spark, d, "doc_id", "lang", "text"), ["doc_id"], 0.2, 1)


# a model's figures move with the library's versions; what has to hold is how many rows they cover, and a floor
@query("p1_language_id", f"select count(*)::BIGINT as n, 1::BIGINT as accurate from documents where {q.u(1, 'doc_id')} < 0.2")
def _(spark, d):
    t = _lid(spark, d)
    m = M.train_lid(t.where("split = 'train'"), "text", "lang")
    r = N.multiclass(m.transform(t.where("split = 'val'")), "lang", "pred", classes=["de", "en", "es", "fr"])
    return r.select("n", (F.least("acc", "macro_f1") >= 0.9).alias("accurate"))


def _soft(spark, d):
    t = labelled(spark, d, "text", "lang")
    return E.split_hash(t.withColumn("soft", F.col("quality") * 0.8 + 0.1), ["doc_id"], 0.2, 2)


@query("p2_binary_classifier", f"select count(*)::BIGINT as n, 1::BIGINT as accurate from documents join labels using (doc_id) where {q.u(2, 'doc_id')} < 0.2")
def _(spark, d):
    t = _soft(spark, d)
    m = M.train_binary(t.where("split = 'train'"), "text", "quality", "soft", 0.5)
    return N.auc(m.transform(t.where("split = 'val'")), "quality", "score").select("n", (F.col("auc") >= 0.9).alias("accurate"))


@query("p3_multilabel", f"""with v as (select quality, toxic from documents join labels using (doc_id) where {q.u(2, 'doc_id')} < 0.2), l as (select 'quality' as label, quality as gold from v union all select 'toxic', toxic from v)
select label, count(*)::BIGINT as n, sum(gold)::BIGINT as pos, 1::BIGINT as accurate from l group by label""")
def _(spark, d):
    t = _soft(spark, d)
    models = M.train_multilabel(t.where("split = 'train'"), "text", ["quality", "toxic"])
    out = None
    for label, m in models.items():
        x = m.transform(t.where("split = 'val'")).select(F.lit(label).alias("label"), F.col(label).alias("gold"), "score")
        out = x if out is None else out.unionByName(x)
    # few toxic rows are labelled: their floor is lower
    found = N.auc(out, by=["label"]).select("label", (F.col("auc") >= F.when(F.col("label") == "toxic", 0.55).otherwise(0.9)).alias("accurate"))
    return N.binary_metrics(out, by=["label"]).join(found, "label").select("label", "n", "pos", "accurate")


@query("p4_regressor", f"select count(*)::BIGINT as n, 1::BIGINT as accurate from documents where {q.u(4, 'doc_id')} < 0.2")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text", "lang").withColumn("target", F.when(F.col("lang") == "en", 4.0).otherwise(1.0) + K.u(4, "doc_id"))
    t = E.split_hash(t, ["doc_id"], 0.2, 4)
    m = M.train_regressor(t.where("split = 'train'"), "text", "target")
    s = m.transform(t.where("split = 'val'"))
    return N.regression_metrics(s, "target", "score").select("n", (F.col("spearman") >= 0.4).alias("accurate"))


@query("p5_score_and_filter")
def _(spark, d):
    t = _soft(spark, d)
    m = M.train_binary(t.where("split = 'train'"), "text", "quality")
    kept = M.score_and_filter(docs(spark, d, "doc_id", "lang", "text"), m, 0.5)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _upper_share():
    """A stand-in scorer: share of capitals."""
    return lambda texts: [sum(c.isupper() for c in t) / max(1, len(t)) for t in texts]


@query("p6_score_batches", r"select doc_id, round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / greatest(length(text), 1), 6) as score from documents")
def _(spark, d):
    return M.score_batches(docs(spark, d, "doc_id", "text"), "text", _upper_share).select("doc_id", "score")
