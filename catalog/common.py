"""Inputs shared by several queries: the given tables and tables that Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.keys import h32, u
from glyphmill.session import checkpoint_dir
from glyphmill.sources import read_table

from . import sqlkit as q


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return read_table(spark, d, name, list(cols) or None)


def docs(spark, d, *cols):
    return table(spark, d, "documents", *cols)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint area for queries that write and read back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/glyphmill-{uuid.uuid4().hex}"


def labelled(spark, d, *cols) -> DataFrame:
    return docs(spark, d, *({"doc_id", *cols})).join(table(spark, d, "labels"), "doc_id")


# ---- derived score table: gold = toxic, score in [0,1] with two decimals so that ties occur --------------------------

def scores(spark, d) -> DataFrame:
    """(doc_id, lang, source, n_chars, gold, score) derived from labels and a hash."""
    j = labelled(spark, d, "lang", "source", "n_chars")
    return j.select("doc_id", "lang", "source", "n_chars", F.col("toxic").alias("gold"),
                    F.round(F.col("toxic") * 0.35 + u(7, "doc_id") * 0.65, 2).alias("score"))


SCORES = f"""scores as (
  select d.doc_id, d.lang, d.source, d.n_chars, l.toxic as gold,
         round(l.toxic * 0.35 + {q.u(7, 'd.doc_id')} * 0.65, 2) as score
  from documents d join labels l using (doc_id))"""

LANGS = ["de", "en", "es", "fr"]


def predictions(spark, d) -> DataFrame:
    """(doc_id, source, gold, pred): the language, and for one row in five a hashed language instead."""
    arr = F.array(*[F.lit(x) for x in LANGS])
    other = F.element_at(arr, (F.pmod(h32(11, "doc_id"), F.lit(4)) + 1).cast("int"))
    return docs(spark, d, "doc_id", "lang", "source").select(
        "doc_id", "source", F.col("lang").alias("gold"),
        F.when(u(12, "doc_id") < 0.2, other).otherwise(F.col("lang")).alias("pred"))


PREDS = f"""preds as (
  select doc_id, source, lang as gold,
         case when {q.u(12, 'doc_id')} < 0.2 then ['de','en','es','fr'][({q.h32(11, 'doc_id')} % 4 + 1)::INT] else lang end as pred
  from documents)"""
