"""Counts and roll-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Counts of b per a as columns; naming the values saves the pass that looks them up."""
    return df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def letter_counts(df: DataFrame, text: str, by: str) -> DataFrame:
    """(by, ch, n): occurrences of every letter, lower-cased.

    Every task adds up its own texts and returns one row per group and letter, so what is shuffled doesn't grow with the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = None
        for batch in batches:
            kind, groups = batch.schema.field(0).type, batch.column(0).to_pylist()
            texts: dict = {}
            for g, t in zip(groups, batch.column(1).to_pylist()):
                if t:
                    texts.setdefault(g, []).append(t)
            for g, ts in texts.items():
                chars, n = np.unique(np.frombuffer("".join(ts).encode("utf-32-le"), "<u4"), return_counts=True)
                own = total.setdefault(g, Counter())
                own.update(dict(zip(chars.tolist(), n.tolist())))
        rows = [(g, chr(c), n) for g, own in total.items() for c, n in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())], [by, "ch", "n"])

    letters = df.select(by, F.lower(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("_t"))
    counts = letters.mapInArrow(run, f"`{by}` {df.schema[by].dataType.simpleString()}, ch string, n long")
    return counts.groupBy(by, "ch").agg(F.sum("n").alias("n"))


def top_chars(df: DataFrame, text: str, lang: str, n: int = 80) -> DataFrame:
    """The n most frequent letters per language with counts and rank."""
    return top_k(letter_counts(df, text, lang), [lang], [F.col("n").desc(), F.col("ch").asc()], n)


def confusion(df: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), gold, pred).agg(F.count(F.lit(1)).alias("n"))


def rollup_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean per last key, then mean of those means one level up, and so on to the overall macro mean (not pooled)."""
    cur = df.groupBy(*keys).agg(F.avg(value).alias("value"))
    out = None
    for depth in range(len(keys), -1, -1):
        level = cur.select(F.lit(depth).alias("level"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys[:depth]]).alias("key"), "value")
        out = level if out is None else out.unionByName(level)
        if depth:
            cur = cur.groupBy(*keys[: depth - 1]).agg(F.avg("value").alias("value"))
    return out


def pooled_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("value"))


def span_counts(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.select(F.explode(spans).alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def distinct_label_sets(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()
