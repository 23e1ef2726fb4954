"""Deduplication, label conflicts, decontamination and set operations.

Keys travel as 32-byte digests, survivors are found with partial aggregates of fixed width (no window over a group of
copies), and only keys that occur twice take part in the join back, so texts are not shuffled unless that table is
large; then the join is an ordinary shuffled one whose skewed left side AQE splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key, norm_ws, sentences, text_hash
from ..functions.units import explode_rows, pin


def _digest(cols: list[Column]) -> Column:
    """Digest of one text, or of a length-prefixed list of texts (NULL differs from '')."""
    if len(cols) == 1:
        return text_hash(F.coalesce(cols[0].cast("string"), F.lit("\x00")))
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in cols]
    return text_hash(F.concat(*parts))


def dedup(df: DataFrame, keys: list[Column | str], id_col: str) -> DataFrame:
    """Keep the row with the smallest id of every key."""
    k = _digest([F.col(c) if isinstance(c, str) else c for c in keys])
    keyed = df.withColumn("_k", k)
    twice = keyed.groupBy("_k").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (keyed.join(twice.select("_k", "_first"), "_k", "left")
            .where(F.col("_first").isNull() | (F.col(id_col) == F.col("_first"))).select(*df.columns))


def dedup_norm(df: DataFrame, text: str, id_col: str) -> DataFrame:
    return dedup(df, [norm_key(text)], id_col)


def drop_conflicts(df: DataFrame, key: Column, label: str, keep_one: str | None = None) -> DataFrame:
    """Drop every row of a key with more than one label; with keep_one=id also keep a single row per key, in the same pass."""
    keyed = df.withColumn("_k", _digest([key]))
    agg = [F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("_n")]
    if keep_one:
        agg.append(F.min(keep_one).alias("_first"))
    g = keyed.groupBy("_k").agg(*agg).where("_n > 1")
    j = keyed.join(g, "_k", "left")
    ok = F.col("_n").isNull() | F.col("_lo").eqNullSafe(F.col("_hi"))
    if keep_one:
        ok = ok & (F.col("_n").isNull() | (F.col(keep_one) == F.col("_first")))
    return j.where(ok).select(*df.columns)


def conflict_keys(df: DataFrame, key: Column, label: str) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where(
        "_lo <> _hi").select("key")


def eval_keys(evals: DataFrame, text: str, key=norm_key) -> DataFrame:
    return evals.select(_digest([key(text)]).alias("_k")).distinct()


def decontaminate(df: DataFrame, text: str, evals: DataFrame, eval_text: str = "text", key=norm_key) -> DataFrame:
    """Drop rows whose whole normalised text is in the evaluation set."""
    keyed = df.withColumn("_k", _digest([key(text)]))
    return keyed.join(eval_keys(evals, eval_text, key), "_k", "left_anti").select(*df.columns)


def decontaminate_pair(df: DataFrame, text: str, pair: str, evals: DataFrame, eval_text: str = "text") -> DataFrame:
    """Drop rows whose text, or non-empty second text, is in the evaluation set."""
    keys = eval_keys(evals, eval_text)
    p = F.when(F.length(F.coalesce(F.col(pair), F.lit(""))) > 0, _digest([norm_key(pair)]))
    keyed = df.withColumn("_k", _digest([norm_key(text)])).withColumn("_p", p)
    out = keyed.join(keys, "_k", "left_anti")
    return out.join(keys.withColumnRenamed("_k", "_p"), "_p", "left_anti").select(*df.columns)


def sentence_hits(df: DataFrame, id_col: str, text: str, evals: DataFrame, eval_text: str = "text", min_len: int = 25,
                  key=norm_key) -> DataFrame:
    """Ids of rows that hold at least one evaluation sentence longer than min_len."""
    long_ = lambda d, t: d.where(F.length(t) > min_len)
    es = explode_rows(evals, [], sentences(eval_text), "s").select("s")
    es = es.union(evals.select(F.col(eval_text).alias("s")))
    ek = long_(es, "s").select(_digest([key("s")]).alias("_k")).distinct()
    ds = explode_rows(df, [id_col], sentences(text), "s")
    # pinned: the join's test for nulls would make every key a second time
    return pin(long_(ds, "s"), "_k", _digest([key("s")])).select(id_col, "_k").join(ek, "_k", "left_semi").select(id_col).distinct()


def decontaminate_sentences(df: DataFrame, id_col: str, text: str, evals: DataFrame, eval_text: str = "text",
                            min_len: int = 25, key=norm_key) -> DataFrame:
    """Drop rows in which any sentence longer than min_len equals an evaluation sentence."""
    return df.join(sentence_hits(df, id_col, text, evals, eval_text, min_len, key), id_col, "left_anti")


def overlap_report(a: DataFrame, b: DataFrame, text_a: str, text_b: str, key=norm_key) -> DataFrame:
    """How many rows of a have their key in b; nothing is dropped."""
    ka = a.select(_digest([key(text_a)]).alias("_k"))
    hit = eval_keys(b, text_b, key).withColumn("_hit", F.lit(1))
    return ka.join(hit, "_k", "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("overlap"))


def merge_new(old: DataFrame, new: DataFrame, evals: DataFrame, text: str = "text", key=norm_key) -> DataFrame:
    """Old rows plus the new rows that are neither in an evaluation set nor in the old version."""
    fresh = decontaminate(decontaminate(new, text, evals, text, key), text, old, text, key)
    return old.unionByName(fresh, allowMissingColumns=True)


def unseen(evals: DataFrame, train: DataFrame, text: str, train_text: str) -> DataFrame:
    return decontaminate(evals, text, train, train_text)


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim, key, "left")


def unique_both(df: DataFrame, a: str, b: str, site: str, cap: int, id_col: str) -> DataFrame:
    """First row per a, then first row per b, then at most `cap` rows per site, in id order.

    Order of the rules is fixed (a, b, site); a first-come loop would interleave them."""
    from .ranking import top_k

    one = dedup(dedup(df, [norm_key(a)], id_col), [norm_key(b)], id_col)
    return top_k(one, [site], [F.col(id_col)], cap, "_rank").drop("_rank")


def majority(df: DataFrame, item: str, label: str, text: str | None = None, order: str | None = None) -> DataFrame:
    """Annotator aggregation of 0/1 votes: mean, votes, label by majority; ties dropped."""
    aggs = [F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("votes")]
    if text:
        aggs.append(F.min_by(text, order or text).alias(text))
    g = df.groupBy(item).agg(*aggs)
    return g.where("mean_label <> 0.5").withColumn("label", (F.col("mean_label") > 0.5).cast("int"))


# ---- set operations -------------------------------------------------------------------------------------------------

def union_versions(versions: list[DataFrame], cols: list[str]) -> DataFrame:
    """Union with a fixed column list; columns a version lacks become NULL."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out.select(*cols)


def sentence_except(variant: Column | str, base: Column | str) -> Column:
    """Sentences of the variant that do not occur in the base text."""
    return F.array_except(sentences(variant), sentences(base))


def rows_not_in(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    ka, kb = (d.withColumn("_k", _digest([F.col(c) for c in cols])) for d in (a, b))
    return ka.join(kb.select("_k").distinct(), "_k", "left_anti").select(*a.columns)


def label_union(tables: list[DataFrame], label: str) -> DataFrame:
    out = tables[0].select(label).distinct()
    for t in tables[1:]:
        out = out.union(t.select(label).distinct())
    return out.distinct().orderBy(label)
