"""Vectors, exact nearest neighbours inside a key, ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import _c, norm_key
from .ranking import top_k


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(dot(c, c))


def l2norm(c: Column | str) -> Column:
    n = norm(c)
    return F.transform(_c(c), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def _float(side: DataFrame) -> str:
    return "float32" if dict(side.dtypes)["vec"] == "array<float>" else "float64"


def _packed(side: DataFrame, counts: DataFrame, id_col: str, n: str) -> DataFrame:
    """(k, b, ids, own, vectors): hash blocks of a key's rows of side(k, <id>, own, vec), each one row with one binary matrix."""
    kind, width = side.schema["k"].dataType.simpleString(), _float(side)
    rows = side.join(counts.select("k", n), "k").select("k", F.pmod(F.xxhash64(id_col), F.col(n).cast("bigint")).cast("int").alias("b"), F.col(id_col).cast("long").alias("id"),
                                                        F.col("own").cast("long").alias("own"), F.col("vec").cast("array<double>").alias("vec"))

    def pack(block: pa.Table) -> pa.Table:
        ids, own = (block.column(c).combine_chunks().fill_null(-(1 << 63)).to_numpy().astype("int64").tobytes() for c in ("id", "own"))
        flat = pc.list_flatten(block.column("vec")).to_numpy()
        one = block.slice(0, 1).select(["k", "b"])
        for name, raw in (("ids", ids), ("own", own), ("vectors", flat.astype(width).tobytes())):
            one = one.append_column(name, pa.array([raw], pa.binary()))
        return one

    return rows.groupBy("k", "b").applyInArrow(pack, f"k {kind}, b int, ids binary, own binary, vectors binary")


def _block_top_k(k: int, of_q: str, of_p: str):
    def unit(raw: bytes, n: int, width: str) -> np.ndarray:
        x = np.frombuffer(raw, width).reshape(n, -1).astype("float64")
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a pair of blocks
                key = batch.column(0).slice(at, 1)
                qids, own, pids = (np.frombuffer(batch.column(c)[at].as_py(), "int64") for c in (1, 2, 4))
                Q, P = unit(batch.column(3)[at].as_py(), len(qids), of_q), unit(batch.column(5)[at].as_py(), len(pids), of_p)
                for s in range(0, len(Q), 512):
                    S = Q[s:s + 512] @ P.T
                    S[own[s:s + 512, None] == pids[None, :]] = -np.inf
                    m = min(k, S.shape[1])
                    floor = np.partition(S, S.shape[1] - m, axis=1)[:, S.shape[1] - m]
                    r, c = np.nonzero(S >= floor[:, None])  # ties at the k-th score all stay until they are ordered by id
                    sc = S[r, c]
                    o = np.lexsort((pids[c], -sc, r))
                    r, c, sc = r[o], c[o], sc[o]
                    keep = (np.arange(len(r)) - np.searchsorted(r, r) < m) & np.isfinite(sc)
                    r, c, sc = r[keep], c[keep], sc[keep]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([key] * len(r)) if len(r) else key.slice(0, 0), pa.array(qids[s + r]), pa.array(pids[c]), pa.array(sc)], ["k", "qid", "pid", "score"])

    return run


def _mined(queries: DataFrame, passages: DataFrame, k: int, block: int) -> DataFrame:
    """(k, qid, pid, score) of queries(k, qid, own, vec) and passages(k, pid, vec): the best k of every pair of blocks."""
    size = lambda d, name: d.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    counts = size(queries, "nq").join(size(passages, "np"), "k")
    q = _packed(queries.where("vec is not null"), counts, "qid", "nq").select(F.col("k").alias("k1"), F.col("ids").alias("qids"), "own", F.col("vectors").alias("of_q"))
    p = _packed(passages.where("vec is not null").withColumn("own", F.lit(0)), counts, "pid", "np").select(F.col("k").alias("k2"), F.col("b").alias("pb"), F.col("ids").alias("pids"), F.col("vectors").alias("of_p"))
    each = q.join(counts.select(F.col("k").alias("kc"), "np"), F.col("k1") == F.col("kc")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    pairs = each.join(p, (F.col("k1") == F.col("k2")) & (F.col("qp") == F.col("pb")))
    kind = queries.schema["k"].dataType.simpleString()
    return pairs.select("k1", "qids", "own", "of_q", "pids", "of_p").mapInArrow(_block_top_k(k, _float(queries), _float(passages)), f"k {kind}, qid long, pid long, score double")


def mine(queries: DataFrame, passages: DataFrame, k: int, by: str, block: int = 4096) -> DataFrame:
    """Exact top-k cosine neighbours inside a key: queries(qid, by, vec[, own]), passages(pid, by, vec) ->
    (qid, pid, score, rank), the query's own passage excluded, ties by pid.

    Both sides of a key are packed into hash blocks of about `block` rows, a block being one row with one binary matrix, so
    one large key becomes many small tasks. A passage block is shuffled once and a query block once per passage block of
    its key: with larger blocks fewer bytes move. A pair of blocks returns at most k rows per query; they are merged by rank."""
    own = F.col("own") if "own" in queries.columns else F.col("qid")
    q = queries.select(F.col(by).alias("k"), "qid", own.alias("own"), "vec")
    found = _mined(q, passages.select(F.col(by).alias("k"), "pid", "vec"), k, block).drop("k")
    return top_k(found, ["qid"], [F.col("score").desc(), F.col("pid").asc()], k)


def candidates(mined: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, cands): the source passage first, then the mined ones in rank order, at most k in all; a query without
    neighbours keeps its own passage."""
    g = mined.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "pid"))).alias("_l"))
    own = "own" if "own" in queries.columns else "qid"
    return queries.select("qid", F.col(own).alias("_own")).join(g, "qid", "left").select("qid", F.slice(F.when(F.col("_l").isNull(), F.array("_own")).otherwise(F.concat(F.array("_own"), F.col("_l.pid"))), 1, k).alias("cands"))


def ranking_metrics(df: DataFrame, qid: str, pos: str, rel: str, score: str, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """nDCG@k (gain 2^rel - 1) and MRR@k per query; ties by candidate position. Candidate lists are short by nature."""
    by = by or []
    key = [*by, qid]
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), pos)
    ideal = Window.partitionBy(*key).orderBy(F.col(rel).desc(), pos)
    r = df.withColumn("_r", F.row_number().over(w)).withColumn("_i", F.row_number().over(ideal))
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    at = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    first = F.min(F.when((F.col(rel) > 0) & (F.col("_r") <= k), F.col("_r")))
    g = r.groupBy(*key).agg(at("_r").alias("_d"), at("_i").alias("_b"), first.alias("_f"))
    return g.select(*key, F.when(F.col("_b") > 0, F.col("_d") / F.col("_b")).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.col("_f"), F.lit(0.0)).alias("mrr"))


def top1_agree(df: DataFrame, qid: str, pos: str, a: str, b: str) -> DataFrame:
    """Share of queries whose best candidate is the same under two scores."""
    best = lambda c: F.max(F.struct(F.col(c).alias("s"), (-F.col(pos)).alias("p")))["p"]
    g = df.groupBy(qid).agg(best(a).alias("_a"), best(b).alias("_b"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agree"))


def space_agreement(a: DataFrame, b: DataFrame, key: str, by: str, vec: str = "vec") -> DataFrame:
    """Mean cosine of the same items in two vector sets, and how often both have the same nearest neighbour."""
    j = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    cos = j.agg(F.count(F.lit(1)).alias("n"), F.avg(cosine("_a", "_b")).alias("mean_cosine"))
    # both sets are mined in one pass: the set is part of the key inside which neighbours are sought
    tagged = [d.select(F.concat(F.lit(f"{i}:"), F.col(by).cast("string")).alias("k"), F.col(key).alias("qid"), F.col(vec).alias("vec")) for i, d in enumerate((a, b))]
    rows = tagged[0].unionByName(tagged[1]).where("k is not null")
    best = top_k(_mined(rows.withColumn("own", F.col("qid")), rows.withColumnRenamed("qid", "pid"), 1, 4096), ["k", "qid"], [F.col("score").desc(), F.col("pid").asc()], 1)
    twice = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("low"), F.max("pid").alias("high")).where("n = 2")
    same = twice.agg(F.avg((F.col("low") == F.col("high")).cast("int")).alias("top1_agree"))
    return cos.crossJoin(same)


def faq_pool(df: DataFrame, question: str, answer: str, site: str, url: str, id_col: str, spam: str, q_len: tuple, a_len: tuple, cap: int) -> DataFrame:
    """Question/answer pool: length bands, no spam hosts, both sides unique, at most `cap` rows per site."""
    from .dedup import unique_both

    ok = F.length(question).between(*q_len) & F.length(answer).between(*a_len) & ~F.col(url).rlike(spam)
    return unique_both(df.where(ok), question, answer, site, cap, id_col)


def text_pool(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct texts of several columns with one provenance tag each: tables of (df, column, tag)."""
    out = None
    for df, col, tag in tables:
        t = df.select(F.col(col).alias("text"), F.lit(tag).alias("source"))
        out = t if out is None else out.unionByName(t)
    return out.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("source").alias("source"))
