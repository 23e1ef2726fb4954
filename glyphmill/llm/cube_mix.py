"""Mixing sources to target weights by the cube method.

Every document of a source should be taken `target / size` times: that rate's whole part for certain, its fraction by balanced
sampling. The fractions are moved through the null space of the balancing constraints (tokens and documents of the source)
until they are 0 or 1: of three undecided documents some direction leaves both totals as they are, and a step to its end decides
at least one of them. The direction's sign is drawn so that every document keeps its probability.

A source is dealt into blocks of bounded size, which tasks settle side by side; at most two documents per block stay undecided
and meet in the blocks of the next round, until each source has one block left. There the landing drops the count constraint,
then rounds the last document to the nearer side. Draws depend on (seed, source, block, round) only, and rows are ordered by
their values, so reruns agree.

Cases: a null text has size 0; a null source is a source of its own, last in order; sources of size 0 have target 0; repeated
rows are taken each on their own; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import repeat_rows, row_key, saved

BLOCK = 1024
SCHEMA = "doc_id string, id string, h long, size long, key string, order long, base long, pi double"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A key that is never null and differs for the null source."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(key, source_size, n, target): one row per source; `sizes` has (source, key, size).

    Weights go by the order of the sources, repeating. Targets add up to `share` of all sizes; none exceeds `cap` times its
    source: there is one level t at which target = min(cap * size, t * weight), found from prefix sums in order of the ratio at
    which a source reaches its cap. The windows run over one row per source."""
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source, in order of ratio, that stays below its cap fixes the level; if share >= cap none does
    per = per.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole))
    target = F.least(F.col("most"), F.coalesce(F.col("at.level") * F.col("weight"), F.col("most")))
    return per.select("key", "source_size", "n", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Inclusion probabilities after the flight (and the landing, if `last`); sums of pi and of pi * size stay."""
    out = pi.copy()
    todo = [i for i in range(len(pi)) if 0 < pi[i] < 1][::-1]
    draws = iter(rng.random(len(todo) + 3).tolist())
    p, s = pi.tolist(), size.tolist()
    active: list[int] = []

    def step(u: list[float]) -> None:
        ups = [((1 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in zip(active, u) if d]
        downs = [(p[i] if d > 0 else (1 - p[i])) / abs(d) for i, d in zip(active, u) if d]
        up, down = min(ups), min(downs)
        move = up if next(draws) * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += move * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        active[:] = [i for i in active if 0 < p[i] < 1]

    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 3:
            break
        a, b, c = (s[i] for i in active)
        step([b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0])
    if len(active) == 2 and s[active[0]] == s[active[1]]:  # equal sizes: two documents are enough
        step([1.0, -1.0])
    if last and len(active) == 2:  # landing: tokens only
        a, b = (s[i] for i in active)
        step([b, -a] if a and b else [1.0, 0.0] if not a else [0.0, 1.0])
    if last:
        for i in active:
            p[i] = float(p[i] >= 0.5)
    out[:] = p
    return out


def _settle(seed: int, round_: int, last: bool):
    """The flight of one block as a function of its rows."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "order"], ascending=[False, True], ignore_index=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed} {round_} {frame['key'][0]} {frame['block'][0]}".encode()))
        frame["pi"] = flight(frame["pi"].to_numpy(), frame["size"].to_numpy("float64"), rng, last)
        return frame.drop(columns="block")

    return settle


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, id, h) of every row of docs(doc_id, source, text); id and h name the row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sizes = saved(docs.select("doc_id", *row_key(docs), "source", source_key("source").alias("key"), n_words("text").alias("size")), "mix-sizes")
    per = saved(targets(sizes, weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_rate = per.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn(
        "pi", F.when(F.col("rate") - F.col("whole") > 1e-9, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    rows = sizes.join(per_rate.select("key", "whole", "pi"), "key").select(
        F.col("doc_id").cast("string").alias("doc_id"), "id", "h", "size", "key", F.xxhash64(F.lit(seed), "id", "h").alias("order"), F.col("whole").cast("long").alias("base"), "pi")
    most = per.agg(F.max("n")).first()[0] or 0
    open_, done, round_ = rows.where("pi > 0"), [rows.where("pi = 0")], 0
    while True:
        # at most two rows per block stay open, so the next round has that many rows of a source at most
        last = most <= block
        counts = (per if round_ == 0 else open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).select("key", F.ceil(F.col("n") / block).alias("blocks"))
        dealt = open_.join(counts, "key").withColumn("block", F.pmod(F.shiftright("order", 3 * round_), F.col("blocks")).cast("long")).drop("blocks")

        out = saved(dealt.groupBy("key", "block").applyInPandas(_settle(seed, round_, last), SCHEMA), "mix-round")
        if last:
            done.append(out)
            break
        done.append(out.where("pi in (0, 1)"))
        open_ = out.where("pi not in (0, 1)")
        most, round_ = open_.groupBy("key").count().agg(F.max("count")).first()[0] or 0, round_ + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    copies = F.col("base") + F.col("pi").cast("long")
    return result.join(per.select("key", "source_size", "target"), "key").select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "id", "h")


def taken(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of the input."""
    counts = mix(docs, **how).groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    return repeat_rows(docs, counts, "mix-taken")
