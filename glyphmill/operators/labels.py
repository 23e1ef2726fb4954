"""Teacher scores and labels: log-probabilities to soft labels, blending, calibration, claim pairs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import _c, sentences
from ..functions.units import explode_rows
from ..session import materialise
from .ranking import range_buckets
from .sampling import balance_to_min


def class_probs(df: DataFrame, item: list[str], classes: list[str], token: str = "token", lp: str = "logprob", min_len: int = 3) -> DataFrame:
    """(item, token, logprob) -> one probability column per class: a token counts for the classes it is a prefix of
    (min_len characters or more); rows without any hit are uniform."""
    t = F.lower(F.trim(token))
    hit = lambda c: F.when((F.length(t) >= min_len) & F.lit(c).startswith(t), F.exp(lp)).otherwise(F.lit(0.0))
    s = df.groupBy(*item).agg(*[F.sum(hit(c)).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return s.select(*item, *[F.when(total > 0, F.col(c) / total).otherwise(F.lit(1.0 / len(classes))).alias(c) for c in classes])


def p_yes(df: DataFrame, item: list[str], token: str = "token", lp: str = "logprob", default: float | None = 0.5) -> DataFrame:
    t = F.lower(F.trim(token))
    s = df.groupBy(*item).agg(F.sum(F.when(t == "yes", F.exp(lp)).otherwise(0.0)).alias("_y"), F.sum(F.when(t == "no", F.exp(lp)).otherwise(0.0)).alias("_n"))
    return s.select(*item, F.when(F.col("_y") + F.col("_n") > 0, F.col("_y") / (F.col("_y") + F.col("_n"))).otherwise(F.lit(default)).alias("p_yes"))


def expected_score(df: DataFrame, item: list[str], top: int = 5, divisor: float = 1.0, token: str = "token", lp: str = "logprob") -> DataFrame:
    """Expected digit 0..top over the digit tokens, NULL when there is none."""
    t = F.trim(token)
    ok = t.rlike(f"^[0-{top}]$")
    s = df.groupBy(*item).agg(F.sum(F.when(ok, F.try_to_number(t, F.lit("9")).cast("double") * F.exp(lp))).alias("_s"), F.sum(F.when(ok, F.exp(lp))).alias("_p"))
    return s.select(*item, (F.col("_s") / F.when(F.col("_p") > 0, F.col("_p")) / divisor).alias("score"))


def choice_probs(df: DataFrame, item: list[str], n: int, token: str = "token", lp: str = "logprob") -> DataFrame:
    """Letters A.. as choices -> columns A, B, ... that sum to 1 (uniform without a hit)."""
    letters = [chr(65 + i) for i in range(n)]
    s = df.withColumn("_t", F.upper(F.trim(token))).where(F.length("_t") == 1).groupBy(*item).pivot("_t", letters).agg(F.sum(F.exp(lp))).na.fill(0.0, letters)
    total = sum((F.col(c) for c in letters[1:]), F.col(letters[0]))
    return s.select(*item, *[F.when(total > 0, F.col(c) / total).otherwise(F.lit(1.0 / n)).alias(c) for c in letters])


def soft_target(p_unsafe: str, p_contro: str) -> Column:
    return F.least(F.greatest(F.col(p_unsafe) + 0.5 * F.col(p_contro), F.lit(0.0)), F.lit(1.0))


def mix(teacher: Column | str, human: Column | str, alpha: float) -> Column:
    return F.lit(alpha) * _c(teacher) + F.lit(1 - alpha) * _c(human)


def harden(soft: Column | str, cut: float = 0.5) -> Column:
    return (_c(soft) > cut).cast("int")


def agreement(df: DataFrame, soft: str, hard: str, by: list[str]) -> DataFrame:
    same = (harden(soft) == F.col(hard)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("agree"), F.avg(soft).alias("mean_soft"))


#: Blocks of a curve that one task may hold when neighbouring ranges are merged.
POOL = 1 << 20


def _pool(points: DataFrame, parts: int | None) -> DataFrame:
    """(x_max, s, n) pooled inside ranges of x, with the number of the range: adjacent violators of one range become one block."""
    ranges = points.repartitionByRange(parts, "x_max") if parts else points.repartitionByRange("x_max")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, xs, sums, counts = TaskContext.get().partitionId(), [], [], []
        for batch in batches:
            for x, s, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                while sums and sums[-1] * n >= s * counts[-1]:  # a mean that isn't below the next one; counts are positive
                    s, n = s + sums.pop(), n + counts.pop()
                    xs.pop()
                xs.append(x)
                sums.append(s)
                counts.append(n)
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), pa.array(sums, pa.float64()), pa.array(counts, pa.int64()), pa.array([part] * len(xs), pa.int32())], ["x_max", "s", "n", "part"])

    return ranges.select("x_max", "s", "n").sortWithinPartitions("x_max").mapInArrow(run, "x_max double, s double, n long, part int")


def pav_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Isotonic blocks (x_max, y_mean, n) of y on x, each with a larger mean than the one before.

    Rows are first summed per distinct x. Ranges of x are pooled in tasks of their own; while the last block of a range isn't below
    the first one of the next, blocks of several neighbouring ranges come together and are pooled again. Pooling is associative, so
    the curve is that of one pass over all values. Blocks stay in tables: the driver sees how many are left and how many
    neighbours still violate the order. Where a curve has more blocks than a task may hold, the limits of the ranges are moved
    instead of taking more of them together."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x_max")).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    blocks, parts = materialise(_pool(d, None)), 0
    while True:
        end = F.struct("s", "n")
        ends = blocks.groupBy("part").agg(F.min("x_max").alias("at"), F.min_by(end, "x_max").alias("first"), F.max_by(end, "x_max").alias("last"), F.count(F.lit(1)).alias("blocks"))
        before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("at"))  # a row per range
        seen = ends.withColumn("before", before).agg(
            F.coalesce(F.sum((F.col("before.s") * F.col("first.n") >= F.col("first.s") * F.col("before.n")).cast("int")), F.lit(0)).alias("broken"),
            F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("ranges")).first()
        if not seen["broken"]:
            return blocks.select("x_max", (F.col("s") / F.col("n")).alias("y_mean"), "n")
        fewer = max(-(-seen["blocks"] // POOL), min(seen["ranges"], parts or seen["ranges"]) // 8, 1)
        parts = fewer if fewer < seen["ranges"] else seen["ranges"] + 1
        blocks = materialise(_pool(blocks, parts))


def pav_apply(df: DataFrame, blocks: DataFrame, x: str, out: str) -> DataFrame:
    """Step lookup: the mean of the first block whose x_max is not below the value, the last block beyond all of them.

    Distinct values and blocks are laid out in cells of the number line; inside a cell a running look-up finds the next block, and
    one row per bucket carries the first block of the buckets behind. Nothing is broadcast or held in one row, however
    many steps the curve has."""
    pts = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x")).distinct().select("_x", F.lit(1).alias("_v"), F.lit(None).cast("double").alias("_y"))
    both = pts.unionByName(blocks.select(F.col("x_max").alias("_x"), F.lit(0).alias("_v"), F.col("y_mean").alias("_y")))
    b = range_buckets(both, "_x")
    w = Window.partitionBy("_rb").orderBy(F.col("_x").desc(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = b.withColumn("_near", F.last("_y", ignorenulls=True).over(w)).where("_v = 1")
    behind = Window.partitionBy(F.lit(0)).orderBy("_hb").rowsBetween(1, Window.unboundedFollowing)  # one row per bucket
    steps = b.groupBy(F.col("_rb").alias("_hb")).agg(F.min_by("_y", F.when(F.col("_v") == 0, F.col("_x"))).alias("_f"))
    steps = steps.select("_hb", F.first("_f", ignorenulls=True).over(behind).alias("_far"))
    last = blocks.agg(F.max_by("y_mean", "x_max").alias("_last"))
    found = inside.join(steps, inside["_rb"] == steps["_hb"]).crossJoin(last).select("_x", F.coalesce("_near", "_far", "_last").alias(out))
    return df.join(found, df[x].cast("double") == found["_x"], "left").drop("_x")


def calibration_table(blocks: DataFrame, points: list[float]) -> DataFrame:
    """Calibrated value at fixed raw scores."""
    grid = blocks.agg(F.max("x_max").alias("_m")).select(F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("raw"))
    return pav_apply(grid, blocks, "raw", "calibrated")


def canon(c: Column | str, merges: Mapping[str, str], drops: list[str] = ()) -> Column:
    """Merged label names; dropped labels become NULL. Apply the same call to gold and predictions."""
    col = _c(c)
    out = col
    for src, dst in merges.items():
        out = F.when(col == src, dst).otherwise(out)
    return F.when(~col.isin(*drops), out) if drops else out


def group_scores(long: DataFrame, mapping: DataFrame, item: str, label: str, score: str, how: str = "sum") -> DataFrame:
    """Scores of foreign labels summed (or maxed) per own class; mapping(label, class)."""
    agg = F.sum(score) if how == "sum" else F.max(score)
    return long.join(mapping, label).groupBy(item, "class").agg(agg.alias(score))


def claim_pairs(items: DataFrame, responses: DataFrame, item: str, seed=0, min_len: int = 16) -> DataFrame:
    """Sentence-level groundedness pairs: sentences of the supported response are 1, sentences only found in an
    unsupported response are 0; both classes equally large.

    items(item, passage, supported), responses(item, rid, text) hold the unsupported responses."""
    sup = items.select(item, "passage", sentences("supported", min_len).alias("_s"))
    pos = explode_rows(sup, [item, "passage"], F.array_distinct("_s"), "claim").withColumn("label", F.lit(1)).drop("pos")
    var = responses.join(sup, item).select(item, "passage", F.array_except(sentences("text", min_len), "_s").alias("_v"))
    neg = explode_rows(var, [item, "passage"], "_v", "claim").drop("pos").distinct().withColumn("label", F.lit(0))
    return balance_to_min(pos.unionByName(neg), "label", seed, [item, "claim"])


def scores_by_candidate(df: DataFrame, qid: str, pos: str, score: str) -> DataFrame:
    """Score list in candidate order."""
    return df.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct(pos, score))).alias("_l")).select(qid, F.col(f"_l.{score}").alias("scores"))


def composite(weights: Mapping[str, float]) -> Column:
    parts = [F.col(c) * F.lit(w) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def weighted_class_value(values: Mapping[str, float], divisor: float = 1.0) -> Column:
    """Expected value of class columns that hold probabilities."""
    parts = [F.col(c) * F.lit(v) for c, v in values.items()]
    return sum(parts[1:], parts[0]) / divisor


def inherit_labels(translated: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return translated.join(source.select(key, *cols), key, "left")
