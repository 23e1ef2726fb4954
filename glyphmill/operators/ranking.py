"""Ordered ranks, prefix sums and top-k that stay spread over tasks when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per power of two, and parts of a cell.
CELLS, PARTS = 1 << 12, 1 << 10


def cell(x: Column) -> tuple[Column, Column]:
    """(cell, part) of a number as integers in its order: exponent and leading bits of the double, then the bits after them.

    Nothing about the data has to be known, so no job runs to find cut points, and equal numbers fall into equal cells in any
    query. Beyond a logarithm that is off by one at a power of two, the next cell begins where the last one ends."""
    v = x.cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a))
    at = (a / F.pow(F.lit(2.0), e) - 1) * CELLS
    whole = F.floor(at)
    plain = (e + 1100) * CELLS + whole  # above 0 for every finite number but 0
    part = F.least(F.floor((at - whole) * PARTS), F.lit(PARTS - 1)).cast("bigint")
    top = F.lit(4000 * CELLS)
    odd = F.isnan(v) | (a == float("inf"))
    big = F.when(odd, F.when(F.isnan(v), top + 1).otherwise(top)).when(a == 0, F.lit(0)).otherwise(plain).cast("bigint")
    small = F.when(odd | (a == 0), F.lit(0).cast("bigint")).otherwise(part)
    neg = (v < 0) & ~F.isnan(v)
    return F.when(neg, -big).otherwise(big), F.when(neg & ~odd, F.lit(PARTS - 1) - small).otherwise(small)


def range_buckets(df: DataFrame, col: str, name: str = "_rb") -> DataFrame:
    """Order-preserving bucket number of a numeric column: CELLS buckets per power of two."""
    return df.withColumn(name, cell(F.col(col))[0])


def _sums_before(of: DataFrame, part: list[str], order: str, descending: bool, values: list[str], prefix: str) -> DataFrame:
    w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return of.withColumns({f"{prefix}{v}": F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)) for v in values})


def prefix_sum(df: DataFrame, by: list[str], order: str, values: dict[str, str], descending: bool = False) -> DataFrame:
    """Sum of each value over the rows strictly before, in `order` (unique inside a group).

    Three passes, each over narrower ranges of the order: sums of whole cells before a row's cell, of the parts of its cell before
    its part, and of the rows before it inside the part. The first two work on counts per cell; no task sees a whole group."""
    big, small = cell(F.col(order))
    b = df.withColumns({"_cell": big, "_part": small})
    g = [f"_g{i}" for i in range(len(by))]
    names = list(values)
    parts = b.groupBy(*[F.col(x).alias(n) for x, n in zip(by, g)], F.col("_cell").alias("_hc"), F.col("_part").alias("_hp")).agg(*[F.sum(v).alias(f"_t_{v}") for v in names])
    cells = parts.groupBy(*g, F.col("_hc").alias("_oc")).agg(*[F.sum(f"_t_{v}").alias(f"_t_{v}") for v in names])
    cells = _sums_before(cells, g, "_oc", descending, names, "_o_").select(*[F.col(n).alias(f"_o{n}") for n in g], "_oc", *[f"_o_{v}" for v in names])
    parts = _sums_before(parts, [*g, "_hc"], "_hp", descending, names, "_i_")
    here = F.col("_hc") == F.col("_oc")
    for n in g:
        here = here & F.col(n).eqNullSafe(F.col(f"_o{n}"))
    parts = parts.join(cells, here).select(*g, "_hc", "_hp", *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"_b_{v}") for v in names])
    own = (b["_cell"] == parts["_hc"]) & (b["_part"] == parts["_hp"])
    for n, x in zip(g, by):
        own = own & b[x].eqNullSafe(parts[n])
    w = Window.partitionBy(*by, "_cell", "_part").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(parts, own).select(*df.columns, *[(F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_b_{v}")).alias(out) for v, out in values.items()])


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """(group, value, count, tie-averaged rank) for every distinct value; `weight` names a column of row counts."""
    d = df.groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c0"))
    p = prefix_sum(d, by, value, {"_c0": "_before"})
    return p.select(*by, value, F.col("_c0").alias(f"{name}_n"),
                    (F.col("_before") + (F.col("_c0") + 1) / 2.0).alias(name))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group with their rank, for small k: Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_k_per_group(df: DataFrame, by: list[str], id_col: str, k: int) -> DataFrame:
    """The k rows with the smallest ids per group, exact for any group size: bucket counts find where k is reached,
    so only rows up to that bucket are ranked."""
    b = range_buckets(df, id_col)
    g = [F.col(x).alias(f"_g{i}") for i, x in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    hist = b.groupBy(*g, F.col("_rb").alias("_hb")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*names).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    last = hist.where(F.col("_base") < k).groupBy(*names).agg(
        F.max(F.struct("_hb", (F.lit(k) - F.col("_base")).alias("_left"))).alias("_cut"))
    cond = b["_rb"] <= last["_cut._hb"]
    for i, x in enumerate(by):
        cond = cond & b[x].eqNullSafe(last[f"_g{i}"])
    j = b.join(last, cond)
    rn = F.row_number().over(Window.partitionBy(*by, "_rb").orderBy(id_col))
    return j.withColumn("_rn", rn).where((F.col("_rb") < F.col("_cut._hb")) | (F.col("_rn") <= F.col("_cut._left"))).select(*df.columns)


def rank_candidates(df: DataFrame, qid: str, score: str, pos: str) -> DataFrame:
    """Rank of every candidate of a query by descending score, ties by candidate position (lists are short by nature)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.col(score).desc(), pos)))


def top_flagged(df: DataFrame, scores: list[str], n: int, key: str) -> DataFrame:
    """The n rows with the highest score of any model: a bounded heap per task, merged once."""
    return df.withColumn("top", F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])).orderBy(F.col("top").desc(), key).limit(n)
