"""Deterministic sampling, quotas and splits.

Randomness is a hash of (seed, key), so the same rows come out for any partitioning. Exact ranks never need one task
per group: rows are cut into hash buckets, bucket counts give each bucket's offset inside its group, and only rows of
one bucket are ranked together. A language that holds a third of the corpus is therefore spread over all buckets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import h32, u

BITS = 12  # 4096 buckets per group


def _group_eq(left: DataFrame, right: DataFrame, by: list[str], extra: Column) -> Column:
    cond = extra
    for i, b in enumerate(by):
        cond = cond & left[b].eqNullSafe(right[f"_g{i}"])
    return cond


def _hashed(df: DataFrame, seed, key: list[str], bits: int, prefer: Column | None = None) -> DataFrame:
    h = h32(seed, *key)
    b = F.shiftright(h, 32 - bits)
    if prefer is not None:  # preferred rows come first: they use the lower half of the bucket numbers
        b = b + F.when(prefer, F.lit(0)).otherwise(F.lit(1 << bits))
    return df.withColumn("_h", h).withColumn("_b", b.cast("bigint"))


def _histogram(hashed: DataFrame, by: list[str]) -> DataFrame:
    """(group, bucket) -> rows before the bucket, rows in the bucket."""
    g = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    hist = hashed.groupBy(*g, F.col("_b").alias("_hb")).agg(F.count(F.lit(1)).alias("_n"))
    # at most 2**bits (twice that with a preference) rows per group enter this window
    w = Window.partitionBy(*([f"_g{i}" for i in range(len(by))] or [F.lit(0)])).orderBy("_hb").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("_base", F.sum("_n").over(w) - F.col("_n"))


def hash_rank(df: DataFrame, by: list[str], seed, key: list[str], bits: int = BITS, name: str = "_rank") -> DataFrame:
    """Exact 1-based rank of every row in the hash order of its group."""
    hashed = _hashed(df, seed, key, bits)
    hist = _histogram(hashed, by)
    j = hashed.join(hist, _group_eq(hashed, hist, by, hashed["_b"] == hist["_hb"]), "inner")
    w = Window.partitionBy(*by, "_b").orderBy("_h", *key)
    return j.withColumn(name, F.row_number().over(w) + F.col("_base")).select(*df.columns, name)


def quota(df: DataFrame, by: list[str], n: int | Column, seed, key: list[str], overrides: Mapping[str, int] | None = None,
          quotas: DataFrame | None = None, prefer: Column | None = None, bits: int = BITS) -> DataFrame:
    """The first n rows of every group in hash order: exact, whatever the size of a group.

    `overrides` sets n for single values of by[0]; `quotas` is a table (by..., quota) instead of n; `prefer` puts rows
    that meet a condition first (back-filling with the rest)."""
    hashed = _hashed(df, seed, key, bits, prefer)
    hist = _histogram(hashed, by)
    if quotas is not None:
        q = quotas.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("quota").cast("bigint").alias("_q"))
        hist = hist.join(q, [f"_g{i}" for i in range(len(by))]) if by else hist.crossJoin(q)
    else:
        target = n if isinstance(n, Column) else F.lit(n)
        for value, m in (overrides or {}).items():
            target = F.when(F.col("_g0") == value, F.lit(m)).otherwise(target)
        hist = hist.withColumn("_q", target.cast("bigint"))
    # one row per group: the bucket in which the quota runs out, and how many of its rows are still wanted
    last = hist.where(F.col("_base") < F.col("_q")).groupBy(*[f"_g{i}" for i in range(len(by))]).agg(
        F.max(F.struct("_hb", (F.col("_q") - F.col("_base")).alias("_left"))).alias("_cut"))
    j = hashed.join(last, _group_eq(hashed, last, by, hashed["_b"] <= last["_cut._hb"]), "inner")
    # only the cutting bucket is ranked; it gets its own window key, all other rows are spread by their hash
    at_cut = F.col("_b") == F.col("_cut._hb")
    w = Window.partitionBy(*by, "_b", F.when(at_cut, F.lit(0)).otherwise(F.col("_h"))).orderBy("_h", *key)
    return (j.withColumn("_rn", F.row_number().over(w))
            .where(~at_cut | (F.col("_rn") <= F.col("_cut._left"))).select(*df.columns))


def sample_n(df: DataFrame, n: int, seed, key: list[str]) -> DataFrame:
    return quota(df, [], n, seed, key)


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def balanced(df: DataFrame, label: str, n: int, seed, key: list[str]) -> DataFrame:
    """n rows over all classes, the same number for each (fewer where a class is smaller)."""
    c = _counts(df, [label])
    k = c.agg(F.count(F.lit(1)).alias("_k"))
    return quota(df, [label], 0, seed, key,
                 quotas=c.crossJoin(k).select(label, F.floor(F.lit(n) / F.col("_k")).alias("quota")))


def stratified(df: DataFrame, label: str, n: int, seed, key: list[str]) -> DataFrame:
    """round(n * class size / all) rows per class, half to even."""
    c = _counts(df, [label])
    total = c.agg(F.sum("_n").alias("_t"))
    return quota(df, [label], 0, seed, key,
                 quotas=c.crossJoin(total).select(label, F.bround(F.lit(n) * F.col("_n") / F.col("_t")).alias("quota")))


def balance_to_min(df: DataFrame, label: str, seed, key: list[str]) -> DataFrame:
    c = _counts(df, [label])
    m = c.agg(F.min("_n").alias("_m"))
    return quota(df, [label], 0, seed, key, quotas=c.crossJoin(m).select(label, F.col("_m").alias("quota")))


def cap_share(df: DataFrame, cond: Column, base: Column, share: float, seed, key: list[str]) -> DataFrame:
    """Rows that meet `cond` (within `base`) are cut so that they are at most `share` of the base rows."""
    tagged = df.withColumn("_cond", F.coalesce(base & cond, F.lit(False))).withColumn("_base_row", F.coalesce(base, F.lit(False)))
    tot = tagged.agg(F.sum((F.col("_base_row") & ~F.col("_cond")).cast("bigint")).alias("_other"))
    cap = tot.select(F.floor(F.coalesce("_other", F.lit(0)) * F.lit(share / (1 - share))).alias("quota"))
    kept = quota(tagged.where("_cond"), [], 0, seed, key, quotas=cap)
    return tagged.where("not _cond").unionByName(kept).select(*df.columns)


def repeat(df: DataFrame, cond: Column, k: int) -> DataFrame:
    """Rows that meet the condition k times (column `copy`), all others once."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(cond, F.lit(k)).otherwise(F.lit(1)))))


def split_exact(df: DataFrame, f: float, seed, key: list[str], minimum: int = 0) -> DataFrame:
    """Column `split`: exactly max(minimum, floor(f*n)) rows are 'val'."""
    ranked = hash_rank(df, [], seed, key)
    n = df.agg(F.greatest(F.lit(minimum), F.floor(F.count(F.lit(1)) * F.lit(f))).alias("_v"))
    return ranked.crossJoin(n).withColumn("split", F.when(F.col("_rank") <= F.col("_v"), "val").otherwise("train")).drop(
        "_rank", "_v")


def split_hash(df: DataFrame, key: list[str], f: float, seed=0, names: tuple = ("val", "train")) -> DataFrame:
    return df.withColumn("split", F.when(u(seed, *key) < f, names[0]).otherwise(names[1]))


def split_group(df: DataFrame, group: list[str], f: float, seed=0) -> DataFrame:
    """All rows of a group fall on one side; the group key may be any expression column."""
    return split_hash(df, group, f, seed)


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(group).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(group)


def run_ids(df: DataFrame, part: list[str], order: str, keys: list[str], name: str = "run") -> DataFrame:
    """Number of the run of identical keys inside a file, in line order (`order` counts lines without gaps).

    The line before comes from an equi-join on the line number and the running count from a two-pass prefix sum, so one
    huge file does not end up in one task."""
    from .ranking import prefix_sum

    prev = df.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], (F.col(order) + 1).alias("_o"),
                     F.struct(*keys).alias("_prev"))
    cond = df[order] == prev["_o"]
    for i, p in enumerate(part):
        cond = cond & (df[p] == prev[f"_p{i}"])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_prev.{k}"))
    j = df.join(prev, cond, "left").withColumn(
        "_chg", F.when(F.col("_prev").isNull(), 1).otherwise((~same).cast("int"))).select(*df.columns, "_chg")
    return prefix_sum(j, part, order, {"_chg": "_before"}).withColumn(name, F.col("_before") + F.col("_chg")).drop("_chg", "_before")


def thread_group(df: DataFrame, text: str, context: str) -> DataFrame:
    """Group id: digest of the context; a row without context inherits the thread of the same text that has one."""
    has = F.length(F.coalesce(F.col(context), F.lit(""))) > 0
    keyed = df.withColumn("_t", F.md5(text))
    known = keyed.where(has).groupBy("_t").agg(F.min(F.md5(context)).alias("_g"))
    return keyed.join(known, "_t", "left").withColumn("grp", F.when(has, F.md5(context)).otherwise(F.coalesce("_g", "_t"))).drop("_t", "_g")


def min_support(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of groups with at least n rows; counts are pre-aggregated and joined back."""
    return df.join(_counts(df, [by]).where(F.col("_n") >= n).select(by), by, "left_semi")


def shard(df: DataFrame, key: str, i: int, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(n)) == i)


def with_shard(df: DataFrame, key: str, n: int, name: str = "shard") -> DataFrame:
    """All shards in one pass, as a column."""
    return df.withColumn(name, F.pmod(F.col(key), F.lit(n)))


def round_robin(df: DataFrame, values: list[str], position: str, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]),
                                            (F.pmod(F.col(position), F.lit(len(values))) + 1).cast("int")))


def assign_grid(df: DataFrame, key: str, dims: Mapping[str, list[str]], seed) -> DataFrame:
    """One random combination of dimension values per row."""
    for i, (name, values) in enumerate(dims.items()):
        arr = F.array(*[F.lit(v) for v in values])
        df = df.withColumn(name, F.element_at(arr, (F.pmod(h32(f"{seed}.{i}", key), F.lit(len(values))) + 1).cast("int")))
    return df


def mixture(df: DataFrame, parts: Mapping[str, tuple[Column, int]], seed, key: list[str]) -> DataFrame:
    """A sample of n rows from each named, disjoint part: one quota over a part column."""
    part = F.lit(None).cast("string")
    for name, (cond, _) in reversed(list(parts.items())):
        part = F.when(cond, name).otherwise(part)
    tagged = df.withColumn("part", part).where(F.col("part").isNotNull())
    return quota(tagged, ["part"], 0, seed, key, overrides={name: n for name, (_, n) in parts.items()})


def quota_backfill(df: DataFrame, by: str, cond: Column, n: int, seed, key: list[str]) -> DataFrame:
    """n rows per group; rows meeting the condition fill at most half, unless the others run out."""
    tagged = df.withColumn("_c", F.coalesce(cond, F.lit(False)))
    first = quota(tagged.where("_c"), [by], n // 2, seed, key).withColumn("_first", F.lit(True))
    # the preferred half stands first, then any other row in hash order
    mark = tagged.join(first.select(*key, "_first"), key, "left")
    return quota(mark, [by], n, seed, key, prefer=F.coalesce(F.col("_first"), F.lit(False))).select(*df.columns)


def sample_groups(df: DataFrame, group: list[str], f: float, seed) -> DataFrame:
    return df.where(u(seed, *group) < f)


def sample_per_target(df: DataFrame, targets: list[str], n: int, score: str, cut: float, seed, key: list[str]) -> DataFrame:
    """For every target its own n rows: half at or above the score cut, half below."""
    t = df.withColumn("target", F.explode(F.array(*[F.lit(x) for x in targets])))
    t = t.withColumn("above", (F.col(score) >= cut).cast("int"))
    return quota(t, ["target", "above"], n // 2, seed, ["target", *key])


def slices(df: DataFrame, by: list[str], n_test: int, n_train: int, seed, key: list[str]) -> DataFrame:
    """Disjoint 'test' and 'train' rows from one shuffled order per group."""
    top = quota(df, by, n_test + n_train, seed, key)
    return hash_rank(top, by, seed, key).withColumn(
        "split", F.when(F.col("_rank") <= n_test, "test").otherwise("train")).drop("_rank")


def flag_share(df: DataFrame, cond: Column, f: float, seed, key: list[str], name: str = "flag") -> DataFrame:
    return df.withColumn(name, cond & (u(seed, *key) < f))


def head_per_group(df: DataFrame, by: list[str], k: int, seed, key: list[str]) -> DataFrame:
    return quota(df, by, k, seed, key)


def worst(df: DataFrame, metric: str, k: int, key: str, ascending: bool = True) -> DataFrame:
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.orderBy(order, key).limit(k)


def remix(df: DataFrame, text: str, cond0: Column, cond1: Column, seed, key: list[str]) -> DataFrame:
    """New two-class task from an old table: rows under cond0 are 0, rows under cond1 are 1, classes equally large."""
    lab = df.withColumn("label", F.when(cond0, 0).when(cond1, 1)).where(F.col("label").isNotNull())
    return balance_to_min(lab, "label", seed, key)
