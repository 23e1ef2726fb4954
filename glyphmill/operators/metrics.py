"""Evaluation metrics over long prediction tables. Each metric is one grouped aggregation; ranks and thresholds use
counts of distinct scores or grid cells, never a global sort.

Metrics of one score can share a count cube: `score_cube` counts positives and negatives per group and distinct score in the
only pass over the rows, and `cube_binary`, `cube_auc` and `cube_sweep` work on those counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import _c
from .ranking import average_ranks, prefix_sum, top_k


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def decide(score: Column | str, thr: float = 0.5, op: str = "ge") -> Column:
    return (_c(score) >= thr) if op == "ge" else (_c(score) > thr)


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def binary_counts(gold: Column | str, pred: Column) -> list[Column]:
    g = _c(gold) == 1
    return [_n(g & pred).alias("tp"), _n(~g & pred).alias("fp"), _n(g & ~pred).alias("fn"), _n(~g & ~pred).alias("tn")]


def binary_metrics(df: DataFrame, gold: str = "gold", score: str = "score", thr: float = 0.5, op: str = "ge", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return _binary(df.groupBy(*by).agg(*binary_counts(gold, decide(score, thr, op))), by)


def _binary(c: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, (tp + fp + fn + tn).alias("n"), (tp + fn).alias("pos"), ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1_of(tp, fp, fn).alias("f1"),
                    ratio(fp, fp + tn).alias("fpr"), ratio(fn, tp + fn).alias("fnr"))


def language_summary(per_lang: DataFrame, value: str, lang: str = "lang", english: str = "en") -> DataFrame:
    """Mean of languages, English alone and mean of the others."""
    en = F.col(lang) == english
    return per_lang.agg(F.avg(value).alias("mean"), F.avg(F.when(en, F.col(value))).alias("english"), F.avg(F.when(~en, F.col(value))).alias("non_english"))


def score_cube(df: DataFrame, gold: str = "gold", score: str = "score", by: list[str] | None = None, totals: list[str] | None = None, total: str = "all") -> DataFrame:
    """(by, score, pos, neg): rows of either class per group and distinct score; rows without a score have a null score.

    Columns in `totals` get one more value, `total`, that stands for all of theirs: grouping sets over the counts."""
    by, totals = by or [], totals or []
    g = F.col(gold) == 1
    one = df.groupBy(*by, F.col(score).alias("score")).agg(_n(g).alias("pos"), _n(~g).alias("neg"))
    if not totals:
        return one
    sets = [F.explode(F.array(F.col(c).cast("string"), F.lit(total))).alias(c) if c in totals else F.col(c) for c in by]
    for i, c in enumerate(by):  # one generator at a time
        if c in totals:
            one = one.select(*[sets[i] if x == c else F.col(x) for x in by], "score", "pos", "neg")
    return one.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def cube_binary(cube: DataFrame, thr: float = 0.5, op: str = "ge", by: list[str] | None = None) -> DataFrame:
    """The columns of `binary_metrics` from a cube."""
    by = by or []
    hit = decide("score", thr, op)
    n = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    c = cube.groupBy(*by).agg(n("pos", hit).alias("tp"), n("neg", hit).alias("fp"), n("pos", ~hit).alias("fn"), n("neg", ~hit).alias("tn"))
    return _binary(c, by)


def cube_auc(cube: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; NULL where a class is missing."""
    by = by or []
    c = prefix_sum(cube.where(F.col("score").isNotNull()), by, "score", {"neg": "_below"})
    a = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("_s"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return a.select(*by, (F.col("_P") + F.col("_N")).alias("n"), F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_s") / (F.col("_P") * F.col("_N"))).alias("auc"))


def auc(df: DataFrame, gold: str = "gold", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; NULL where a class is missing.

    Scores are counted per distinct value first, then negatives below come from a prefix sum over cells of the score."""
    return cube_auc(score_cube(df, gold, score, by), by)


def class_counts(df: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and support per class, from one pass over (gold, pred) counts."""
    by = by or []
    m = df.groupBy(*by, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    side = F.when(F.col("_g") == F.col("_p"), F.array(F.struct(F.col("_g").alias("class"), F.col("_n").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn")))).otherwise(
        F.array(F.struct(F.col("_g").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.col("_n").alias("fn")),
                F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.col("_n").alias("fp"), F.lit(0).cast("bigint").alias("fn"))))
    x = m.select(*by, F.explode(side).alias("x")).select(*by, "x.*")
    return x.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("support", F.col("tp") + F.col("fn"))


def multiclass(df: DataFrame, gold: str, pred: str, by: list[str] | None = None, classes: list | None = None, label_set: str = "union",
               min_support: int = 1) -> DataFrame:
    """Accuracy and macro-F1. The label set is a fixed list, the classes in gold ('gold', with a minimum support), or
    gold and predicted ones ('union')."""
    by = by or []
    c = class_counts(df, gold, pred, by).withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))
    if classes is not None:
        f1 = F.sum(F.when(F.col("class").isin(*classes), F.col("f1"))) / F.lit(len(classes))
    elif label_set == "gold":
        f1 = F.avg(F.when(F.col("support") >= min_support, F.col("f1")))
    else:
        f1 = F.avg("f1")
    return c.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("acc"), F.coalesce(f1, F.lit(0.0)).alias("macro_f1"))


def balanced_accuracy(df: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Mean recall of the classes in gold."""
    by = by or []
    c = class_counts(df, gold, pred, by).where("support > 0")
    return c.groupBy(*by).agg(F.avg(F.col("tp") / F.col("support")).alias("bacc"))


def weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Pearson correlation of pairs that stand for n rows each, as an aggregate."""
    w, sx, sy = F.sum(n), F.sum(n * x), F.sum(n * y)
    return (w * F.sum(n * x * y) - sx * sy) / F.sqrt((w * F.sum(n * x * x) - sx * sx) * (w * F.sum(n * y * y) - sy * sy))


def regression_metrics(df: DataFrame, gold: str, pred: str, by: list[str] | None = None, cut: float = 3.0, top: float = 5.0) -> DataFrame:
    """Spearman (tie-averaged ranks), Pearson, accuracy of rounded values, F1 at a cut.

    Rows are counted per pair of values once; ranks belong to the distinct values of either side, and all four figures are
    weighted sums over the pairs, in which centred values keep the sums exact enough. A value that a third of all rows share is as
    many pairs as it has partners."""
    by = by or []
    pairs = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(gold).cast("double").alias("_g"), F.col(pred).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    rg, rp = average_ranks(pairs, by, "_g", "_rg", "_n"), average_ranks(pairs, by, "_p", "_rp", "_n")
    total = pairs.groupBy(*by).agg(F.sum("_n").alias("_all"), (F.sum(F.col("_n") * F.col("_g")) / F.sum("_n")).alias("_mg"), (F.sum(F.col("_n") * F.col("_p")) / F.sum("_n")).alias("_mp"))
    j = pairs.join(rg.select(*by, "_g", "_rg"), [*by, "_g"]).join(rp.select(*by, "_p", "_rp"), [*by, "_p"])
    j = j.join(total, by) if by else j.crossJoin(total)
    n, middle = F.col("_n"), (F.col("_all") + 1) / 2.0
    level = lambda c: F.bround(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(top)))
    g, p = F.col("_g") >= cut, F.col("_p") >= cut
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    a = j.groupBy(*by).agg(F.sum(n).alias("n"), weighted_corr(F.col("_rg") - middle, F.col("_rp") - middle, n).alias("spearman"),
                           weighted_corr(F.col("_g") - F.col("_mg"), F.col("_p") - F.col("_mp"), n).alias("pearson"),
                           (count(level("_g") == level("_p")) / F.sum(n)).alias("acc"), count(g & p).alias("_tp"), count(~g & p).alias("_fp"), count(g & ~p).alias("_fn"))
    return a.select(*by, "n", "spearman", "pearson", "acc", f1_of(F.col("_tp"), F.col("_fp"), F.col("_fn")).alias("f1"))


def multilabel_metrics(df: DataFrame, item: str, label: str, gold: str, score: str, thr: float = 0.5) -> DataFrame:
    """Long form (item, label, gold, score) -> F1 and BCE per label."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = -(F.col(gold) * F.log(p) + (1 - F.col(gold)) * F.log(1 - p))
    c = df.groupBy(label).agg(*binary_counts(gold, decide(score, thr)), F.avg(bce).alias("bce"))
    return c.select(label, f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "bce")


def exact_match(df: DataFrame, item: str, gold: str, score: str, thr: float = 0.5) -> DataFrame:
    ok = (F.col(gold) == 1) == decide(score, thr)
    return df.groupBy(item).agg(F.min(ok.cast("int")).alias("_ok")).agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("exact"))


def sweep(df: DataFrame, grid: list[float], gold: str = "gold", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and FPR at every grid threshold (score >= t).

    One pass counts rows per grid cell; suffix sums over at most len(grid) cells give every threshold."""
    return cube_sweep(score_cube(df, gold, score, by), grid, by)


def cube_sweep(cube: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """`sweep` from a cube."""
    by = by or []
    grid = sorted(grid)
    cell = sum((F.col("score") >= t).cast("int") for t in grid)
    c = cube.groupBy(*by, cell.alias("_cell")).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    # every cell must exist in every group for its threshold to be listed
    groups = c.select(*by).distinct() if by else c.agg(F.count(F.lit(1)).alias("_x")).select()
    full = groups.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
    c = full.join(c, [*by, "_cell"], "left").na.fill(0, ["_p", "_q"])
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*(by or [F.lit(0)]))
    s = c.select(*by, "_cell", F.sum("_p").over(w).alias("tp"), F.sum("_q").over(w).alias("fp"), F.sum("_p").over(tot).alias("P"), F.sum("_q").over(tot).alias("N"))
    thr = F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.greatest(F.col("_cell"), F.lit(1)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("P") - F.col("tp")
    return s.where("_cell > 0").select(*by, thr.alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("P")).alias("recall"),
                                       f1_of(tp, fp, fn).alias("f1"), ratio(fp, F.col("N")).alias("fpr"), F.col("P").alias("pos"))


def tune_thresholds(dev: DataFrame, grid: list[float], gold: str = "gold", score: str = "score", by: list[str] | None = None, min_pos: int = 5,
                    prefer_high: bool = False) -> DataFrame:
    """Threshold with the best dev F1 per group; groups with fewer than `min_pos` positives take the pooled one."""
    by = by or []
    tie = F.col("threshold") if prefer_high else -F.col("threshold")
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", tie)).alias("b")
    cube = score_cube(dev, gold, score, by)  # the pooled sweep reads the same counts
    pooled = cube_sweep(cube, grid).agg(best).select(F.col("b.threshold").alias("_pt"), F.col("b.f1").alias("_pf"))
    if not by:
        return pooled.select(F.col("_pt").alias("threshold"), F.col("_pf").alias("f1"))
    own = cube_sweep(cube, grid, by).groupBy(*by).agg(best, F.max("pos").alias("pos"))
    return own.crossJoin(pooled).select(*by, "pos", F.when(F.col("pos") >= min_pos, F.col("b.threshold")).otherwise(F.col("_pt")).alias("threshold"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return df.join(thresholds.select(*by, "threshold"), by).withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))


def flag_rates(df: DataFrame, by: list[str], score: str = "score", thr: float = 0.5) -> DataFrame:
    hit = decide(score, thr)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _n(hit).alias("flagged"), F.avg(hit.cast("int")).alias("rate"))


def length_bucket(n: Column | str, edges: list[int]) -> Column:
    """Right-closed length buckets (lo, hi]."""
    out = F.lit(f">{edges[-1]}")
    lo = [0, *edges[:-1]]
    for a, b in reversed(list(zip(lo, edges))):
        out = F.when(_c(n) <= b, f"({a},{b}]").otherwise(out)
    return out


def category_metrics(df: DataFrame, cats: str, gold_cat: list[str], score_map: str, grid: list[float], min_pos: int = 10) -> DataFrame:
    """Per category on rows that are positive overall: AUC, F1 at 0.5 and best-threshold F1."""
    cat = F.explode(F.array(*[F.lit(c) for c in gold_cat]))
    x = df.withColumn("category", cat)
    x = x.select("category", F.array_contains(cats, F.col("category")).cast("int").alias("gold"), F.try_element_at(F.col(score_map), F.col("category")).alias("score"))
    cube = score_cube(x, by=["category"])
    b = cube_binary(cube, by=["category"]).where(F.col("pos") >= min_pos).select("category", "n", "pos", "f1")
    best = cube_sweep(cube, grid, ["category"]).groupBy("category").agg(F.max("f1").alias("best_f1"))
    return b.join(cube_auc(cube, ["category"]).select("category", "auc"), "category").join(best, "category")


def tune_f1(df: DataFrame, grid: list[float], by: list[str]) -> DataFrame:
    return sweep(df, grid, by=by).groupBy(*by).agg(F.max("f1").alias("best_f1"))


def restricted_argmax(long: DataFrame, item: str, label: str, score: str, allowed: list[str]) -> DataFrame:
    """Best label of each item among the allowed ones (ties: first label)."""
    x = long.where(F.col(label).isin(*allowed))
    return x.groupBy(item).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("_m")).select(item, F.col("_m.l").alias("pred"))


def zero_shot(long: DataFrame, item: str, idx: str, gold: str, score: str) -> DataFrame:
    """Accuracy of the highest-scoring candidate label (ties: the first candidate)."""
    best = long.groupBy(item).agg(F.max(F.struct(F.col(score), (-F.col(idx)).alias("neg"))).alias("m"), F.max(F.col(gold)).alias("gold"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg((-F.col("m.neg") == F.col("gold")).cast("int")).alias("acc"))


def score_agreement(a: DataFrame, b: DataFrame, key: str, thr: float = 0.5, score: str = "score") -> DataFrame:
    j = a.select(key, F.col(score).alias("a")).join(b.select(key, F.col(score).alias("b")), key)
    diff = F.abs(F.col("a") - F.col("b"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("a") >= thr) == (F.col("b") >= thr)).cast("int")).alias("same"), F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"))


# ---- tables of results: (model, set, metric, value) -------------------------------------------------------------------

def macro(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Mean over a fixed list of (set, metric) per model, with the number of entries found."""
    return df.join(spec, ["set", "metric"]).groupBy("model").agg(F.avg("value").alias("macro"), F.count("value").alias("n"))


def gates(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Which models reach every minimum of spec(set, metric, minimum)."""
    j = df.join(spec, ["set", "metric"])
    return j.groupBy("model").agg(F.min((F.col("value") >= F.col("minimum")).cast("int")).alias("passed"))


def leaderboard(df: DataFrame, sets: list[str]) -> DataFrame:
    """Models by sets with a macro column that is NULL unless every set has a value."""
    wide = df.groupBy("model").pivot("set", sets).agg(F.max("value"))
    total = sum((F.col(f"`{s}`") for s in sets[1:]), F.col(f"`{sets[0]}`"))
    return wide.withColumn("macro", total / len(sets))


def clean_names(c: Column | str) -> Column:
    """Model paths to public names: the last folder that says something, date and step suffixes off."""
    t = F.regexp_replace(_c(c), r"/+$", "")
    t = F.regexp_replace(t, r"/(?:model|best|final|checkpoint-\d+)$", "")
    return F.regexp_replace(F.element_at(F.split(t, "/"), -1), r"[-_](?:20\d{6}|step\d+)$", "")


def snapshot_diff(cur: DataFrame, prev: DataFrame, key: str, value: str) -> DataFrame:
    j = cur.select(key, F.col(value).alias("_c")).join(prev.select(key, F.col(value).alias("_p")), key, "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(key, z("_c").alias("current"), z("_p").alias("previous"), (z("_c") - z("_p")).alias("delta"))


def ahead(df: DataFrame, model: str) -> DataFrame:
    """Per set the models with a higher value than the given one."""
    mine = df.where(F.col("model") == model).select("set", F.col("value").alias("_mine"))
    return df.join(mine, "set").where(F.col("value") > F.col("_mine")).groupBy("set").agg(F.array_join(F.sort_array(F.collect_list("model")), ",").alias("models"))


def best_per_set(df: DataFrame) -> DataFrame:
    """Best model(s) per set, ties kept, NULLs ignored: a partial maximum per set joined back."""
    top = df.where(F.col("value").isNotNull()).groupBy("set").agg(F.max("value").alias("value"))
    return df.join(top, ["set", "value"]).select("set", "model", "value")


def paired(df: DataFrame, a: str, b: str, gap: float, by: str = "lang") -> DataFrame:
    """Per-language values of two systems, their gap and whether it reaches `gap`."""
    x = df.where(F.col("model").isin(a, b)).groupBy(by).agg(F.max(F.when(F.col("model") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("value"))).alias("b"))
    return x.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("gap", F.col("a") - F.col("b")).withColumn("large", (F.abs("gap") >= gap).cast("int"))


def ablation(df: DataFrame, with_: str, without: str, gold: str = "gold", by: list[str] | None = None) -> DataFrame:
    """AUC with and without an input and their difference."""
    by = by or []
    both = F.explode(F.array(*[F.struct(F.lit(name).alias("v"), F.col(c).cast("double").alias("s")) for name, c in (("auc_with", with_), ("auc_without", without))]))
    long = df.select(*by, F.col(gold).alias("gold"), both.alias("x")).select(*by, "gold", F.col("x.v").alias("_v"), F.col("x.s").alias("score"))
    own = cube_auc(score_cube(long, by=[*by, "_v"]), [*by, "_v"])
    side = lambda name, c: F.max(F.when(F.col("_v") == name, F.col(c)))
    j = own.groupBy(*by).agg(side("auc_with", "n").alias("n"), side("auc_with", "auc").alias("auc_with"), side("auc_without", "auc").alias("auc_without"))
    return j.withColumn("delta", F.col("auc_with") - F.col("auc_without"))


def subset_rate(df: DataFrame, dim: DataFrame, key: str, subset: str, score: str = "score", thr: float = 0.5) -> DataFrame:
    return flag_rates(df.join(dim.select(key, subset), key, "left").withColumn(subset, F.coalesce(subset, F.lit("rest"))), [subset], score, thr)


# ---- sequence labels ----------------------------------------------------------------------------------------------------

def mark_metrics(df: DataFrame, gold: str, pred: str, by: list[str] | None = None, none: str = "0") -> DataFrame:
    """Micro F1 over the marks, accuracy and units: from confusion counts, so unit rows are summed before the shuffle."""
    by = by or []
    m = df.groupBy(*by, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit, g, p = F.col("_g") == F.col("_p"), F.col("_g") != none, F.col("_p") != none
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    c = m.groupBy(*by).agg(F.sum("_n").alias("n"), n(hit).alias("_ok"), n(hit & g).alias("_tp"), n(p).alias("_pp"), n(g).alias("_gg"))
    return c.select(*by, "n", (F.col("_ok") / F.col("n")).alias("acc"), f1_of(F.col("_tp"), F.col("_pp") - F.col("_tp"), F.col("_gg") - F.col("_tp")).alias("f1"))


def per_mark_f1(df: DataFrame, gold: str, pred: str, group: str, blank: str = "0") -> DataFrame:
    """(mark, pooled, by_group): F1 of every mark but the blank one over all units, beside the mean of its F1 per group.

    Works on counts per (group, gold, pred), so units are read once."""
    n = df.groupBy(F.col(group).alias("_g"), F.col(gold).alias("_a"), F.col(pred).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    side = lambda c, tp, g, p: F.struct(F.col(c).alias("mark"), tp.alias("tp"), F.lit(g).alias("g"), F.lit(p).alias("p"))
    hit = (F.col("_a") == F.col("_b")).cast("int")
    each = n.select("_g", "_n", F.explode(F.array(side("_a", hit, 1, 0), side("_b", F.lit(0), 0, 1))).alias("x")).where(F.col("x.mark") != blank)
    per = each.groupBy("_g", "x.mark").agg(*[F.sum(F.col("_n") * F.col(f"x.{c}")).alias(c) for c in ("tp", "g", "p")])
    f1 = lambda tp, g, p: F.when(g + p > 0, 2 * tp / (g + p)).otherwise(0.0)
    return per.groupBy("mark").agg(f1(F.sum("tp"), F.sum("g"), F.sum("p")).alias("pooled"), F.avg(f1(F.col("tp"), F.col("g"), F.col("p"))).alias("by_group"))
