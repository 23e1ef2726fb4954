"""Table-in, table-out jobs: the entry points most users call."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import WS, h32, norm_key, norm_ws, sentences, u
from ..functions.text import ends_sentence, english_like, letter_share, script_frac
from ..functions.units import explode_rows, pin, sentence_window, short_span
from ..operators import augment, compress, dedup, filters, joins, labels, metrics, ml, passages, profile, retrieval, sampling, seqlabel, spans
from ..session import materialise
from ..sources.readers import pages_text, with_ids


def training_table(df: DataFrame, evals: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label", group: str = "source",
                   drop_rx: str | None = None, min_len: int = 4, val: float = 0.1, seed=0) -> DataFrame:
    """Filter, decontaminate (whole text and sentence), drop conflicting keys, keep one row per key, group-safe split."""
    t = df.where(F.length(text) >= min_len)
    if drop_rx:
        t = filters.drop_sources(t, drop_rx)
    # one pass over the texts makes a narrow key table; the rules work on it, and only the surviving ids meet the texts again
    digest = lambda c: dedup._digest([norm_key(c)])
    long_ = F.filter(sentences(text), lambda x: F.length(x) > 25)
    keys = materialise(t.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), digest(text).alias("_k"), F.transform(long_, digest).alias("_s")))
    keys = keys.join(dedup.eval_keys(evals, "text"), "_k", "left_anti")
    bad = F.concat(sentences("text"), F.array("text"))
    bad = explode_rows(evals, [], F.filter(bad, lambda x: F.length(x) > 25), "s").select(digest("s").alias("_s")).distinct()
    hit = keys.select("_id", F.explode("_s").alias("_s")).join(bad, "_s", "left_semi").select("_id").distinct()
    keys = keys.select("_id", "_label", "_k").join(hit, "_id", "left_anti")
    one = keys.groupBy("_k").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"), F.min("_id").alias(id_col))
    return sampling.split_group(t.join(one.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(id_col), id_col, "left_semi"), [group], val, seed)


def merge_version(old: DataFrame, new: DataFrame, evals: DataFrame, id_col: str, text: str, label: str, group: str, val: float = 0.1, seed=0) -> DataFrame:
    """Add a new batch to an existing version: only unseen, clean, consistent rows; new groups get a split, old rows keep theirs."""
    # the texts of the new batch are keyed once; the rules see digests, and only the ids that survive meet the texts again
    digest = lambda c: dedup._digest([norm_key(c)])
    keys = materialise(new.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), digest(text).alias("_k")))
    known = dedup.eval_keys(evals, "text").unionByName(old.select(digest(text).alias("_k"))).distinct()
    one = keys.join(known, "_k", "left_anti").groupBy("_k").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"), F.min("_id").alias(id_col))
    fresh = new.join(one.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(id_col), id_col, "left_semi")
    return dedup.union_versions([old, sampling.split_group(fresh, [group], val, seed)], old.columns)


def passage_pool(tables: list[tuple[DataFrame, str]], per_lang: int, overrides: Mapping[str, int] | None = None, lo: int = 120, hi: int = 1200, seed=0) -> DataFrame:
    """Passages per language with quotas from tables (key, lang, text): (key, lang, passage, pool)."""
    out = None
    for df, name in tables:
        p = passages.passages(df, "key", "text", 2, 6, lo, hi, seed).select(F.concat_ws(":", F.lit(name), "key").alias("key"), "lang", "passage", F.lit(name).alias("pool"))
        out = p if out is None else out.unionByName(p)
    # written once with their digests: duplicates and quotas are settled on keys, and the passages are read once more at the end
    rows = materialise(out.withColumn("_k", dedup._digest([F.col("passage")])))
    one = rows.groupBy("_k").agg(F.min(F.struct("key", "lang")).alias("r")).select("r.*")
    chosen = sampling.quota(one, ["lang"], per_lang, seed, ["key"], overrides)
    return rows.drop("_k", "lang").join(chosen, "key").select("key", "lang", "passage", "pool")


def url_pool(pages: DataFrame, patterns: Mapping[str, str], drop: list[str], per_lang: int, lo: int = 120, hi: int = 1200, seed=0) -> DataFrame:
    """Passages of pages whose URL is of no dropped class, with dense ids: (pid, key, lang, cls, passage)."""
    cls = filters.url_class("url", patterns)
    kept = pages.withColumn("cls", cls).where(~F.col("cls").isin(*drop))
    pool = passage_pool([(page_table(kept), "page")], per_lang, None, lo, hi, seed)
    of = kept.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key"), "cls")
    return with_ids(pool.join(of, "key"), ["key"]).select("pid", "key", "lang", "cls", "passage")


def page_table(pages: DataFrame) -> DataFrame:
    """Web pages as (key, lang, text): visible text, language from the html tag."""
    return pages.select(F.col("page_id").cast("string").alias("key"), F.regexp_extract("html", r'(?i)<html[^>]*lang="([a-z]+)"', 1).alias("lang"), pages_text(pages).alias("text"))


def language_id_table(df: DataFrame, evals: DataFrame, key: str, lang_label: str, text: str, min_rows: int = 1, val: float = 0.02, seed=0, longest: int | None = None) -> DataFrame:
    """Long samples (up to `longest` characters where given) and short spans per language, decontaminated, filtered by script
    and English words, unique, split."""
    long_ = pin(df.select(key, lang_label, F.col(text).alias("_t")), "text", sentence_window("_t", key, f"{seed}.w", 1, 3, 15, longest or 2147483647)).where("text is not null").select(
        key, lang_label, "text", F.lit("long").alias("kind"))
    short = pin(long_.select(key, lang_label, F.col("text").alias("_t")), "text", short_span("_t", key, f"{seed}.s", 15, 60)).where(F.length("text") >= 5).select(
        key, lang_label, "text", F.lit("short").alias("kind"))
    t = materialise(long_.unionByName(short))  # short samples, read once for the evaluation test and twice for dedup
    # a sample goes when it, or one of its sentences, is in an evaluation set
    ek = explode_rows(evals, [], F.concat(sentences("text"), F.array("text")), "s").select(dedup._digest([norm_ws("s")]).alias("_k")).distinct()
    sid = F.concat_ws("/", "kind", F.col(key).cast("string"))
    t = t.withColumn("sid", sid)
    bad = explode_rows(t, ["sid"], F.concat(F.array("text"), sentences("text")), "s").select("sid", dedup._digest([norm_ws("s")]).alias("_k")).join(ek, "_k", "left_semi").select("sid").distinct()
    t = t.join(bad, "sid", "left_anti")
    script = F.element_at(F.split(lang_label, "_"), -1)
    keep = ~((script != "Latn") & (script_frac("text", script) < 0.5)) & ~((script == "Latn") & (F.col(lang_label) != "eng_Latn") & english_like("text"))
    t = dedup.dedup(sampling.min_support(t.where(keep), lang_label, min_rows), ["text"], "sid")
    return sampling.split_hash(t, ["text"], val, seed)


def redact_corpus(df: DataFrame, key: str, text: str, seed_names: bool = False) -> DataFrame:
    """Detect, clean, propagate and redact: (key, spans, redacted)."""
    d = pin(df.select(key, text), "spans", spans.clean_spans(text, spans.relabel_by_context(text, spans.detect_pii(text), "SECRET", spans.BANKISH, "BANK_ACCOUNT")))
    if seed_names:
        d = d.withColumn("spans", spans.propagate(text, "spans")).withColumn("spans", spans.clean_spans(text, "spans"))
    return d.withColumn("redacted", spans.redact(text, "spans"))


def redaction_benchmark(df: DataFrame, set_col: str, text: str, must: str, may: str, pred: str) -> DataFrame:
    """Redaction scores per set, exact entity F1 beside them, and their macro mean (set = 'macro')."""
    per = spans.redaction_metrics(df, text, must, may, pred, [set_col])
    both, each = F.size(F.array_intersect(must, pred)), F.size(F.array_distinct(must)) + F.size(F.array_distinct(pred))
    exact = df.groupBy(set_col).agg(F.coalesce(F.try_divide(2 * F.sum(both), F.sum(each)), F.lit(0.0)).alias("entity_f1"))
    per = per.join(exact, set_col)
    names = ["redact_recall", "redact_precision", "entity_recall", "redact_f1", "entity_f1"]
    return per.select(F.col(set_col).alias("set"), *names).unionByName(per.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("macro").alias("set"), *names))


def punctuation_windows(df: DataFrame, key: str, text: str, lang: str, evals: DataFrame, val: float = 0.015, seed=0) -> DataFrame:
    """Quality-filtered texts -> unit windows with mark and case labels, sentence-level decontaminated, split by key."""
    ok = ends_sentence(text) & (letter_share(text) >= 0.6)
    t = dedup.decontaminate_sentences(df.where(ok), key, text, evals, min_len=40)
    t = seqlabel.punct_units(t.select(key, lang, text), text, lang)
    marks = F.transform("units", lambda x: F.when(x["lab"] == "0", 0).otherwise(1))
    t = explode_rows(t, [key, lang], F.array(F.struct("units", filters.mark_density(marks).alias("ok"))), "x").where("x.ok and size(x.units) >= 6").select(key, lang, F.col("x.units").alias("units"))
    w = seqlabel.unit_windows(t.withColumn("_u", F.col("units")).drop("units"), key, "_u", lang, seed=seed)
    return sampling.split_hash(w, [key], val, seed)


def ingest_teacher(lp: DataFrame, human: DataFrame, key: str, label: str, alpha: float, neutral_share: float, seed=0) -> DataFrame:
    """Log-probabilities -> P(yes) -> calibrated on co-scored rows -> blended with human labels -> undecided rows capped."""
    p = labels.p_yes(lp, [key])
    co = p.join(human.select(key, F.col(label).alias("_y")), key)
    blocks = labels.pav_fit(co, "p_yes", "_y")
    cal = labels.pav_apply(p, blocks, "p_yes", "calibrated").join(human.select(key, F.col(label).cast("double").alias("_y")), key, "left")
    soft = cal.select(key, "p_yes", F.when(F.col("_y").isNotNull(), labels.mix("calibrated", "_y", alpha)).otherwise(F.col("calibrated")).alias("soft"))
    return sampling.cap_share(soft, F.col("soft").between(0.4, 0.6), F.lit(True), neutral_share, seed, [key])


def mine_candidates(queries: DataFrame, passages_: DataFrame, k: int, by: str, per_group: int, seed=0) -> DataFrame:
    """Hard negatives for every query, source first, a quota of queries per group."""
    c = retrieval.candidates(retrieval.mine(queries, passages_, k, by), queries, k + 1)
    return sampling.quota(c.join(queries.select("qid", by), "qid"), [by], per_group, seed, ["qid"])


def retrieval_report(df: DataFrame, qid: str, pos: str, rel: str, score: str, family: str, member: str) -> DataFrame:
    """nDCG and MRR per member set, family means and the mean of families."""
    per_q = materialise(retrieval.ranking_metrics(df, qid, pos, rel, score, by=[family, member]))  # read once per metric and level
    n = profile.rollup_means(per_q, [family, member], "ndcg").withColumnRenamed("value", "ndcg")
    m = profile.rollup_means(per_q, [family, member], "mrr").withColumnRenamed("value", "mrr")
    return n.join(m, ["level", "key"])


def augment_table(df: DataFrame, evals: DataFrame, id_col: str, text: str, label: str, n_per_class: int, ops: list[str], seed=0) -> DataFrame:
    """The table plus perturbed copies, the same number and operators for both classes, without evaluation or old texts."""
    pick = sampling.quota(df, [label], n_per_class, seed, [id_col])
    new = augment.perturb_random(pick, text, id_col, ops, seed)
    new = dedup.decontaminate(dedup.decontaminate(pin(new, text, F.col(text)), text, evals), text, df, text)
    new = dedup.drop_conflicts(new, norm_key(text), label, keep_one=id_col)
    return df.withColumn("augmented", F.lit(0)).unionByName(new.withColumn("augmented", F.lit(1)))


def junk_predictions(df: DataFrame, text: str, label: str, folds: int = 3, seed=0) -> DataFrame:
    """Rows with `pred`, a class from a detector that was fitted on the other folds; rows of one text share a fold."""
    t = materialise(df.withColumn("_fold", F.pmod(h32(seed, text), F.lit(folds))))  # read once per fold and side
    out = None
    for f in range(folds):
        part = ml.train_lid(t.where(F.col("_fold") != f), text, label).transform(t.where(F.col("_fold") == f))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def evaluation_report(preds: DataFrame, gold: str = "gold", score: str = "score", lang: str = "lang", set_col: str = "set") -> DataFrame:
    """All sets and languages in one job: long table (set, lang, metric, value); lang = 'all' for the pooled set."""
    by = ["set", "lang"]
    cube = metrics.score_cube(preds.select(F.col(set_col).alias("set"), F.col(lang).alias("lang"), F.col(gold).alias("gold"), F.col(score).alias("score")), by=by, totals=["lang"])
    wide = metrics.cube_binary(cube, by=by).join(metrics.cube_auc(cube, by).select(*by, "auc"), by)
    names = ["acc", "precision", "recall", "f1", "fpr", "fnr", "auc"]
    return wide.unpivot(by, names, "metric", "value").where("value is not null")


def full_report(preds: DataFrame, classes: DataFrame, values: DataFrame) -> DataFrame:
    """Binary, multi-class and regression sets in one long table (set, lang, metric, value).

    preds(set, lang, gold, score), classes(set, lang, gold, pred), values(set, lang, gold, pred); lang = 'all' pools a set. Classes are
    counted once per (set, lang, gold, pred), values once per pair."""
    by = ["set", "lang"]
    both = lambda df: df.withColumn("lang", F.explode(F.array("lang", F.lit("all"))))
    c = both(classes)
    multi = metrics.multiclass(c, "gold", "pred", by).join(metrics.balanced_accuracy(c, "gold", "pred", by), by)
    multi = multi.unpivot(by, ["acc", "macro_f1", "bacc"], "metric", "value")
    reg = metrics.regression_metrics(both(values), "gold", "pred", by).unpivot(by, ["spearman", "pearson"], "metric", "value")
    return evaluation_report(preds).unionByName(multi).unionByName(reg).where("value is not null")


def model_leaderboard(preds: DataFrame, sets: list[str], metric: str = "f1") -> DataFrame:
    """Models by sets, with the macro mean and the rank by it, from preds(model, set, lang, gold, score): one report for all of them."""
    tagged = preds.withColumn("set", F.concat_ws("\t", "model", "set"))
    name = F.split("set", "\t")
    r = evaluation_report(tagged).where((F.col("lang") == "all") & (F.col("metric") == metric)).select(name[0].alias("model"), name[1].alias("set"), "value")
    board = metrics.leaderboard(r, sets)
    better = board.select(F.col("model").alias("_m"), F.col("macro").alias("_v"))  # a row per model
    ahead = board.join(better, F.col("_v") > F.col("macro"), "left").groupBy("model").agg(F.count("_m").alias("_n"))
    return board.join(ahead, "model").withColumn("rank", F.when(F.col("macro").isNotNull(), F.col("_n") + 1)).drop("_n")


def tuned_report(preds: DataFrame, grid: list[float], key: str, gold: str = "gold", score: str = "score", lang: str = "lang", dev: float = 0.5, min_pos: int = 8, seed=0) -> DataFrame:
    """Thresholds per language from a hashed dev share, and the metrics that they reach on the other rows."""
    s = sampling.split_hash(preds, [key], dev, seed, ("dev", "test"))
    cuts = metrics.tune_thresholds(s.where("split = 'dev'"), grid, gold, score, [lang], min_pos).select(lang, "threshold")
    test = metrics.apply_thresholds(s.where("split = 'test'"), cuts, [lang], score)
    return metrics.binary_metrics(test, gold, "pred", by=[lang]).join(cuts, lang).select(lang, "threshold", "n", "pos", "precision", "recall", "f1")


def prompt_pool(conv: DataFrame, lo: int, hi: int, n_test: int, n_train: int, seed=0) -> DataFrame:
    """First user messages and answered prompts: length filter, unique, disjoint test and train rows per kind."""
    r = filters.prompt_response_rows(conv)
    some = filters.len_between(r, "text", lo, hi).select("conv_id", "kind", dedup._digest([norm_key("text")]).alias("_k"), dedup._digest([F.col("text_pair")]).alias("_p"))
    keys = materialise(some)  # unique rows, quotas and ranks are found among digests; the texts are joined at the end
    one = keys.groupBy("kind", "_k", "_p").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "kind")
    chosen = sampling.slices(one, ["kind"], n_test, n_train, seed, ["conv_id"])
    return r.join(chosen, ["conv_id", "kind"])


def compression_report(df: DataFrame, key: str, text: str, lang: str, rates: list[float], seed=0) -> DataFrame:
    """Kept share of units and characters per rate and language."""
    out = None
    base = df.select(key, F.col(lang).alias("_l"), F.length(text).alias("_n"))
    for r in rates:
        c = compress.compress_random(df, key, text, r, lang, seed).where("n_units > 0")
        x = c.join(base, key).groupBy(F.col("_l").alias("lang")).agg(F.avg(F.col("n_kept") / F.col("n_units")).alias("kept_units"), F.avg(F.length("context") / F.col("_n")).alias("kept_chars")).withColumn("rate", F.lit(r))
        out = x if out is None else out.unionByName(x)
    return out


def claim_table(items: DataFrame, responses: DataFrame, item: str, val: float = 0.2, keep: float = 1.0, seed=0) -> DataFrame:
    """Claim pairs for a share of the items with all their claims, split so that an item stays on one side."""
    chosen = sampling.sample_groups(items, [item], keep, f"{seed}.k") if keep < 1 else items
    return sampling.split_group(labels.claim_pairs(chosen, responses, item, seed), [item], val, seed)


def domain_profile(df: DataFrame, cols: list[str], names: list[str], lang: str) -> DataFrame:
    """Share of every domain (largest score) per language."""
    d = df.withColumn("domain", filters.argmax_label(cols, names)).groupBy(lang, "domain").agg(F.count(F.lit(1)).alias("n"))
    tot = d.groupBy(lang).agg(F.sum("n").alias("_t"))
    return d.join(tot, lang).select(lang, "domain", "n", (F.col("n") / F.col("_t")).alias("share"))


def rebalance(df: DataFrame, cols: list[str], names: list[str], targets: Mapping[str, float], total: int, key: str, seed=0) -> DataFrame:
    """Down-sample so that each domain has at most its target share of `total` rows."""
    d = df.withColumn("domain", filters.argmax_label(cols, names))
    return sampling.quota(d, ["domain"], 0, seed, [key], overrides={n: int(total * s) for n, s in targets.items()})
