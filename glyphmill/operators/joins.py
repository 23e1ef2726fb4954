"""Joins that build ranking rows, padded candidate lists, contexts and text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import h32, pick, u
from .sampling import hash_rank


def ranking_rows(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, top: DataFrame) -> DataFrame:
    """corpus(cid, doc), queries(qid, query), qrels(qid, cid, rel), top(qid, cands) ->
    (qid, query, cids, docs, rels) in candidate order, for queries with at least one relevant and one other candidate."""
    long = top.select("qid", F.posexplode("cands").alias("pos", "cid"))
    # relevance first and without texts: queries that fail the test never pull their documents
    judged = long.join(qrels, ["qid", "cid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    judged = judged.join(corpus.select("cid"), "cid", "left_semi")
    ok = judged.groupBy("qid").agg(F.max((F.col("rel") > 0).cast("int")).alias("_p"), F.min((F.col("rel") > 0).cast("int")).alias("_n")).where(
        "_p = 1 and _n = 0").select("qid")
    full = judged.join(ok, "qid", "left_semi").join(corpus, "cid")
    lists = full.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "cid", "doc", "rel"))).alias("l"))
    return queries.join(lists, "qid").select("qid", "query", F.col("l.cid").alias("cids"), F.col("l.doc").alias("docs"),
                                             F.col("l.rel").alias("rels"))


def pad_candidates(df: DataFrame, pool: DataFrame, group: str, size: int, seed=0, pos: str = "pos_ids", neg: str = "neg_ids",
                   qid: str = "qid", did: str = "did") -> DataFrame:
    """Ordered distinct candidates (positives, then negatives), filled up to `size` with random pool documents of the group.

    Every pool document has a dense hash rank in its group; a query takes consecutive ranks from a hashed start, so the
    fill is an equi-join on (group, rank) and no group is ever paired with itself."""
    base = df.withColumn("_have", F.array_distinct(F.concat(pos, neg)))
    short = base.where(F.size("_have") < size)
    n = pool.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(pool.select(group, did), [group], seed, [did])
    # at most len(have) of the consecutive ranks can already be in the list, so size of them always suffice
    want = short.select(qid, group, "_have").join(n, group).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("_n").cast("int")) - 1))).withColumn(
        "_rank", (F.pmod(h32(seed, qid) + F.col("_j"), F.col("_n")) + 1))
    fill = want.join(ranked, [group, "_rank"]).where(~F.array_contains("_have", F.col(did))).groupBy(qid).agg(
        F.sort_array(F.collect_list(F.struct("_j", did))).alias("_l"))
    return base.join(fill.select(qid, F.col(f"_l.{did}").alias("_fill")), qid, "left").withColumn(
        "cands", F.slice(F.concat("_have", F.coalesce("_fill", F.array().cast(dict(base.dtypes)["_have"]))), 1, size)).drop(
        "_have", "_fill")


def distractor_context(questions: DataFrame, paras: DataFrame, k: int, seed=0, qid: str = "qid", title: str = "title",
                       pid: str = "pid", text: str = "text") -> DataFrame:
    """The gold paragraph of each question with paragraphs from k other titles (all others, if there are fewer), shuffled;
    keeps the gold position.

    Titles are ranked densely; the distractors come from consecutive titles after a hashed start that leaves out the own
    title, and inside each from a hashed dense position: two equi-joins, no pairing of all paragraphs."""
    counts = paras.groupBy(title).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked_titles = hash_rank(counts, [], f"{seed}.t", [title], name="_tr")
    total = counts.agg((F.count(F.lit(1)) - 1).alias("_T"))  # titles other than the own one
    pr = hash_rank(paras.select(title, pid, text), [title], f"{seed}.p", [pid], name="_pr")
    q = questions.select(qid, title, F.col(pid).alias("_gold")).join(ranked_titles.select(title, "_tr"), title).crossJoin(total)
    wanted = F.when(F.col("_T") > 0, F.sequence(F.lit(0).cast("long"), F.least(F.lit(k), F.col("_T")).cast("long") - 1))
    step = 1 + F.pmod(h32(f"{seed}.d", qid) + F.col("_j"), F.col("_T"))  # distances 1.._T, all different for one question
    want = q.where("_T > 0").withColumn("_j", F.explode(wanted)).withColumn("_tr", F.pmod(F.col("_tr") - 1 + step, F.col("_T") + 1) + 1).select(qid, "_j", "_tr")
    other = want.join(ranked_titles.withColumnRenamed(title, "_ot"), "_tr").withColumn(
        "_pr", F.pmod(h32(f"{seed}.i", qid, "_j"), F.col("_cnt")) + 1)
    dis = other.join(pr.withColumnRenamed(title, "_ot"), ["_ot", "_pr"]).select(qid, F.col(pid).alias("_p"), F.col(text).alias("_t"), F.lit(0).alias("_g"))
    gold = questions.select(qid, F.col(pid).alias("_p")).join(paras.select(F.col(pid).alias("_p"), F.col(text).alias("_t")), "_p").select(
        qid, "_p", "_t", F.lit(1).alias("_g"))
    order = F.struct(h32(f"{seed}.o", qid, "_p").alias("h"), "_p", "_t", "_g")
    return dis.unionByName(gold).groupBy(qid).agg(F.sort_array(F.collect_list(order)).alias("_l")).select(
        qid, F.array_join(F.col("_l._t"), "\n\n").alias("context"), (F.array_position(F.col("_l._g"), 1) - 1).alias("gold_pos"),
        F.col("_l._p").alias("pids"))


def assemble_shards(base: DataFrame, shards: DataFrame, row: str) -> DataFrame:
    """Base rows with their shard scores; check with `shard_gaps` that nothing is missing."""
    return base.join(shards, row)


def shard_gaps(base: DataFrame, shards: DataFrame, row: str) -> DataFrame:
    """Completeness of a set of shards: rows expected, delivered, missing, unknown and delivered twice."""
    s = shards.groupBy(row).agg(F.count(F.lit(1)).alias("_c"))
    j = base.select(row, F.lit(1).alias("_b")).join(s, row, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.agg(n(F.col("_b").isNotNull()).alias("expected"), n(F.col("_c").isNotNull()).alias("delivered"),
                 n(F.col("_c").isNull()).alias("missing"), n(F.col("_b").isNull()).alias("unknown"),
                 n(F.col("_c") > 1).alias("repeated"))


def require_complete(base: DataFrame, shards: DataFrame, row: str) -> DataFrame:
    gaps = shard_gaps(base, shards, row).first()
    if gaps.missing or gaps.unknown or gaps.repeated:
        raise ValueError(f"shards incomplete: {gaps.asDict()}")
    return assemble_shards(base, shards, row)


def blend_scores(df: DataFrame, new: DataFrame, w: float, row: str, score: str = "score") -> DataFrame:
    """w*new + (1-w)*old where a new score exists, else the old one."""
    n = new.select(row, F.col(score).alias("_new"))
    return df.join(n, row, "left").withColumn(
        score, F.coalesce(F.lit(w) * F.col("_new") + F.lit(1 - w) * F.col(score), F.col(score))).drop("_new")


def native_labels(df: DataFrame, dim: DataFrame, frac: float, seed=0, key: str = "id") -> DataFrame:
    """Swap label set, template and gold for their translations on (lang, labels, template), for a share of the rows.

    df(id, lang, labels, template, gold, ...), dim(lang, labels, template, native_labels, native_template)."""
    j = df.withColumn("_u", u(seed, key)).join(dim, ["lang", "labels", "template"], "left")
    hit = F.col("native_labels").isNotNull() & (F.col("_u") < frac)
    pos = lambda g: F.array_position("labels", g).cast("int")
    gold = F.transform(F.filter("gold", lambda g: F.array_contains("labels", g)), lambda g: F.element_at("native_labels", pos(g)))
    out = j.withColumn("gold", F.when(hit, gold).otherwise(F.col("gold"))).withColumn("native", hit)
    return (out.withColumn("labels", F.when(hit, F.col("native_labels")).otherwise(F.col("labels")))
            .withColumn("template", F.when(hit, F.col("native_template")).otherwise(F.col("template")))
            .where(F.size("gold") > 0).select(*df.columns, "native"))


def fill_template(template: Column | str, label: Column | str) -> Column:
    """First {} of the template replaced by the label."""
    t = F.col(template) if isinstance(template, str) else template
    lab = F.col(label) if isinstance(label, str) else label
    at = F.instr(t, "{}")
    return F.when(at == 0, t).otherwise(F.concat(t.substr(F.lit(1), at - 1), lab, t.substr(at + 2, F.length(t))))


def nli_pairs(df: DataFrame, ids: list[str], text: str, labels: str, gold: str, template: str) -> DataFrame:
    """One row per text and candidate label: hypothesis and 1 where the label is gold."""
    x = df.select(*ids, F.col(text).alias("text"), F.col(gold).alias("_gold"), F.col(template).alias("_tpl"),
                  F.posexplode(labels).alias("label_idx", "_lab"))
    return x.select(*ids, "label_idx", "text", fill_template("_tpl", "_lab").alias("text_pair"),
                    F.array_contains("_gold", F.col("_lab")).cast("int").alias("label"))


def span_overlap(pred: DataFrame, gold: DataFrame, doc: str, width: int = 256) -> DataFrame:
    """Predicted and gold spans of a document that overlap: equi-join on the document and a bin of positions.

    Every span stands in the bins of `width` positions that it touches; a pair is reported in the bin in which the later of
    the two starts lies, so once. A document with many spans is many small keys."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(s) + 1, F.col(e)) - 1) / width)))
    p = pred.select(doc, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("label").alias("p_label"), bins("start", "end").alias("_bin"))
    g = gold.select(doc, F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("label").alias("g_label"), bins("start", "end").alias("_bin"))
    hit = (F.col("p_start") < F.col("g_end")) & (F.col("p_end") > F.col("g_start"))
    return p.join(g, [doc, "_bin"]).where(hit & (F.floor(F.greatest("p_start", "g_start") / width) == F.col("_bin"))).drop("_bin")


def lang_match(df: DataFrame, wanted: str, found: str, by: list[str]) -> DataFrame:
    hit = F.col(wanted).eqNullSafe(F.col(found)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("match"))
