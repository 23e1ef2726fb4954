"""Sentences, passages and windows as rows, and the text helpers of pool jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import WS, _c, h32, sentences, u
from ..functions.units import explode_rows, pin, sentence_window, windows


def sentence_rows(df: DataFrame, ids: list[str], text: str, lo: int = 1, hi: int | None = None) -> DataFrame:
    return explode_rows(df, ids, sentences(text, lo, hi), "sentence").drop("pos")


def passages(df: DataFrame, key: str, text: str, kmin: int, kmax: int, lo: int, hi: int, seed=0, min_sent: int = 15) -> DataFrame:
    """One passage per row: kmin..kmax consecutive sentences from a hashed start, kept when lo..hi characters long."""
    return pin(df, "passage", sentence_window(text, key, seed, kmin, kmax, min_sent)).where(F.length("passage").between(lo, hi))


def window_rows(df: DataFrame, ids: list[str], words: str, size: int, stride: int) -> DataFrame:
    return explode_rows(df, ids, windows(F.col(words), size, stride), "window")


def doc_max(df: DataFrame, doc: str, score: str) -> DataFrame:
    """Highest window score per document, at least 0."""
    return df.groupBy(doc).agg(F.greatest(F.max(score), F.lit(0.0)).alias(score))


def strip_end(c: Column | str, key: Column | str, seed) -> Column:
    """Sentence without its end marks and inverted marks; a hashed half is lower-cased."""
    t = F.regexp_replace(F.regexp_replace(_c(c), rf"(?:{WS}|[.!?。！？؟;;…:،।։])+$", ""), "^[¿¡]+", "")
    return F.when(u(seed, key) < 0.5, F.lower(t)).otherwise(t)


def is_question(c: Column | str, lang: Column | str) -> Column:
    t, code = _c(c), _c(lang)
    return t.rlike(rf"[?？؟]{WS}*$") | ((code == "el") & t.rlike(rf"[;;]{WS}*$")) | ((code == "hy") & t.contains("՞"))


def hypothesis(label: Column | str, templates: list[str], key: Column | str, seed) -> Column:
    """Hash-chosen template filled with a prettified label (underscores to blanks mostly, lower-case half the time)."""
    from .joins import fill_template

    lab = _c(label)
    lab = F.when(u(f"{seed}.s", key) < 0.8, F.replace(lab, F.lit("_"), F.lit(" "))).otherwise(lab)
    lab = F.when(u(f"{seed}.l", key) < 0.5, F.lower(lab)).otherwise(lab)
    t = F.element_at(F.array(*[F.lit(x) for x in templates]), (F.pmod(h32(f"{seed}.t", key), F.lit(len(templates))) + 1).cast("int"))
    return fill_template(t, lab)


def json_splice(c: Column | str, key: Column, payload: Column) -> Column:
    """Payload appended to a key of a flat JSON object, or added as a new key."""
    m = F.from_json(_c(c), "map<string,string>")
    old = F.try_element_at(m, key)
    value = F.trim(F.concat(F.coalesce(old, F.lit("")), F.lit(" "), payload))
    rest = F.map_filter(m, lambda k, v: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(key, value)))


def drop_sentence(sents: Column | str, idx: Column | str) -> Column:
    i0 = _c(idx)
    return F.filter(_c(sents), lambda x, i: i != i0)


def sole_owner(df: DataFrame, fact: list[str], doc: str) -> DataFrame:
    """Facts stated by exactly one document, with that document."""
    return df.groupBy(*fact).agg(F.count(F.lit(1)).alias("_n"), F.min(doc).alias(doc)).where("_n = 1").drop("_n")


def join_runs(df: DataFrame, keys: list[str], order: str, text: str, sep: str = " ", block: int = 1024) -> DataFrame:
    """(keys, n, text): the texts of every run in order, joined.

    Runs are cut at every `block` lines; the pieces are joined first, in tasks of their own, and then the pieces of a run, so a task
    sorts at most `block` lines of a run, and one joined text per block besides the result itself."""
    ordered = lambda by, c: F.sort_array(F.collect_list(F.struct(by, c)))[c]
    cut = df.withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    pieces = cut.groupBy(*keys, "_b").agg(F.array_join(ordered(order, text), sep).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return pieces.groupBy(*keys).agg(F.sum("_n").alias("n"), F.array_join(ordered("_b", "_t"), sep).alias("text"))


def extract_blocks(df: DataFrame, ids: list[str], text: str, rx: str, min_len: int) -> DataFrame:
    """Distinct tagged blocks of a transcript that are longer than min_len."""
    b = explode_rows(df, ids, F.regexp_extract_all(text, F.lit(rx), F.lit(1)), "block").where(F.length("block") > min_len)
    return b.select(*ids, F.trim("block").alias("block")).distinct()


def prefix(c: Column | str, s: str) -> Column:
    return F.concat(F.lit(s), _c(c))
