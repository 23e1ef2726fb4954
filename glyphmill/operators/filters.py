"""Row filters and record shaping: projections and predicates only, so they reach the scan."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import norm_key, strip
from ..functions.text import english_like, script_frac


def to_record(df: DataFrame, text: str, label: Column | int, source: str, kind: str = "direct",
              lang: Column | str = "en") -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(strip(text).alias("text"), lit(label).cast("int").alias("label"), F.lit(source).alias("source"),
                     F.lit(kind).alias("kind"), lit(lang).alias("lang"))


def len_between(df: DataFrame, text: str, lo: int, hi: int | None = None) -> DataFrame:
    n = F.length(text)
    return df.where(n >= lo) if hi is None else df.where(n.between(lo, hi))


def drop_sources(df: DataFrame, rx: str, source: str = "source", keep: bool = False) -> DataFrame:
    """Drop (or keep) sources whose name starts with a match of the pattern."""
    hit = F.col(source).rlike(f"^(?:{rx})")
    return df.where(hit if keep else ~hit)


def url_class(url: str, patterns: Mapping[str, str]) -> Column:
    """First class whose pattern occurs in the URL, else 'other'."""
    out = F.lit("other")
    for name, rx in reversed(list(patterns.items())):
        out = F.when(F.col(url).rlike(rx), name).otherwise(out)
    return out


def contamination_flags(df: DataFrame, text: str, label: str, prob: str | None = None,
                        target: str = "eng_Latn") -> DataFrame:
    """Flags d_model / d_script / d_english for labels written xxx_Script."""
    script = F.element_at(F.split(label, "_"), -1)
    df = df.withColumn("d_script", (script != "Latn") & (script_frac(text, script) < 0.5))
    df = df.withColumn("d_english", (script == "Latn") & (F.col(label) != target) & english_like(text))
    model = confident_other(label, prob, target) if prob else F.lit(False)
    return df.withColumn("d_model", model)


def confident_other(label: str, prob: str, target: str, cut: float = 0.9) -> Column:
    """A model is sure of `target` although the row carries another label."""
    return (F.col(label) != target) & (F.coalesce(F.col(prob), F.lit(0.0)) > cut)


def filter_report(df: DataFrame, flags: list[str], by: str) -> DataFrame:
    """Rows dropped per rule and in total, per label, in one pass."""
    any_flag = F.greatest(*[F.col(f).cast("int") for f in flags])
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("int")).alias(f) for f in flags],
                              F.sum(any_flag).alias("dropped"))


def mark_density(labels: Column, max_share: float = 0.35, max_gap: int = 60) -> Column:
    """At most `max_share` labelled units and no run of `max_gap` or more unlabelled units (0 = unlabelled)."""
    n = F.size(labels)
    flags = F.array_join(F.transform(labels, lambda x: F.when(x != 0, "1").otherwise("0")), "")
    n_marks = F.length(F.replace(flags, F.lit("0"), F.lit("")))
    return (n > 0) & (n_marks > 0) & (n_marks <= n * max_share) & ~F.contains(flags, F.lit("0" * max_gap))


def decided(df: DataFrame, p: str, lo: float = 0.2, hi: float = 0.8, exempt: Column | None = None,
            veto: Column | None = None) -> DataFrame:
    ok = (F.col(p) <= lo) | (F.col(p) >= hi)
    if exempt is not None:
        ok = ok | exempt
    if veto is not None:
        ok = ok & ~veto
    return df.where(ok)


def faithful_filter(df: DataFrame, min_faithful: float = 0.9, min_units: int = 30, kept: tuple = (0.10, 0.95)):
    return df.where((F.col("finish") == "stop") & (F.col("faithful") >= min_faithful)
                    & (F.col("n_units") >= min_units) & F.col("kept").between(*kept))


# Phrases by which a model declines a request.
REFUSAL = r"(?i)(I can(?:'|no)t|I cannot|I'm sorry|I am sorry|as an AI|I won't|unable to (?:help|assist|translate))"


def translation_reason(src: str, out: str, lo: float = 0.3, hi: float = 3.5) -> Column:
    """Why a translated row is rejected: parse, refusal, length, same; 'ok' otherwise."""
    s, o = F.col(src), F.col(out)
    ratio = F.length(o) / F.greatest(F.length(s), F.lit(1))
    return (
        F.when(o.isNull() | (F.length(F.trim(o)) == 0), "parse")
        .when(o.rlike(REFUSAL) & ~s.rlike(REFUSAL), "refusal")
        .when((ratio < lo) | (ratio > hi), "length")
        .when(s == o, "same")
        .otherwise("ok")
    )


def valid_injection(clean: str, injected: str, span: str, n: int = 60) -> Column:
    """The attacked text differs from the clean one and holds the first n normalised characters of the span."""
    want = F.substring(norm_key(span), 1, n)
    return (F.col(clean) != F.col(injected)) & (F.length(want) > 0) & (F.instr(norm_key(injected), want) > 0)


def span_only_in(span: str, a: str, b: str) -> Column:
    return F.col(a).contains(F.col(span)) & ~F.col(b).contains(F.col(span))


def drop_unusable(df: DataFrame, text: str, bad: list[str]) -> DataFrame:
    """No empty text and none of the placeholder markers (e.g. REDACTED)."""
    rx = "(?i)" + "|".join(bad)
    return df.where(F.col(text).isNotNull() & (F.length(F.trim(text)) > 0) & ~F.col(text).rlike(rx))


def map_labels(df: DataFrame, dim: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Dictionary mapping by a join with a two-column table (key, value); without default, unmapped rows get NULL."""
    d = dim.select(F.col(dim.columns[0]).alias("_k"), F.col(dim.columns[1]).alias(value))
    out = df.join(d, df[key].eqNullSafe(d["_k"]), "left").drop("_k")
    return out.fillna({value: default}) if default is not None else out


def map_const(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Dictionary mapping for a handful of classes as a literal map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c)


def bin_label(c: str, edges: list[float], names: list[str]) -> Column:
    """names[i] for values <= edges[i]; the last name above the last edge."""
    out = F.lit(names[-1])
    for e, n in zip(reversed(edges), reversed(names[:-1])):
        out = F.when(F.col(c) <= e, n).otherwise(out)
    return F.when(F.col(c).isNull(), F.lit(None)).otherwise(out)


def any_flag(cols: list[str]) -> Column:
    return F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols])


def score_cats(scores: Mapping[str, str], cut: float = 0.5) -> Column:
    """Names of the score columns that reach the cut, in the given order."""
    return F.array_compact(F.array(*[F.when(F.col(c) >= cut, F.lit(n)) for c, n in scores.items()]))


def argmax_label(cols: list[str], names: list[str]) -> Column:
    """Name of the largest column; the first one wins ties."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_max(arr)).cast("int"))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL and NaN are both missing."""
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = cond & ok
    return df.where(cond)


def accept_items(df: DataFrame, item: str, typ: str, lo: int, hi: int, allowed: list[str]) -> DataFrame:
    """Generated items: text present, length band, allowed type, invalid code points removed."""
    clean = F.trim(F.regexp_replace(item, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�￾￿]", ""))
    return df.withColumn(item, clean).where(F.length(item).between(lo, hi) & F.col(typ).isin(*allowed))


def both_classes(df: DataFrame, doc: str, label: str) -> DataFrame:
    """Keep documents that hold both classes: partial min/max per document, then a semi join (no window per group)."""
    ok = df.groupBy(doc).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo <> _hi").select(doc)
    return df.join(ok, doc, "left_semi")


def edgy(score: str, cut: float, source_rx: str, side: str, side_cut: float, source: str = "source") -> Column:
    """Below the score cut, yet the source pattern or a side score points to a hard negative."""
    return (F.col(score) < cut) & (F.col(source).rlike(source_rx) | (F.col(side) >= side_cut))


def valid_label_set(labels: str, translated: str, template: str) -> Column:
    return ((F.size(labels) == F.size(translated)) & F.forall(translated, lambda x: F.length(F.trim(x)) > 0)
            & (F.size(F.split(template, r"\{\}")) == 2))


def quality_cut(df: DataFrame, score: str, k: int = 3, top: int = 5) -> DataFrame:
    s = F.bround(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(float(top)))).cast("int")
    return df.withColumn("int_score", s).where(F.col("int_score") >= k)


# ---- conversations ------------------------------------------------------------------------------------------------

def root_turns(df: DataFrame, roles: tuple = ("user",)) -> DataFrame:
    """Opening messages: the first turn of a conversation when it comes from a prompter."""
    first = df.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return df.join(first, ["conv_id", "turn"], "left_semi").where(F.col("role").isin(*roles))


def edge_user(df: DataFrame, last: bool = False) -> DataFrame:
    """First (or last) user message per conversation."""
    pick = F.max_by if last else F.min_by
    return df.where("role = 'user'").groupBy("conv_id").agg(pick("text", "turn").alias("text"))


def prompt_response_rows(df: DataFrame) -> DataFrame:
    """Per conversation one prompt row and, when the assistant answered it, one prompt+response row."""
    # the reply is the first assistant turn after the first user turn; both come out of two partial aggregations
    first = df.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("t0"), F.min_by("text", "turn").alias("prompt"))
    reply = (
        df.where("role = 'assistant'").join(first.select("conv_id", "t0"), "conv_id").where(F.col("turn") > F.col("t0"))
        .groupBy("conv_id").agg(F.min_by("text", "turn").alias("response"))
    )
    both = first.join(reply, "conv_id", "left")
    items = F.array(
        F.struct(F.lit("prompt").alias("kind"), F.col("prompt").alias("text"), F.lit("").alias("text_pair")),
        F.struct(F.lit("response").alias("kind"), F.col("prompt").alias("text"), F.col("response").alias("text_pair")))
    return (both.select("conv_id", F.explode(items).alias("r")).select("conv_id", "r.*")
            .where(F.col("text_pair").isNotNull()))


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|-?Infinity|NaN")


def _deep_leaves(text: str) -> list[tuple[str, str]]:
    """`_string_leaves` for a text that is nested too deeply for the parser: a loop over its tokens with a stack of its own.

    Of a key that an object has twice, both values count here."""
    out: list[tuple[str, str]] = []
    stack: list[list] = []  # ["{", key] or ["[", index]
    skip = lambda at: _BLANK.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at:at + 1] != '"':
            raise ValueError("no key")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at:at + 1] != ":":
            raise ValueError("no colon")
        return name, skip(at + 1)

    at = skip(0)
    while True:
        c = text[at:at + 1]
        if c in ("{", "["):
            at = skip(at + 1)
            if text[at:at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    name, at = key(at)
                stack.append([c, name if c == "{" else 0])
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            out.append(("$" + "".join(f".{k}" if kind == "{" else f"[{k}]" for kind, k in stack), value))
        elif plain := _PLAIN.match(text, at):
            at = plain.end()
        else:
            raise ValueError("no value")
        while True:  # what follows a value
            at = skip(at)
            if not stack:
                if at < len(text):
                    raise ValueError("more than one value")
                return out
            c, top = text[at:at + 1], stack[-1]
            at += 1
            if c == ("}" if top[0] == "{" else "]"):
                stack.pop()
                continue
            if c != ",":
                raise ValueError("no comma")
            at = skip(at)
            if top[0] == "{":
                top[1], at = key(at)
            else:
                top[1] += 1
            break


def _string_leaves(text: str) -> list[tuple[str, str]]:
    """(path, string) of every string in a JSON text, in document order; nothing if it doesn't parse."""
    try:
        todo, out = [("$", json.loads(text))], []
    except RecursionError:
        try:
            return _deep_leaves(text)
        except ValueError:
            return []
    except (TypeError, ValueError):
        return []
    while todo:  # a stack of its own, so any depth is walked
        path, node = todo.pop()
        if isinstance(node, str):
            out.append((path, node))
        elif isinstance(node, dict):
            todo += [(f"{path}.{k}", v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])))
def _leaves(texts: pd.Series) -> pd.Series:
    return texts.map(_string_leaves)


def json_leaves(df: DataFrame, ids: list[str], json: str, min_len: int = 60) -> DataFrame:
    """Every string leaf longer than `min_len` with its path (`$.a[0].b`), at any depth: one parse and one pass per text.

    The parser is Python's: SQL functions unfold a fixed number of levels only."""
    rows = df.select(*ids, F.explode(_leaves(F.col(json))).alias("_leaf"))
    return rows.select(*ids, "_leaf.path", "_leaf.text").where(F.length("text") > min_len)
