"""Character spans: detection, cleaning, propagation, redaction, token tags and span metrics.

Spans are ARRAY<STRUCT<start INT, end INT, label STRING>> with code-point offsets, end exclusive. Work inside one text
uses array expressions (no shuffle); only metrics over many texts group by key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import dictionary
from ..functions.keys import NO_SPACE_LANGS, WS, _c
from ..functions.units import Points, cut, explode_rows, is_alnum, lists, match_spans, offsets_of, rfind, slices, text_bytes

SPANS = "array<struct<start:int,end:int,label:string>>"

# Patterns of personal data per label of the shared taxonomy.
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\s<>]+",
    "IP_ADDRESS": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "CREDIT_CARD": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{3,4}\b",
    "BANK_ACCOUNT": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "PHONE": r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}\b",
    "SECRET": r"\b(?:[0-9a-f]{32,64}|(?:sk|ghp|xoxb)[-_][A-Za-z0-9]{16,})\b",
}
# Names used by another recogniser family.
PRESIDIO = {
    "PERSON": "PERSON", "EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "LOCATION": "LOCATION",
    "STREET_ADDRESS": "LOCATION", "DATE": "DATE_TIME", "DATE_OF_BIRTH": "DATE_TIME", "CREDIT_CARD": "CREDIT_CARD",
    "BANK_ACCOUNT": "IBAN_CODE", "IP_ADDRESS": "IP_ADDRESS", "URL": "URL", "NATIONAL_ID": "US_SSN",
    "PASSPORT": "US_PASSPORT", "DRIVER_LICENSE": "US_DRIVER_LICENSE", "MEDICAL_ID": "MEDICAL_LICENSE",
}
BANKISH = r"(?i)(swift|bic|iban|routing|blz|sort code)"


def span(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.cast("string").alias("label"))


def _empty() -> Column:
    return F.array().cast(SPANS)


def _last(arr: Column) -> Column:
    return F.get(arr, F.size(arr) - 1)


def _but_last(arr: Column) -> Column:
    return F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))


def detect_pii(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Spans of every pattern, unresolved (they may overlap)."""
    def tagged(label: str, rx: str) -> Column:
        return F.transform(match_spans(text, rx), lambda x: span(x["start"], x["end"], F.lit(label)))

    return F.concat(*[tagged(label, rx) for label, rx in patterns.items()])


def map_spans(spans: Column | str, mapping: Mapping[str, str]) -> Column:
    """Labels renamed by dictionary; labels without an entry are dropped."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.filter(F.transform(_c(spans), lambda x: span(x["start"], x["end"], F.try_element_at(m, x["label"]))),
                    lambda x: x["label"].isNotNull())


def _trimmed(text: Column, x: Column, left: str, right: str) -> Column:
    inner = cut(text, x["start"], x["end"])
    head = F.length(inner) - F.length(F.regexp_replace(inner, left, ""))
    rest = F.length(F.regexp_replace(F.regexp_replace(inner, left, ""), right, ""))
    return span(x["start"] + head, x["start"] + head + rest, x["label"])


def trim_spans(text: Column | str, spans: Column | str) -> Column:
    """Spans inside the text, without white space at their edges, empty ones gone."""
    t = _c(text)
    ok = F.filter(_c(spans), lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(t)))
    return F.filter(F.transform(ok, lambda x: _trimmed(t, x, f"^{WS}+", f"{WS}+$")), lambda x: x["end"] > x["start"])


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("label", StringType())])))
def _stripped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, given in batches:
        for texts, spans in slices(text_bytes(column), column, given):
            p, flat = Points(texts), spans.flatten()
            row, start, at, size = p.places(spans)
            solid = np.flatnonzero(is_alnum(p.codes))
            near = np.concatenate([solid, [len(p.codes)]])
            head = np.minimum(near[np.searchsorted(solid, at)] - at, size)
            last = np.concatenate([[-1], solid])[np.searchsorted(solid, at + size)] + 1
            rest = np.maximum(last - at - head, 0)
            lost = np.array(pc.is_null(texts))[row] | np.array(pc.is_null(flat.field("start"))) | np.array(pc.is_null(flat.field("end")))
            parts = [pa.array(start + head, pa.int32(), mask=lost), pa.array(start + head + rest, pa.int32(), mask=lost), flat.field("label")]
            yield lists(pa.StructArray.from_arrays(parts, ["start", "end", "label"]), spans)


def strip_spans(text: Column | str, spans: Column | str) -> Column:
    """Spans without non-alphanumeric characters at their edges (before a comparison); linear in a text and its spans."""
    return _stripped(_c(text), F.transform(_c(spans), lambda x: span(x["start"], x["end"], x["label"])))


def clean_spans(text: Column | str, spans: Column | str) -> Column:
    """Trim, sort, merge neighbours of one label over at most one blank, and on overlap keep the first."""
    t = _c(text)

    def step(acc, x):
        last = _last(acc)
        gap = x["start"] - last["end"]
        join = (last["label"] == x["label"]) & gap.between(0, 1) & (F.length(F.trim(F.regexp_replace(cut(t, last["end"], x["start"]), WS, " "))) == 0)
        return (F.when(F.coalesce(join, F.lit(False)), F.concat(_but_last(acc), F.array(span(last["start"], x["end"], x["label"]))))
                .when(F.coalesce(x["start"] < last["end"], F.lit(False)), acc)
                .otherwise(F.concat(acc, F.array(x))))

    return F.aggregate(F.array_sort(trim_spans(t, spans)), _empty(), step)


def merge_overlaps(spans: Column | str) -> Column:
    """Spans from overlapping windows: same label and start not after the end before it become one."""
    def step(acc, x):
        last = _last(acc)
        join = (last["label"] == x["label"]) & (x["start"] <= last["end"])
        return F.when(F.coalesce(join, F.lit(False)),
                      F.concat(_but_last(acc), F.array(span(last["start"], F.greatest(last["end"], x["end"]), x["label"])))).otherwise(
            F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.array_distinct(_c(spans))), _empty(), step)


def merge_pieces(text: Column | str, pieces: Column | str, threshold: float = 0.5, labels: list[str] | None = None) -> Column:
    """Model pieces (start, end, label, score) to entities: pieces of one label at most 3 characters apart without a
    letter between them merge with the larger score; then trim, threshold and allow-list.

    A merged piece never shrinks: its end is the larger end."""
    t = _c(text)
    piece = lambda s, e, l, p: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), l.alias("label"), p.cast("double").alias("score"))
    src = F.transform(_c(pieces), lambda x: piece(x["start"], x["end"], x["label"], x["score"]))
    if labels is not None:
        src = F.filter(src, lambda x: x["label"].isin(*labels))

    def step(acc, x):
        last = _last(acc)
        join = (last["label"] == x["label"]) & (x["start"] - last["end"] <= 3) & ~cut(t, last["end"], x["start"]).rlike(r"\p{L}")
        return F.when(F.coalesce(join, F.lit(False)), F.concat(_but_last(acc), F.array(piece(
            last["start"], F.greatest(last["end"], x["end"]), x["label"], F.greatest(last["score"], x["score"]))))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.array_sort(src), F.array().cast("array<struct<start:int,end:int,label:string,score:double>>"), step)
    tr = F.transform(merged, lambda x: F.struct(_trimmed(t, x, f"^{WS}+", f"{WS}+$").alias("t"), x["score"].alias("score")))
    ok = F.filter(tr, lambda x: (x["score"] >= threshold) & (x["t"]["end"] > x["t"]["start"]))
    return F.transform(ok, lambda x: piece(x["t"]["start"], x["t"]["end"], x["t"]["label"], x["score"]))


def relabel_by_context(text: Column | str, spans: Column | str, label: str, rx: str, new: str, width: int = 30) -> Column:
    """A span of `label` whose preceding characters match the pattern gets the new label."""
    t = _c(text)
    before = lambda x: cut(t, F.greatest(x["start"] - width, F.lit(0)), x["start"])
    return F.transform(_c(spans), lambda x: span(x["start"], x["end"], F.when((x["label"] == label) & before(x).rlike(rx), new).otherwise(x["label"])))


def locate_all(text: Column | str, entities: Column | str, min_len: int = 2) -> Column:
    """All occurrences of each (text, label) entity string as spans, by one reading of the text."""
    return dictionary.locate(_c(text), _c(entities), min_len)


def align_entities(text: Column | str, entities: Column | str) -> Column:
    """Entity strings to non-overlapping spans: longer strings first, never inside a longer ASCII word."""
    return dictionary.align(_c(text), _c(entities))


def propagate(text: Column | str, spans: Column | str, name_types: tuple = ("PERSON",)) -> Column:
    """Tag every other whole-word occurrence of a tagged value, and of each capitalised word of a tagged name."""
    return dictionary.propagate(_c(text), _c(spans), name_types)


def redact(text: Column | str, spans: Column | str, fmt: str = "[{label}]") -> Column:
    """Each span replaced by its placeholder (spans sorted and disjoint, as clean_spans leaves them)."""
    t = _c(text)
    left, _, right = fmt.partition("{label}")
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        _c(spans), zero,
        lambda acc, x: F.struct(x["end"].alias("pos"), F.concat(acc["out"], cut(t, acc["pos"], x["start"]), F.lit(left), x["label"], F.lit(right)).alias("out")),
        lambda acc: F.concat(acc["out"], cut(t, acc["pos"])))


def strip_marks(text: Column | str, types: list[str]) -> tuple[Column, Column]:
    """Inline markers TYPE:value in double square brackets -> (clean text, spans of the known types)."""
    t = _c(text)
    parts = F.split(t, r"(?s)⟦[A-Z_]+:.*?⟧")
    marks = F.regexp_extract_all(t, F.lit(r"(?s)(⟦[A-Z_]+:.*?⟧)"), F.lit(1))
    items = F.zip_with(F.slice(parts, 1, F.size(marks)), marks, lambda p, m: F.struct(
        p.alias("p"), F.regexp_extract(m, r"(?s)^⟦([A-Z_]+):", 1).alias("label"), F.regexp_extract(m, r"(?s)^⟦[A-Z_]+:(.*)⟧$", 1).alias("value")))
    zero = F.struct(F.lit("").alias("out"), _empty().alias("spans"))

    def step(acc, x):
        start = F.length(acc["out"]) + F.length(x["p"])
        keep = x["label"].isin(*types) & (F.length(F.trim(x["value"])) > 0)
        return F.struct(F.concat(acc["out"], x["p"], x["value"]).alias("out"),
                        F.when(keep, F.concat(acc["spans"], F.array(span(start, start + F.length(x["value"]), x["label"])))).otherwise(acc["spans"]).alias("spans"))

    end = F.aggregate(items, zero, step)
    return F.concat(end["out"], _last(parts)), end["spans"]


def fill_spans(template: Column | str, values: Column | str) -> Column:
    """Template with {SLOT} parts and a map SLOT -> struct(value, label) -> struct(text, spans); NULL labels leave no span."""
    t, m = _c(template), _c(values)
    parts = F.filter(F.split(t, r"(?=\{[A-Za-z_]+\})|(?<=\})"), lambda p: p != "")
    zero = F.struct(F.lit("").alias("text"), _empty().alias("spans"))

    def step(acc, p):
        slot = F.try_element_at(m, F.regexp_extract(p, r"^\{([A-Za-z_]+)\}$", 1))
        value = F.coalesce(slot["value"], p)
        n = F.length(acc["text"])
        return F.struct(F.concat(acc["text"], value).alias("text"),
                        F.when(slot["label"].isNotNull(), F.concat(acc["spans"], F.array(span(n, n + F.length(value), slot["label"])))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, zero, step)


# ---- check digits -----------------------------------------------------------------------------------------------------

def _luhn_sum(digits: Column, double_first: bool) -> Column:
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.struct(x.cast("int").alias("d"), i.alias("i")))
    odd = 0 if double_first else 1
    return F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x["i"] % 2 == odd, F.when(x["d"] * 2 > 9, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]))


def luhn_ok(c: Column | str) -> Column:
    digits = F.regexp_replace(_c(c), r"[^0-9]", "")
    return (F.length(digits) > 1) & (_luhn_sum(digits, False) % 10 == 0)


def luhn_complete(prefix: Column | str) -> Column:
    """The digits with their check digit appended."""
    p = _c(prefix)
    return F.concat(p, ((10 - _luhn_sum(p, True) % 10) % 10).cast("string"))


# Length of the part after the check digits, per country.
IBAN_LENGTH = {"DE": 18, "ES": 20, "FR": 23, "IT": 23, "NL": 14, "GB": 18, "PL": 24, "BE": 12, "AT": 16, "CH": 17, "PT": 21, "SE": 20}


def _mod97(c: Column) -> Column:
    """Characters as numbers 0..35 appended digit by digit, modulo 97."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda acc, x: F.when(
        x.rlike("^[0-9]$"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97))


def iban_ok(c: Column | str) -> Column:
    s = F.upper(F.regexp_replace(_c(c), r"\s+", ""))
    m = F.create_map(*[F.lit(x) for kv in IBAN_LENGTH.items() for x in kv])
    size = F.try_element_at(m, F.substring(s, 1, 2))
    shape = s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(s) - 4 == size)
    return F.coalesce(shape & (_mod97(F.concat(s.substr(F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1), F.lit(False))


def iban_complete(country: Column, bban: Column) -> Column:
    check = 98 - _mod97(F.concat(bban, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), bban)


# ---- token tags -------------------------------------------------------------------------------------------------------

def bio_to_spans(tags: Column | str, starts: Column | None = None, ends: Column | None = None) -> Column:
    """BIO tags to spans over token numbers, or over character offsets when token starts and ends are given.

    An I- without B- opens a span and a change of type closes one. Starts and ends of the runs are found separately
    and zipped, so the cost is linear in the tokens."""
    t = _c(tags)
    n = F.size(t)
    typ = lambda x: F.regexp_replace(x, "^[BI]-", "")
    pos = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    opens = lambda i: (F.get(t, i) != "O") & (F.get(t, i).startswith("B-") | (i == 0) | (F.coalesce(F.get(t, i - 1), F.lit("O")) == "O")
                                                | (typ(F.coalesce(F.get(t, i - 1), F.lit("O"))) != typ(F.get(t, i))))
    closes = lambda i: (F.get(t, i) != "O") & ((i == n - 1) | (F.coalesce(F.get(t, i + 1), F.lit("O")) == "O")
                                                 | F.coalesce(F.get(t, i + 1), F.lit("O")).startswith("B-") | (typ(F.coalesce(F.get(t, i + 1), F.lit("O"))) != typ(F.get(t, i))))
    a, b = F.filter(pos, opens), F.filter(pos, closes)
    s = (lambda i: i) if starts is None else (lambda i: F.get(starts, i))
    e = (lambda i: i + 1) if ends is None else (lambda i: F.get(ends, i))
    return F.zip_with(a, b, lambda x, y: span(s(x), e(y), typ(F.get(t, x))))


def spans_to_bio(spans: Column | str, units: Column | str) -> Column:
    """BIO tag per unit: label of the first span that overlaps it; B- on the first unit of a span."""
    sp, us = F.array_sort(_c(spans)), _c(units)
    hit = lambda x: F.get(F.filter(sp, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), F.lit(0))
    hits = F.transform(us, hit)
    prev = F.concat(F.array(F.lit(None).cast("struct<start:int,end:int,label:string>")), hits)
    return F.zip_with(hits, F.slice(prev, 1, F.size(hits)), lambda h, p: F.when(h.isNull(), "O").otherwise(
        F.concat(F.when(p.isNotNull() & (p["start"] == h["start"]) & (p["end"] == h["end"]), "I-").otherwise("B-"), h["label"])))


def detokenize(tokens: Column | str, lang: Column | str | None = None) -> Column:
    """Tokens to struct(text, units): joined by blanks, or by nothing for languages written without spaces."""
    t = _c(tokens)
    glued = F.lit(False) if lang is None else F.coalesce(_c(lang).isin(*NO_SPACE_LANGS), F.lit(False))
    text = F.when(glued, F.array_join(t, "")).otherwise(F.array_join(t, " "))
    return F.struct(text.alias("text"), offsets_of(t, F.when(glued, 0).otherwise(1)).alias("units"))


# ---- span metrics -----------------------------------------------------------------------------------------------------

def explode_spans(df: DataFrame, doc: str, spans: str) -> DataFrame:
    return explode_rows(df, [doc], spans, "s").select(doc, "s.start", "s.end", "s.label")


def entity_f1(gold: DataFrame, pred: DataFrame, doc: str, per_label: bool = False) -> DataFrame:
    """Exact-match precision, recall and F1 over (document, start, end, label).

    Both sides are tagged and counted by key in one aggregation instead of a full outer join."""
    key = [doc, "start", "end", "label"]
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    m = both.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    by = ["label"] if per_label else []
    c = m.groupBy(*by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def disjoint(spans: Column | str, n: Column) -> Column:
    """Sorted, non-overlapping cover of the spans clipped to [0, n)."""
    clipped = F.filter(F.transform(_c(spans), lambda x: span(F.greatest(x["start"], F.lit(0)), F.least(x["end"], n), F.lit(""))), lambda x: x["end"] > x["start"])
    return merge_overlaps(clipped)


def solid_chars(text: Column, spans: Column) -> Column:
    """Non-space characters covered by disjoint spans."""
    return F.aggregate(spans, F.lit(0), lambda acc, x: acc + F.length(F.regexp_replace(cut(text, x["start"], x["end"]), rf"{WS}+", "")))


def intersect(a: Column, b: Column) -> Column:
    """Pieces common to two disjoint covers."""
    return F.flatten(F.transform(a, lambda x: F.transform(
        F.filter(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])),
        lambda y: span(F.greatest(x["start"], y["start"]), F.least(x["end"], y["end"]), F.lit("")))))


def redaction_counts(df: DataFrame, text: str, must: str, may: str, pred: str) -> DataFrame:
    """Per row: characters found / wanted / right / predicted and entities covered / wanted; white space does not count."""
    t = F.col(text)
    n = F.length(t)
    df = (df.withColumn("_gm", disjoint(must, n)).withColumn("_ga", disjoint(F.concat(F.col(must), F.col(may)), n)).withColumn("_pm", disjoint(pred, n)))
    covered = F.filter(F.col(must), lambda x: solid_chars(t, intersect(F.array(x), F.col("_pm"))) >= 0.9 * F.greatest(
        solid_chars(t, F.array(x)), F.lit(1)))
    return (df.withColumn("hit", solid_chars(t, intersect(F.col("_gm"), F.col("_pm")))).withColumn("want", solid_chars(t, F.col("_gm")))
            .withColumn("right", solid_chars(t, intersect(F.col("_pm"), F.col("_ga")))).withColumn("pred_chars", solid_chars(t, F.col("_pm")))
            .withColumn("covered", F.size(covered)).withColumn("entities", F.size(must)).drop("_gm", "_ga", "_pm"))


def redaction_metrics(df: DataFrame, text: str, must: str, may: str, pred: str, by: list[str] | None = None) -> DataFrame:
    c = redaction_counts(df, text, must, may, pred).groupBy(*(by or [])).agg(*[F.sum(x).alias(x) for x in ("hit", "want", "right", "pred_chars", "covered", "entities")])
    one = F.lit(1)
    r = F.col("hit") / F.greatest(F.col("want"), one)
    p = F.col("right") / F.greatest(F.col("pred_chars"), one)
    return c.select(*(by or []), r.alias("redact_recall"), p.alias("redact_precision"), (F.col("covered") / F.greatest(F.col("entities"), one)).alias("entity_recall"),
                    (2 * r * p / F.greatest(r + p, F.lit(1e-9))).alias("redact_f1"))
