"""Punctuation and casing labels: units, windows, restoring, rule casing, boundary decoding.

A unit is struct<word STRING, lab STRING>; `lab` is the mark that follows the word, '0' for none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.keys import _c, h32, u
from ..functions.text import lower_keep_len
from ..functions.units import Points, cut, explode_rows, gathered, offsets_of, pin, slices, strings, text_bytes

# Label set and the marks of the world's scripts that count as each label.
LABELS = ["0", ".", ",", "?", "-", ":"]
STOPS = ".!;…。！．।॥۔።။։；؛｡"
COMMAS = ",，、،፣､"
QUESTIONS = "?？؟፧"
COLONS = ":："
DROPPED = "¿¡"
CHAR_LANGS = ("zh", "ja")
QUOTES = "\"'«»„“”‘’()[]{}*"
CASES = ["lower", "Cap", "UPPER"]


def _cls(chars: str) -> str:
    return "".join("\\" + c if c in "\\[]^-.?*{}()" else c for c in chars)


_OTHER = _cls((STOPS + COMMAS + QUESTIONS + COLONS).replace(".", "").replace(",", "").replace(":", ""))
MARK = rf"(?:[{_OTHER}]|(?<!\p{{Nd}})[.,:]|[.,:](?!\p{{Nd}}))"  # marks between digits are text


# What the rules for marks ask of a character, as bits.
_ALNUM, _DIGIT, _LOWER, _BLANK, _ASCII_BLANK, _GONE, _POINT, _QUESTION, _STOP, _COLON, _COMMA, _SEMICOLON, _QUOTE, _CLOSER, _DASH, _KNOWN = (1 << i for i in range(16))
_BITS = np.zeros(0x110000, dtype="uint16")  # filled as characters occur
# White space of Unicode, as (?U)\s has it.
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_STRENGTH = [0, 3, 1, 4, 1, 2]  # of LABELS: question, stop, colon, then comma and dash


def _bits_of(code: int) -> int:
    c, kind = chr(code), unicodedata.category(chr(code))
    has = {_ALNUM: kind[0] in "LN", _DIGIT: kind == "Nd", _LOWER: kind == "Ll", _BLANK: code in _WHITE, _ASCII_BLANK: c in "\t\n\x0b\f\r ",
           _GONE: c in STOPS + COMMAS + QUESTIONS + COLONS + DROPPED and c not in ".,:", _POINT: c in ".,:", _QUESTION: c in QUESTIONS, _STOP: c in STOPS,
           _COLON: c in COLONS, _COMMA: c in COMMAS, _SEMICOLON: c == ";", _QUOTE: c in QUOTES, _CLOSER: c in "\"'»”’)]", _DASH: c in "–—", _KNOWN: True}
    return sum(bit for bit, holds in has.items() if holds)


def _bits(codes: np.ndarray) -> np.ndarray:
    found = _BITS[codes]
    if not found.all():
        new = np.unique(codes[found == 0])
        _BITS[new] = [_bits_of(c) for c in new.tolist()]
        found = _BITS[codes]
    return found


def _gone(bits: np.ndarray) -> np.ndarray:
    """Marks, and what is dropped; marks between digits are text."""
    digit = (bits & _DIGIT) > 0
    inside = np.concatenate([[False], digit[:-1]]) & np.concatenate([digit[1:], [False]])
    return ((bits & _GONE) > 0) | (((bits & _POINT) > 0) & ~inside)


def _run_bits(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits that occur in each of the runs bits[start:end], which ascend and end before the last character."""
    return np.where(start < end, np.bitwise_or.reduceat(bits, np.stack([start, end], 1).ravel())[::2], 0)


def _strongest(bits: np.ndarray, greek: np.ndarray | bool = False) -> np.ndarray:
    """Label of the strongest mark in a run: question, stop, colon, then comma. The Greek question mark looks like a semicolon."""
    question = ((bits & _QUESTION) > 0) | (greek & ((bits & _SEMICOLON) > 0))
    return np.select([question, (bits & _STOP) > 0, (bits & _COLON) > 0, (bits & _COMMA) > 0], [LABELS.index(x) for x in "?.:,"], 0)


def _spaced_units(p: Points, greek: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units between white space: code points of the words, their sizes, labels and rows."""
    codes, bits = p.codes, _bits(p.codes)
    solid, place = (bits & _BLANK) == 0, np.arange(len(bits))
    start = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    if not len(start):
        return codes[:0], start, start, start
    left = solid & ~_gone(bits)
    before = np.concatenate([[0], np.cumsum(left)])
    size = before[end] - before[start]
    strange = np.concatenate([[0], np.cumsum(left & ((bits & _QUOTE) == 0))])
    last = np.maximum.reduceat(np.where((bits & _ALNUM) > 0, place, -1), start)
    row = np.searchsorted(p.at, start, "right") - 1
    lab = _strongest(_run_bits(bits, np.maximum(start, last + 1), end), greek[row])
    closed = np.maximum.reduceat(np.where(solid & ((bits & _CLOSER) == 0), place, -1), start)
    dot = (lab == LABELS.index(".")) & (closed >= start) & (codes[closed] == ord("."))
    hyphen = codes[start] == ord("-")
    dash = ((end - start == 1) & (hyphen | ((bits[start] & _DASH) > 0))) | ((end - start == 2) & hyphen & (codes[end - 1] == ord("-")))
    quote = (last < start) & (strange[end] == strange[start])
    word = ~dash & (size > 0) & ~quote

    kept = np.flatnonzero(~dash & (size > 0))
    stop = np.searchsorted(start, p.at)[row[kept] + 1]  # behind the last item of the row
    after = np.minimum(np.concatenate([kept[1:], [len(start)]]), stop)
    out = lab[kept]
    # free marks and dashes up to and including the next kept item
    for k in np.flatnonzero((kept + 1 < stop) & ~word[np.minimum(kept + 1, len(start) - 1)]).tolist():
        own = int(out[k])
        for i in range(int(kept[k]) + 1, min(int(after[k]) + 1, int(stop[k]))):
            if dash[i]:
                own = own or LABELS.index("-")
            elif not word[i] and _STRENGTH[lab[i]] > _STRENGTH[own]:
                own = int(lab[i])
        out[k] = own
    follows = np.flatnonzero(after < stop)
    first = np.flatnonzero(left)[before[start[after[follows]]]]
    out[follows[dot[kept[follows]] & ((bits[first] & _LOWER) > 0)]] = 0  # an abbreviation
    return gathered(codes[left], before[start[kept]], size[kept]), size[kept], out, row[kept]


def _glued_units(p: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of one character, with the marks, dashes and blanks behind each."""
    codes, bits = p.codes, _bits(p.codes)
    at = np.flatnonzero(~_gone(bits) & ((bits & (_ASCII_BLANK | _DASH)) == 0))
    if not len(at):
        return codes[:0], at, at, at
    row = np.searchsorted(p.at, at, "right") - 1
    end = np.minimum(np.concatenate([at[1:], [len(codes)]]), p.at[row + 1] - 1)
    lab = _strongest(_run_bits(bits, at + 1, end))
    weak = np.concatenate([np.flatnonzero((bits & (_COMMA | _DASH)) > 0), [len(codes)]])
    near = weak[np.searchsorted(weak, at + 1)]  # the first comma or dash
    dash = (near < end) & ((bits[np.minimum(near, len(codes) - 1)] & _DASH) > 0) & ~np.isin(codes[at], (0x85, 0x2028, 0x2029))
    lab[dash & np.isin(lab, (0, LABELS.index(",")))] = LABELS.index("-")
    return codes[at], np.ones(len(at), dtype="int64"), lab, row


def _units_array(texts: pa.Array, found: tuple, spaced: bool) -> pa.Array:
    codes, size, lab, row = found
    n = np.bincount(row, minlength=len(texts)).astype("int64")
    units = pa.StructArray.from_arrays([strings(codes, size), pa.array(LABELS).take(pa.array(lab))], ["word", "lab"])
    if spaced and not n.all():  # a text without words has one unit of nulls
        own = np.maximum(n, 1)
        empty = np.repeat(n == 0, own)
        take = pa.array(np.cumsum(~empty) - 1, mask=empty)
        units, n = pa.StructArray.from_arrays([units.field(k).take(take) for k in range(2)], ["word", "lab"]), own
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(ends, units, mask=None if spaced else pc.is_null(texts))


def _units_of(texts: pa.Array, kinds: np.ndarray) -> pa.Array:
    """Units of a slice of texts; kind 1 has one unit per character, kind 2 is Greek."""
    glued = kinds == 1
    if not glued.any():
        return _units_array(texts, _spaced_units(Points(texts), kinds == 2), True)
    own, other = texts.filter(pa.array(glued)), texts.filter(pa.array(~glued))
    parts = [_units_array(own, _glued_units(Points(own)), False), _units_array(other, _spaced_units(Points(other), kinds[~glued] == 2), True)]
    place = np.empty(len(texts), dtype="int64")
    place[np.concatenate([np.flatnonzero(glued), np.flatnonzero(~glued)])] = np.arange(len(texts))
    return pa.concat_arrays(parts).take(pa.array(place))


@F.arrow_udf(ArrayType(StructType([StructField("word", StringType()), StructField("lab", StringType())])))
def _punct(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, flags in batches:
        for texts, kinds in slices(text_bytes(column), column, flags):
            yield _units_of(texts, kinds.to_numpy(zero_copy_only=False))


def punct_units(df: DataFrame, text: str, lang: str | None = None, name: str = "units") -> DataFrame:
    """Column `units`: words without their marks, each with the label of the mark that follows.

    Every word is labelled on its own, then takes over marks and dashes that stand free before the next word; a full
    stop before a lower-case word is an abbreviation. Languages written without spaces have one unit per character.
    An Arrow function over slices of a batch: as array expressions, ten patterns would be interpreted for every marked word."""
    code = F.col(lang) if lang else F.lit("")
    kind = F.when(code.isin(*CHAR_LANGS), 1).when(code == "el", 2).otherwise(0)
    return pin(df, name, _punct(F.col(text), kind))


def deal_units(df: DataFrame, units: str, by: list[str]) -> DataFrame:
    """Rows dealt by columns, so that windows over them need no exchange of exploded units. `units` as punct_units makes them: their
    words hold no blank and their labels are one character, so they move as two strings, which take a third of the structs' room."""
    x, rest = F.col(units), [c for c in df.columns if c != units]
    n = F.when(x.isNotNull(), F.size(x))
    d = df.select(*rest, n.alias("_n"), F.array_join(x.getField("word"), " ").alias("_w"), F.array_join(x.getField("lab"), "").alias("_l")).repartition(*by)
    unit = lambda w, l: F.struct(w.alias("word"), l.alias("lab"))
    none = F.array(unit(F.lit(None).cast("string"), F.lit(None).cast("string")))  # of a text without words
    pairs = F.zip_with(F.split("_w", " "), F.slice(F.split("_l", ""), F.lit(1), F.greatest("_n", F.lit(0))), unit)
    return d.select(*rest, F.when(F.col("_n").isNull(), None).when(F.col("_w") == "", F.slice(none, F.lit(1), F.col("_n"))).otherwise(pairs).alias(units))


def units_text(units: Column | str, lang: Column | str | None = None) -> Column:
    """Clean text of units and the end offset of each: struct(text, ends)."""
    words = _c(units).getField("word")
    glued = F.lit(False) if lang is None else F.coalesce(_c(lang).isin(*CHAR_LANGS), F.lit(False))
    text = F.when(glued, F.array_join(words, "")).otherwise(F.array_join(words, " "))
    ends = offsets_of(words, F.when(glued, 0).otherwise(1)).getField("end")
    return F.struct(text.alias("text"), ends.alias("ends"))


def unit_windows(df: DataFrame, key: str, units: str, lang: str | None = None, cap: int = 230, cap_char: int = 400,
                 min_units: int = 4, cut_share: float = 0.3, seed=0) -> DataFrame:
    """Windows of at most `cap` units; a share of them is cut at a hashed unit (8 or later). Adds window, text, ends, labs."""
    size = F.when(F.col(lang).isin(*CHAR_LANGS), cap_char).otherwise(cap) if lang else F.lit(cap)
    n = F.size(units)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size), F.lit(1)).cast("int") - 1), lambda i: F.slice(units, i * size + 1, size))
    keep = [c for c in df.columns if c != units]
    w = explode_rows(df, keep, parts, "win", "window")
    m = F.size("win")
    at = 8 + F.pmod(h32(f"{seed}.c", key, "window"), F.greatest(m - 8, F.lit(1)).cast("bigint"))
    short = (u(f"{seed}.u", key, "window") < cut_share) & (m > 12)
    w = pin(w, "win", F.slice("win", F.lit(1), F.when(short, at.cast("int")).otherwise(m))).where(F.size("win") >= min_units)
    w = w.withColumn("_t", units_text("win", lang))
    return w.select(*keep, "window", F.col("_t.text").alias("text_w"), F.col("_t.ends").alias("ends"), F.col("win.lab").alias("labs"))


# Marks per script, chosen by the character before the mark.
SCRIPT_MARKS = [
    (r"[぀-ヿ㐀-鿿豈-﫿]", {".": "。", ",": "，", "?": "？", ":": "：", "-": "——"}),
    (r"[ऀ-৿]", {".": "।"}),
    (r"[؀-ۿݐ-ݿ]", {",": "،", "?": "؟"}),
    (r"[Ͱ-Ͽἀ-῿]", {"?": ";"}),
    (r"[ሀ-፿]", {".": "።", ",": "፣"}),
]


def restore(units: Column | str, lang: Column | str | None = None, scripts: bool = False) -> Column:
    """Text with its marks from units; with `scripts` the mark follows the script of the word."""
    def mark(x):
        out = F.when(x["lab"] == "0", "").when(x["lab"] == "-", " -").otherwise(x["lab"])
        if scripts:
            last = F.substring(x["word"], -1, 1)
            for rx, marks in reversed(SCRIPT_MARKS):
                for lab, m in marks.items():
                    out = F.when(last.rlike(rx) & (x["lab"] == lab), m).otherwise(out)
        return F.concat(x["word"], out)

    glued = F.lit(False) if lang is None else F.coalesce(_c(lang).isin(*CHAR_LANGS), F.lit(False))
    words = F.transform(_c(units), mark)
    return F.when(glued, F.array_join(words, "")).otherwise(F.array_join(words, " "))


def strip_marks_text(c: Column | str) -> Column:
    """Marks removed except between digits."""
    return F.regexp_replace(_c(c), rf"{MARK}|[{DROPPED}]", "")


def case_of(word: Column | str) -> Column:
    """0 lower, 1 first cased letter upper, 2 all of at least two cased letters upper."""
    cased = F.regexp_replace(_c(word), r"[^\p{Lu}\p{Ll}\p{Lt}]", "")
    return F.when((F.length(cased) >= 2) & cased.rlike(r"^\p{Lu}+$"), 2).when(cased.rlike(r"^\p{Lu}"), 1).otherwise(0)


def apply_case(word: Column | str, k: Column | int) -> Column:
    w, k = _c(word), k if isinstance(k, Column) else F.lit(k)
    head = F.regexp_extract(w, r"^([^\p{Lu}\p{Ll}\p{Lt}]*)", 1)
    n = F.length(head)
    return F.when(k == 2, F.upper(w)).when(k == 1, F.concat(head, F.upper(cut(w, n, n + 1)), cut(w, n + 1))).otherwise(w)


def rule_case(df: DataFrame, doc: str, pos: str, word: str, lab: str, lang: str | None = None, name: str = "case") -> DataFrame:
    """Rule casing of unit rows: capital at the start, after . and ?, and English "i"; units without letters pass the state on."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    cased = F.col(word).rlike(r"[\p{Lu}\p{Ll}\p{Lt}]")
    stop = F.col(lab).isin(".", "?")
    cap = F.coalesce(F.last(F.when(cased | stop, stop), ignorenulls=True).over(w), F.lit(True))
    i = (F.col(lang) == "en") & (F.col(word) == "i") if lang else F.lit(False)
    return df.withColumn(name, ((cap & cased) | i).cast("int"))


def unit_rows(df: DataFrame, doc: str, units: str) -> DataFrame:
    return explode_rows(df, [doc], units, "x").select(doc, "pos", "x.word", "x.lab")


def decode_boundary(df: DataFrame, doc: str, pos: str, marks: str, cases: str, beta: float) -> DataFrame:
    """Make comma + capital boundaries consistent: keep (damped by beta), turn into a sentence break, or lower-case.

    marks: map label -> probability of the unit, cases: probabilities of lower/Cap/UPPER. A decision touches the mark of
    one unit and the case of the next, and only reads values no other decision changes, so neighbours suffice."""
    arg = lambda arr: F.array_position(arr, F.array_max(arr)) - 1
    # the window moves a unit's few numbers; its map and array are only moved where the caller goes on with them
    d = df.withColumn("_m", F.array(*[F.element_at(F.col(marks), l) for l in LABELS])).withColumn("_c", F.col(cases))
    m = lambda l: F.col("_m")[LABELS.index(l)]
    d = d.select(*df.columns, F.element_at(F.array(*[F.lit(l) for l in LABELS]), (arg(F.col("_m")) + 1).cast("int")).alias("pm"), arg(F.col("_c")).cast("int").alias("pc"), m(",").alias("_mc"),
                 F.greatest(m("."), m("?")).alias("_ms"), F.when(m(".") >= m("?"), ".").otherwise("?").alias("_stop"), F.col("_c")[0].alias("_c0"), F.col("_c")[1].alias("_c1"))
    w = Window.partitionBy(doc).orderBy(pos)
    n0, n1, np_ = F.lead("_c0").over(w), F.lead("_c1").over(w), F.lead("pc").over(w)
    z, x, y = F.col("_mc") * n1 * beta, F.col("_ms") * n1, F.col("_mc") * n0
    hit = (F.col("pm") == ",") & (np_ == 1)
    d = d.withColumn("_to", F.when(hit & (x >= z) & (x >= y), "break").when(hit & (y > z), "lower")).drop("_mc", "_ms", "_c0", "_c1")
    return (d.withColumn("_prev", F.lag("_to").over(w)).withColumn("pm", F.when(F.col("_to") == "break", F.col("_stop")).otherwise(F.col("pm")))
            .withColumn("pc", F.when(F.col("_prev") == "lower", 0).otherwise(F.col("pc"))).drop("_to", "_stop", "_prev"))


def boundary_events(df: DataFrame, doc: str, pos: str, pm: str, pc: str, gm: str, gc: str, by: list[str] | None = None) -> DataFrame:
    """Predicted comma + capital boundaries by what gold has there."""
    w = Window.partitionBy(doc).orderBy(pos)
    x = df.withColumn("_npc", F.lead(pc).over(w)).withColumn("_ngc", F.lead(gc).over(w))
    hit = (F.col(pm) == ",") & (F.col("_npc") == 1)
    kind = F.when(F.col(gm).isin(".", "?") & (F.col("_ngc") == 1), "gold_sentence_break").when(F.col("_ngc") == 1, "gold_comma_cap").when(
        F.col("_ngc") == 0, "gold_lower").otherwise("other")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return x.withColumn("_k", F.when(hit, kind)).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("words"), n(F.col("_k").isNotNull()).alias("total"),
        *[F.count(F.when(F.col("_k") == k, 1)).alias(k) for k in ("gold_sentence_break", "gold_comma_cap", "gold_lower", "other")])


def lowercase_share(df: DataFrame, text: str, f: float, seed, key: str) -> DataFrame:
    return df.withColumn(text, F.when(u(seed, key) < f, lower_keep_len(text)).otherwise(F.col(text)))
