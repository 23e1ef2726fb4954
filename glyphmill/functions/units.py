"""Units of text (sentence windows, words, characters) with character offsets, as array expressions."""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .keys import NO_SPACE_LANGS, WS, _c, h32, sentences, strip

UNIT = "array<struct<start:int,end:int>>"


def explode_rows(df: DataFrame, cols: list, arr: Column | str, name: str, pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """One row per array element with its position.

    The outer form plus a test on the position: with the inner form the optimizer adds a filter on the array below the
    projection, which computes the whole array expression a second time.

    by: columns to deal the rows by before they are exploded. Windows over these columns then need no exchange of their own, so a text
    or an array moves once instead of a row, many times as large, for each of its elements."""
    if by:
        df = df.repartition(*by)
    out = df.select(*cols, F.posexplode_outer(_c(arr)).alias(pos, name))
    return out.where(F.col(pos).isNotNull())


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-element generator: later filters test the computed value, where the optimizer
    would otherwise copy the expression into every predicate and compute it again."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def rfind(s: Column, ch: str) -> Column:
    """0-based position of the last occurrence, -1 when absent."""
    r = F.instr(F.reverse(s), ch)
    return F.when(r == 0, F.lit(-1)).otherwise(F.length(s) - r)


def cut(s: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """Python slice s[start:end] with non-negative bounds."""
    a = start if isinstance(start, Column) else F.lit(start)
    if end is None:
        return s.substr(a + 1, F.length(s))
    b = end if isinstance(end, Column) else F.lit(end)
    return s.substr(a + 1, F.greatest(b - a, F.lit(0)))


@F.arrow_udf(ArrayType(IntegerType()))
def running_sum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sums of the elements up to and including each one (a null element counts as 0)."""
    for lists in batches:
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = np.cumsum(np.concatenate([[0], pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)]), dtype="int64")
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = flat[1:] - np.repeat(flat[ends[:-1]], n)
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums, pa.int32()), mask=pc.is_null(lists))


def offsets_of(parts: Column, gap: Column | int = 0) -> Column:
    """Start and end of each array element when the elements are laid out with `gap` characters in between."""
    g = (gap if isinstance(gap, Column) else F.lit(gap)).cast("int")
    return _laid_out(F.transform(parts, lambda x: F.length(x)), g)


def match_spans(text: Column | str, rx: str) -> Column:
    """Start and end of every match, in code points.

    The text is split by the pattern and the matches are extracted in the same order; running lengths give offsets
    that count code points like Python (Java's own match positions count UTF-16 units). Texts without a match, the
    usual case, cost one search."""
    t = _c(text)
    pairs = F.zip_with(F.split(t, rx), F.regexp_extract_all(t, F.lit(f"({rx})"), F.lit(1)),
                       lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("len")))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(UNIT).alias("out"))

    def step(acc, x):  # the piece after the last match has no length
        start = acc["pos"] + x["skip"]
        one = F.array(F.struct(start.cast("int").alias("start"), (start + x["len"]).cast("int").alias("end")))
        return F.struct((start + F.coalesce(x["len"], F.lit(0))).cast("int").alias("pos"),
                        F.when(x["len"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.when(t.rlike(rx), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(UNIT))


def literal_spans(text: Column, needle: Column) -> Column:
    """Start and end of every non-overlapping occurrence of a string."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    n = F.length(needle)
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(UNIT).alias("out"))
    return F.when(n == 0, F.array().cast(UNIT)).otherwise(F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), zero,
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p) + n).cast("int").alias("pos"),
            F.concat(acc["out"], F.array(F.struct((acc["pos"] + F.length(p)).cast("int").alias("start"),
                                                  (acc["pos"] + F.length(p) + n).cast("int").alias("end")))).alias("out")),
        lambda acc: acc["out"]))


# ---- Arrow functions over texts: slices of a batch as code points -------------------------------------------------------

#: Own choice: bytes that an Arrow function turns into Python or NumPy values at once; a larger row is a slice of its own.
SLICE = 1 << 19


def slices(sizes: np.ndarray, *columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Consecutive rows of a batch in slices of about SLICE bytes, so that memory doesn't follow the rows of a batch."""
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield tuple(c.slice(a, b - a) for c in columns)


def text_bytes(texts: pa.Array) -> np.ndarray:
    """Size of each text, and a little for the row itself."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64") + 16


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_KIND = np.full(0x110000, -1, dtype="int8")  # 1 letters, 2 numbers, 0 others; filled as characters occur


def is_space(codes: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(codes, 0x3001)]


def _kinds(codes: np.ndarray) -> np.ndarray:
    found = _KIND[codes]
    if (found < 0).any():
        new = np.unique(codes[found < 0])
        _KIND[new] = [{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in new.tolist()]
        found = _KIND[codes]
    return found


def is_alnum(codes: np.ndarray) -> np.ndarray:
    """Letters and numbers."""
    return _kinds(codes) > 0


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _kinds(codes) == 1


class Points:
    """Code points of a slice of texts, a line feed behind each; `at` has the place of every text and the end."""

    def __init__(self, texts: pa.Array):
        own = [t or "" for t in texts.to_pylist()]
        self.n = np.array([len(t) for t in own], dtype="int64")
        self.at = np.concatenate([[0], np.cumsum(self.n + 1)])
        self.codes = np.frombuffer(("\n".join(own) + "\n" * bool(own)).encode("utf-32-le"), "<u4")

    def places(self, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, given start, and the start and size of what `cut` takes, of every span of the lists (nulls count as empty)."""
        flat = spans.flatten()
        start, end = (pc.fill_null(flat.field(k), 0).to_numpy(zero_copy_only=False).astype("int64") for k in ("start", "end"))
        row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
        n = self.n[row]
        a = np.where(start >= 0, start, np.where(start == -1, 0, n + start + 1))  # substring counts negative places from the end
        b = np.clip(a + np.maximum(end - start, 0), 0, n)
        a = np.clip(a, 0, n)
        return row, start, self.at[row] + a, np.maximum(b - a, 0)


def gathered(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces codes[start:start + size] one behind the other."""
    ends = np.cumsum(size)
    return codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def strings(codes: np.ndarray, size: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings of the given numbers of code points, one behind the other."""
    width = 1 + (codes >= 0x80).astype("int64") + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])].astype("int32")
    data = codes.tobytes().decode("utf-32-le").encode()
    out = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
    return out if null is None or not null.any() else pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)


def lists(flat: pa.Array, like: pa.Array) -> pa.Array:
    """The elements as lists of the lengths (and the nulls) of other lists."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pc.is_null(like))


def _found(texts: pa.Array, single: pa.Array) -> tuple[Points, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all units among the code points of a slice, the place of each text's first unit, and its first place."""
    p = Points(texts)
    solid = ~is_space(p.codes)
    alone = np.repeat(single.to_numpy(zero_copy_only=False).astype(bool), p.n + 1)
    start = np.flatnonzero(solid & (alone | ~np.concatenate([[False], solid[:-1]])))
    end = np.flatnonzero(solid & (alone | ~np.concatenate([solid[1:], [False]]))) + 1
    ends = np.searchsorted(start, p.at)
    return p, start, end, ends, np.repeat(p.at[:-1], np.diff(ends))


_PLACE = [StructField("start", IntegerType()), StructField("end", IntegerType())]


@F.arrow_udf(ArrayType(StructType(_PLACE)))
def _unit_offsets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, flags in batches:
        for texts, single in slices(text_bytes(column), column, flags):
            _, start, end, ends, base = _found(texts, single)
            units = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32())], ["start", "end"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units)


@F.arrow_udf(ArrayType(StructType([*_PLACE, StructField("word", StringType())])))
def _unit_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, flags in batches:
        for texts, single in slices(text_bytes(column), column, flags):
            p, start, end, ends, base = _found(texts, single)
            words = strings(gathered(p.codes, start, end - start), end - start)
            units = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32()), words], ["start", "end", "word"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units)


@F.arrow_udf(ArrayType(StructType(_PLACE)))
def _laid_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Places of elements of the given sizes; a null has an end but no start and takes no room."""
    for column, gaps in batches:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        for own, gap in slices(sizes.astype("int64") * 16 + 16, column, gaps):
            flat = own.flatten()
            null, n = np.array(pc.is_null(flat), dtype=bool), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
            size, g = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype("int64"), np.repeat(gap.to_numpy(zero_copy_only=False), n)
            sums = np.concatenate([[0], np.cumsum(np.where(null, 0, size + g))])
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            end = sums[1:] - np.repeat(sums[first], n) - g
            yield lists(pa.StructArray.from_arrays([pa.array(end - size, pa.int32(), mask=null), pa.array(end, pa.int32())], ["start", "end"]), own)


def _single(lang: Column | str | None, nospace: tuple) -> Column:
    return F.lit(False) if lang is None else F.coalesce(_c(lang).isin(*nospace), F.lit(False))


def word_units(text: Column | str, lang: Column | str | None = None, nospace: tuple = NO_SPACE_LANGS) -> Column:
    """Spans of white-space words, or of single non-space characters for languages written without spaces.

    Running offsets over all words of a long text would be quadratic with array expressions, so this is an Arrow function
    over slices of a batch; the spans themselves are handled in the JVM."""
    return _unit_offsets(_c(text), _single(lang, nospace))


def word_unit_texts(text: Column | str, lang: Column | str | None = None, nospace: tuple = NO_SPACE_LANGS) -> Column:
    """The spans of `word_units` with what they cover: struct(start, end, word)."""
    return _unit_words(_c(text), _single(lang, nospace))


@F.arrow_udf(ArrayType(StringType()))
def _unit_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for column, spans in batches:
        for texts, own in slices(text_bytes(column), column, spans):
            p = Points(texts)
            row, _, start, size = p.places(own)
            flat = own.flatten()
            lost = np.array(pc.is_null(texts))[row] | np.array(pc.is_null(flat.field("start"))) | np.array(pc.is_null(flat.field("end")))
            yield lists(strings(gathered(p.codes, start, size), size, lost), own)


def unit_texts(text: Column | str, units: Column | str) -> Column:
    """What the units cover. A substring of a long text is found by counting from its beginning, once per unit; here the text
    is read once."""
    return _unit_texts(_c(text), F.transform(_c(units), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))))


# ---- spans of a document cut at hashed places -------------------------------------------------------------------------

def sentence_window(text: Column | str, key: Column | str, seed, kmin: int, kmax: int, min_sent: int = 15,
                    max_chars: int | None = None) -> Column:
    """kmin..kmax consecutive sentences from a hashed start, joined by blanks; NULL without sentences."""
    s = sentences(text, min_sent)
    i = F.pmod(h32(f"{seed}.i", key), F.size(s).cast("bigint"))
    k = F.pmod(h32(f"{seed}.k", key), F.lit(kmax - kmin + 1)) + kmin
    t = F.array_join(F.slice(s, (i + 1).cast("int"), k.cast("int")), " ")
    if max_chars:
        t = F.substring(t, 1, max_chars)
    return F.when(F.size(s) > 0, t)


def short_span(s: Column | str, key: Column | str, seed, lo: int, hi: int, floor: int = 5) -> Column:
    """lo..hi characters from a hashed place, trimmed to word boundaries; shorter text stays whole."""
    s = _c(s)
    size = F.pmod(h32(f"{seed}.l", key), F.lit(hi - lo + 1)) + lo
    at = F.pmod(h32(f"{seed}.s", key), (F.greatest(F.length(s) - size, F.lit(0)) + 1).cast("bigint"))
    sp = cut(s, at, at + size)
    spaced = F.instr(F.trim(sp), " ") > 0
    head = F.when(spaced & (at > 0), cut(sp, F.instr(sp, " "))).otherwise(sp)
    tail = rfind(head, " ")
    out = F.when(spaced & (tail > floor), cut(head, 0, tail)).otherwise(head)
    return F.trim(F.when(F.length(s) > size, out).otherwise(s))


def prefix_cut(s: Column | str, key: Column | str, seed, lo: int = 20, hi: int = 40, floor: int = 10) -> Column:
    """The first lo..hi characters, cut back to the last blank unless that lies before `floor`."""
    s = _c(s)
    size = F.pmod(h32(seed, key), F.lit(hi - lo + 1)) + lo
    t = cut(s, 0, size)
    last = rfind(t, " ")
    return F.when(F.length(s) <= size, s).when(last >= floor, cut(t, 0, last)).otherwise(t)


def chunk(t: Column | str, key: Column | str, seed, lo: int = 200, hi: int = 2500, snap: int = 50) -> Column:
    """lo..hi characters from a hashed place; the start moves to the next blank when that is near."""
    t = _c(t)
    size = F.pmod(h32(f"{seed}.l", key), F.lit(hi - lo + 1)) + lo
    at = F.pmod(h32(f"{seed}.s", key), (F.greatest(F.length(t) - size, F.lit(0)) + 1).cast("bigint"))
    blank = F.locate(" ", cut(t, at, at + snap))  # 1-based inside the snap window
    start = F.when(blank > 0, at + blank).otherwise(at)
    return F.when(F.length(t) <= hi, t).otherwise(strip(cut(t, start, start + size)))


def chunk_sentences(s: Column, key: Column | str, seed, kmax: int = 3) -> Column:
    """Back-to-back units of 1..kmax sentences; the size of a unit is a hash of the sentence number it starts at."""
    size = lambda x, i: (F.pmod(h32(F.concat(F.lit(f"{seed}:"), i.cast("string")), key), F.lit(kmax)) + 1).cast("int")
    return _joined_runs(s, F.transform(s, size))


@F.arrow_udf(ArrayType(StringType()))
def _joined_runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Elements joined by blanks: the first as many as its size says, then the next ones from there."""
    for lists, sizes in batches:
        out = []
        for parts, size in zip(lists.to_pylist(), sizes.to_pylist()):
            units, at = [], 0
            while parts is not None and at < len(parts):
                units.append(" ".join(p for p in parts[at:at + size[at]] if p is not None))
                at += size[at]
            out.append(None if parts is None else units)
        yield pa.array(out, pa.list_(pa.string()))


def windows(words: Column, size: int, stride: int) -> Column:
    """Overlapping fixed windows; the last one ends at the last word."""
    n = F.size(words)
    last = F.greatest(n - size, F.lit(0))
    steps = F.ceil(last / F.lit(stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda i: F.slice(words, i * stride + 1, size))


def lead_passage(text: Column | str, lo: int, hi: int, chars: bool = False) -> Column:
    """Whole paragraphs from the start up to `hi` words (or characters), the rest filled with sentences; NULL below lo."""
    size = (lambda s: F.length(F.replace(s, F.lit(" "), F.lit("")))) if chars else (
        lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    t = _c(text)
    paras = F.filter(F.transform(F.split(t, r"\n\s*\n|\n"), lambda p: strip(p)), lambda p: F.length(p) > 0)
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def fill(acc, sent):
        room = ~acc["done"] & (acc["n"] + size(sent) <= hi)
        return F.struct(F.when(room, acc["n"] + size(sent)).otherwise(acc["n"]).alias("n"), (~room).alias("done"),
                        F.when(room, F.concat(acc["out"], F.array(sent))).otherwise(acc["out"]).alias("out"))

    def step(acc, p):
        fits = acc["n"] + size(p) <= hi
        whole = F.struct((acc["n"] + size(p)).alias("n"), F.lit(False).alias("done"), F.concat(acc["out"], F.array(p)).alias("out"))
        stop = F.struct(acc["n"].alias("n"), F.lit(True).alias("done"), acc["out"].alias("out"))
        spill = F.aggregate(F.split(p, r"(?<=[.!?。！？])\s*"), F.struct(acc["n"].alias("n"), F.lit(False).alias("done"), acc["out"].alias("out")), fill)
        spilled = F.struct(spill["n"].alias("n"), F.lit(True).alias("done"), spill["out"].alias("out"))
        return F.when(acc["done"], acc).when(fits, whole).when(acc["n"] >= lo, stop).otherwise(spilled)

    end = F.aggregate(paras, zero, step)
    return F.when(end["n"] >= lo, strip(F.array_join(end["out"], "\n")))
