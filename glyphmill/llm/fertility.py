"""Quality rules from tokeniser fertility.

A public vocabulary encodes the words of a text; three figures follow: characters per token, the share of byte-fallback tokens, and
the entropy of the text's tokens against that of equally many different ones. Text that the vocabulary's language model of the
world doesn't fit - encoded data, broken encodings, symbol noise, repetition - leaves the usual range. The usual range is taken per
group (language, or else the script of most letters): from the quartiles over all documents of the group, widened by REACH times
their distance and at least by the figure's own slack; for a text of n tokens the widening grows by sqrt(1 + FEW / n), as figures of
short texts vary more, and in a group of m texts by sqrt(1 + TEXTS / m), as quartiles of few texts vary more. Figures depend on
the length, so a group is also cut into classes, LENGTHS for every doubling of the characters, with narrower bands of their own: the
limits that hold are those of class and group, mixed by m / (m + TEXTS) for a class of m texts.
A text is rejected outside a band, or if it fails the base rules.

Quartiles come from counts on a fixed grid, so they are exact on it, equal for any partitioning, and a hot group is one row per
grid cell. Texts are read whole; each distinct word of a batch is encoded once.

Cases: a null text has no words, fails the base rules and has no figures; a null language is a group of its own, by script; a
group's bands come from its own texts only, whatever their number, so a single text is never outside; a group in which every text
fails the base rules has no bands; repeated rows get equal results; an
empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import saved

REACH = 4.0
FEW = 400
TEXTS = 10
#: Classes of length per doubling of a text's characters, and their least widening as a share of a group's.
LENGTHS, CLASS_SLACK = 2, 0.25
#: figure -> (grid step, least widening)
FIGURES = {"chars_per_token": (0.01, 0.1), "byte_share": (0.001, 0.02), "evenness": (0.01, 0.1)}
WINDOW = 8
SYMBOLS = "#*$%&|<>"
CACHE = 100_000
#: Bytes of the longest word that is remembered: at most about half a kilobyte an entry, 100 MB a worker.
REMEMBERED = 64
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, "
          "byte_share double, evenness double, script string")
#: First code points and names of blocks of letters, coarse.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "southeast asian"),
           (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
_FIRST = np.array([c for c, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_NAME = np.array([_NAMES.index(n) for _, n in SCRIPTS])


class Vocabulary:
    """Token ids per word from a sentencepiece file, each word with the space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), words.Cache(CACHE)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def encode(self, values: list[bytes]) -> list[bytes]:
        def new(ws: list[bytes]) -> list[bytes]:
            return [np.array(ids, "<u4").tobytes() for ids in self.model.encode([w.decode() for w in ws], num_threads=1)]

        # long runs without spaces are encoded, but never remembered: an entry has a bounded size, and so has the cache
        short = [v for v in values if len(v) <= REMEMBERED]
        self.known.fill(short, new)
        long = [v for v in values if len(v) > REMEMBERED]
        own = dict(zip(long, new(long)))
        return [self.known[v] if len(v) <= REMEMBERED else own[v] for v in values]


def repeated_words(codes: np.ndarray, starts: np.ndarray, values: list[bytes]) -> np.ndarray:
    """Words of each text in windows of WINDOW words that occur twice or more in it."""
    size, n = len(starts) - 1, len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(size, "int64")
    # windows are named by doubling: pairs of words, then of pairs, then of fours; equal names mean equal windows
    name, span = codes.astype("int64"), 1
    while span < WINDOW:
        both = name[:-span] * (int(name.max()) + 1) + name[span:]
        name, span = np.unique(both, return_inverse=True)[1].astype("int64"), 2 * span
    doc = np.repeat(np.arange(size), np.diff(starts))
    inside = doc[:n] == doc[WINDOW - 1:]
    key = np.where(inside, doc[:n] * (int(name.max()) + 1) + name, -1)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    twice = np.zeros(n, bool)
    twice[order] = (same | np.concatenate([same[1:], [False]])) & (k >= 0)
    mark = np.zeros(len(codes) + 1, "int64")
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.subtract.at(mark, at + WINDOW, 1)
    return np.bincount(doc, np.cumsum(mark[:-1]) > 0, size).astype("int64")


def measure(texts: pa.Array, vocabulary: Vocabulary) -> pa.RecordBatch:
    """One row of SCHEMA per text."""
    plain = words.translated(texts, bytes(range(256)))
    codes, starts, values = words.split(words.translated(texts, words.SPACED))
    size, n = len(starts) - 1, np.diff(starts)
    decoded = [v.decode() for v in values]
    chars = np.fromiter(map(len, decoded), "int64", len(values))
    doc = np.repeat(np.arange(size), n)
    word_chars = np.bincount(doc, chars[codes], size).astype("int64")
    ends = np.frombuffer(plain.buffers()[1], "int64") if size else np.zeros(1, "int64")
    raw = np.frombuffer(plain.buffers()[2], "u1") if ends[-1] else np.zeros(0, "u1")
    total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    dup = np.zeros(size, "int64")
    for i, text in enumerate(plain):
        lines = [x for x in text.as_py().split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    # tokens of every text: those of its words, one after the other
    ids = vocabulary.encode(values)
    lens = np.fromiter(map(len, ids), "int64", len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4").astype("int64")
    n_tokens = np.bincount(doc, lens[codes], size).astype("int64")
    token, of = words.gather(codes, lens, flat), np.repeat(doc, lens[codes])
    n_bytes = np.bincount(of, vocabulary.byte[token], size)
    keys, count = np.unique(of * len(vocabulary.byte) + token, return_counts=True)
    owner = keys // len(vocabulary.byte)
    p = count / n_tokens[owner]
    entropy = np.bincount(owner, -p * np.log2(p), size)
    most = np.log2(np.maximum(np.minimum(n_tokens, len(vocabulary.byte)), 2))
    # script of most letters, per distinct word first
    letters = np.zeros((len(values), len(_NAMES)), "int64")
    points = np.frombuffer("".join(decoded).encode("utf-32-le"), "<u4").astype("int64")
    place = np.searchsorted(_FIRST, points, "right") - 1
    letter = (place >= 0) & ((points >= 0xC0) | ((points | 32) >= 97) & ((points | 32) <= 122))
    np.add.at(letters, (np.repeat(np.arange(len(values)), chars)[letter], _NAME[place[letter]]), 1)
    per = np.stack([np.bincount(doc, letters[codes, j], size) for j in range(len(_NAMES))], 1)
    script = [_NAMES[j] if m else "none" for j, m in zip(per.argmax(1).tolist(), per.max(1).tolist())]
    none = n_tokens == 0
    figure = lambda x: pa.array(np.where(none, 0.0, x), mask=none)
    some = np.maximum(n_tokens, 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (n, word_chars, total(symbol[raw]), dup, repeated_words(codes, starts, values), n_tokens)]
        + [figure(word_chars / some), figure(n_bytes / some), figure(entropy / most), pa.array(script)], [c.split()[0] for c in SCHEMA.split(", ")])


def figures(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, lang and SCHEMA of every row of docs(doc_id, lang, text)."""
    rows = docs.select("doc_id", "lang", "text")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.kept_in_worker(path, lambda: Vocabulary(path))
        for batch in batches:
            for piece in words.pieces(batch, 2):
                got = measure(piece.column(2), vocabulary)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *got.columns], ["doc_id", "lang", *got.schema.names])

    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, lang {kind['lang']}, {SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(rows: DataFrame, group: str = "group", slack: float = 1.0) -> DataFrame:
    """(group, figure, low, high, widen, total) from the rows of the group that pass the base rules."""
    cells = F.array(*[F.struct(F.lit(f).alias("figure"), F.round(F.col(f) / step).cast("long").alias("cell")) for f, (step, _) in FIGURES.items()])
    each = rows.where(~base_failed()).select(F.col(group).alias("group"), F.explode(cells).alias("c")).groupBy("group", "c.figure", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group", "figure")
    each = each.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("cell")))
    quarter = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell")))
    out = each.groupBy("group", "figure").agg(quarter(0.25).alias("q1"), quarter(0.75).alias("q3"), F.max("total").alias("total"))
    step = F.element_at(F.create_map(*[F.lit(x) for f, (s, _) in FIGURES.items() for x in (f, s)]), F.col("figure"))
    least = F.element_at(F.create_map(*[F.lit(x) for f, (_, s) in FIGURES.items() for x in (f, slack * s)]), F.col("figure"))
    widen = F.greatest(REACH * (F.col("q3") - F.col("q1")) * step, least) * F.sqrt(1 + TEXTS / F.col("total"))
    return out.select("group", "figure", (F.col("q1") * step).alias("low"), (F.col("q3") * step).alias("high"), widen.alias("widen"), "total")


def _by_group(found: DataFrame, group: str, name: str) -> DataFrame:
    """(<group>, <name>): figure -> band, a row per group."""
    band = F.map_from_entries(F.collect_list(F.struct("figure", F.struct("low", "high", "widen", "total"))))
    return saved(found.groupBy(F.col("group").alias(group)).agg(band.alias(name)), "fertility-bands")


def judge(docs: DataFrame, path: str) -> DataFrame:
    """Figures, base_failed, kept and the figures outside their band, of every row."""
    rows = figures(docs, path).withColumn("group", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script")))
    length = F.floor(LENGTHS * F.log2(F.greatest("word_chars", F.lit(1)))).cast("string")
    rows = saved(rows.withColumn("class", F.concat_ws(" ", "group", length)), "fertility")
    rows = rows.join(_by_group(bands(rows), "group", "band"), "group", "left").join(_by_group(bands(rows, "class", CLASS_SLACK), "class", "own"), "class", "left")
    more = F.sqrt(1 + FEW / F.col("n_tokens"))

    def beyond(f: str) -> Column:
        at, own = F.col("band")[f], F.col("own")[f]
        share = F.coalesce(own["total"] / (own["total"] + TEXTS), F.lit(0.0))  # a class counts by its number of texts
        limit = lambda side, sign: F.coalesce(share * (own[side] + sign * own["widen"]), F.lit(0.0)) + (1 - share) * (at[side] + sign * at["widen"] * more)
        return F.when((F.col(f) < limit("low", -1)) | (F.col(f) > limit("high", 1)), F.lit(f))

    rows = rows.withColumn("outside", F.filter(F.array(*[beyond(f) for f in FIGURES]), lambda x: x.isNotNull()))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
