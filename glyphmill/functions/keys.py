"""Normalised keys, sentence splitting and order-free randomness shared by every job."""

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Python's str.strip / \s sees it (Java's \s is ASCII only).
WS = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Everything that is not a Python \w character.
NONWORD = r"[^\p{L}\p{N}_]+"
# Sentence-final marks.
FINALS = ".!?。！？।؟።"
SENT_SPLIT = rf"(?<=[{FINALS}])\s+|\n+"
NO_SPACE_LANGS = ("zh", "ja", "th")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters of WS.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column | str) -> Column:
    """White space off both ends; a pattern would try every blank of the text as the beginning of its end."""
    return F.btrim(_c(c), F.lit(BLANKS))


def norm_key(c: Column | str) -> Column:
    """Lower-case, runs of non-word characters to one blank, whole text."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), NONWORD, " "))


def norm_ws(c: Column | str) -> Column:
    """Lower-case with white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), rf"{WS}+", " "))


def norm_500(c: Column | str) -> Column:
    return F.substring(norm_key(c), 1, 500)


#: Own choice: rows that an Arrow function on texts holds as Python strings at once.
ROWS = 64


@F.arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFKC; the JVM functions have no normal forms, so this is an Arrow function, over a few rows at a time."""
    for texts in batches:
        for at in range(0, len(texts), ROWS):
            yield pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.slice(at, ROWS).to_pylist()], pa.string())


def answer_tokens(c: Column | str, lang: Column | str | None = None) -> Column:
    """Answer tokens for question answering scores: NFKC, no marks, English articles out, characters for zh/ja/th.

    Without a language the text counts as English."""
    t = F.regexp_replace(F.lower(nfkc(_c(c))), r"[\p{P}\p{S}]", " ")
    words = F.filter(F.split(t, rf"{WS}+"), lambda x: x != "")
    english = F.filter(words, lambda x: ~x.isin("a", "an", "the"))
    if lang is None:
        return english
    chars = F.filter(F.split(F.regexp_replace(t, rf"{WS}+", ""), ""), lambda x: x != "")
    return F.when(_c(lang) == "en", english).when(_c(lang).isin(*NO_SPACE_LANGS), chars).otherwise(words)


def asr_norm(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(nfkc(_c(c))), r"[^\p{L}\p{N}]+", "")


def sentences(c: Column | str, lo: int = 1, hi: int | None = None) -> Column:
    """Array of stripped sentences whose length lies in [lo, hi]."""
    parts = F.transform(F.split(_c(c), SENT_SPLIT), lambda s: strip(s))
    if hi is None:
        return F.filter(parts, lambda s: F.length(s) >= lo)
    return F.filter(parts, lambda s: F.length(s).between(lo, hi))


def text_hash(c: Column | str) -> Column:
    """256-bit digest that stands for a long text as a shuffle key."""
    return F.unhex(F.sha2(_c(c), 256))


def h32(seed: int | str | Column, *key: Column | str) -> Column:
    """32-bit hash of (seed, key) as BIGINT: the same number for any partitioning and in any SQL engine with md5."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    joined = F.concat_ws(":", s, *[_c(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def u(seed: int | str | Column, *key: Column | str) -> Column:
    """Uniform number in [0, 1) per (seed, key); replaces order-dependent random generators."""
    return h32(seed, *key) / F.lit(4294967296.0)


def pick(seed: int | str | Column, key: Column | str, n: Column | int) -> Column:
    """Uniform integer in [0, n) per (seed, key)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(h32(seed, key), n.cast("bigint"))


def md5_mod(c: Column | str, n: int) -> Column:
    """The 128-bit md5 of the text modulo n, folded over four 32-bit chunks."""
    m = F.md5(_c(c))
    r = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(m, 1 + 8 * i, 8), 16, 10).cast("bigint")
        r = F.pmod(r * F.lit(4294967296) + chunk, F.lit(n).cast("bigint"))
    return r


def crc_mod(c: Column | str, n: int) -> Column:
    return F.pmod(F.crc32(_c(c).cast("string").cast("binary")), F.lit(n).cast("bigint"))
