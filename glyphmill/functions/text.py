"""Text predicates and measures used by the quality filters."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .keys import BLANKS, _c, strip

# Script code of a language label -> Unicode script class.
SCRIPT_CLASS = {
    "Latn": r"\p{IsLatin}", "Cyrl": r"\p{IsCyrillic}", "Arab": r"\p{IsArabic}", "Deva": r"\p{IsDevanagari}",
    "Beng": r"\p{IsBengali}", "Tibt": r"\p{IsTibetan}", "Laoo": r"\p{IsLao}", "Thai": r"\p{IsThai}",
    "Grek": r"\p{IsGreek}", "Hebr": r"\p{IsHebrew}", "Ethi": r"\p{IsEthiopic}", "Hang": r"\p{IsHangul}",
    "Kore": r"\p{IsHangul}", "Jpan": r"\p{IsHiragana}\p{IsKatakana}\p{IsHan}", "Hani": r"\p{IsHan}",
    "Hans": r"\p{IsHan}", "Hant": r"\p{IsHan}", "Armn": r"\p{IsArmenian}", "Geor": r"\p{IsGeorgian}",
    "Gujr": r"\p{IsGujarati}", "Guru": r"\p{IsGurmukhi}", "Knda": r"\p{IsKannada}", "Mlym": r"\p{IsMalayalam}",
    "Orya": r"\p{IsOriya}", "Sinh": r"\p{IsSinhala}", "Taml": r"\p{IsTamil}", "Telu": r"\p{IsTelugu}",
    "Mymr": r"\p{IsMyanmar}", "Khmr": r"\p{IsKhmer}", "Tfng": r"\p{IsTifinagh}", "Olck": r"\p{IsOl_Chiki}",
}
# English function words.
ENGLISH_WORDS = (
    "the and of to is in that for with on are was this as by be it from at or an have not which you"
).split()
# Closing quotes that may follow a final mark.
CLOSERS = "\"'”’»)」』】"


def count_class(c: Column | str, cls: str) -> Column:
    """How many characters fall in a regex character class."""
    return F.length(F.regexp_replace(_c(c), f"[^{cls}]", ""))


def script_frac(c: Column | str, script: Column | str) -> Column:
    """Share of letters that belong to the script; 1.0 for unknown scripts and for text without letters.

    `script` is a script code column or a constant code; a column picks its pattern from a literal map, so each row runs
    two regular expressions whatever the number of scripts."""
    letters = count_class(c, r"\p{L}")
    foreign = {name: rf"[^\p{{L}}]|[^{cls}]" for name, cls in SCRIPT_CLASS.items()}
    if isinstance(script, str) and script in foreign:
        pattern, known = F.lit(foreign[script]), F.lit(True)
    else:
        table = F.create_map(*[F.lit(x) for kv in foreign.items() for x in kv])
        pattern = F.try_element_at(table, _c(script))
        known = pattern.isNotNull()
    own = F.length(F.regexp_replace(_c(c), F.coalesce(pattern, F.lit("^$")), F.lit("")))
    return F.when((letters == 0) | ~known, 1.0).otherwise(own / letters)


def latin_share(c: Column | str) -> Column:
    letters = count_class(c, r"\p{L}")
    own = F.length(F.regexp_replace(_c(c), r"[^\p{L}]|[^\p{IsLatin}]", ""))
    return F.when(letters == 0, 0.0).otherwise(own / letters)


def english_share(c: Column | str) -> Column:
    """Share of function words among the a-z words; 0 below four words."""
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_WORDS)))
    return F.when(F.size(words) >= 4, hits / F.size(words)).otherwise(F.lit(0.0))


def english_like(c: Column | str) -> Column:
    return english_share(c) >= 0.25


def letter_share(c: Column | str) -> Column:
    """Letters and marks over non-space characters."""
    solid = F.length(F.translate(_c(c), BLANKS, ""))
    return F.when(solid == 0, 0.0).otherwise(count_class(c, r"\p{L}\p{M}") / solid)


def ends_sentence(c: Column | str, min_len: int = 30) -> Column:
    """At least `min_len` characters and, closing quotes aside, a sentence-final mark at the end."""
    t = strip(c)
    return (F.length(t) >= min_len) & F.substring(F.rtrim(t, F.lit(CLOSERS)), -1, 1).isin(*".!?…。！？।؟።")


def has_trigger(c: Column | str, words: list[str]) -> Column:
    return _c(c).rlike(r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")


# Letters folded by table before decomposition.
FOLD_TABLE = {"ı": "i", "İ": "I", "ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ł": "l", "Ł": "L", "đ": "d",
              "Đ": "D", "ð": "d", "þ": "th", "œ": "oe", "Œ": "OE"}
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


@F.pandas_udf(StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", _COMBINING.sub("", unicodedata.normalize("NFKD", t))))


def fold(c: Column | str) -> Column:
    """Diacritic-free text: special letters by table, then NFKD without combining marks, then NFC (Arrow batches)."""
    t = _c(c)
    for src, dst in FOLD_TABLE.items():
        if len(dst) > 1:
            t = F.replace(t, F.lit(src), F.lit(dst))
    one = {k: v for k, v in FOLD_TABLE.items() if len(v) == 1}
    return _strip_marks(F.translate(t, "".join(one), "".join(one.values())))


# Invisible characters, bidi controls, tag characters, variation selectors, combining overlays.
INVISIBLE = (r"[\u00AD\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF\uFE00-\uFE0F"
             r"\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}\u0305\u0331-\u0338\u20D0-\u20FF]")


def decode_obfuscation(c: Column | str) -> Column:
    """Smuggled text made visible: tag characters and byte-valued variation selectors to the ASCII they stand for, then
    NFKC, then invisible characters and overlays removed."""
    from .keys import nfkc

    codes = range(0x20, 0x7F)
    hidden = "".join(chr(0xE0000 + i) for i in codes) + "".join(chr(0xE0100 + i - 16) for i in codes)
    plain = F.translate(_c(c), hidden, "".join(chr(i) for i in codes) * 2)
    return F.regexp_replace(nfkc(plain), INVISIBLE, "")


def head_tail(c: Column | str, head: int, tail: int, marker: str = "\n[...]\n") -> Column:
    t = _c(c)
    return F.when(F.length(t) <= head + tail, t).otherwise(
        F.concat(F.substring(t, 1, head), F.lit(marker), F.substring(t, -tail, tail))
    )


def lower_keep_len(c: Column | str) -> Column:
    """Lower-case that never changes the number of characters."""
    return F.array_join(
        F.transform(F.split(_c(c), ""), lambda ch: F.when(F.length(F.lower(ch)) == 1, F.lower(ch)).otherwise(ch)), ""
    )


# Punctuation and symbols.
MARKS = r"[\p{P}\p{S}]"


def strip_p(c: Column | str) -> Column:
    """Word without punctuation and symbols on either edge."""
    return F.regexp_replace(_c(c), rf"^{MARKS}+|{MARKS}+$", "")


def parse_json_block(c: Column | str, schema: str) -> Column:
    """Code fences off, outermost {...} parsed with the schema; NULL when it is not JSON."""
    t = F.regexp_replace(_c(c), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})
