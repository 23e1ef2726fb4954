"""Punctuation units by an Arrow function: the rules word by word, and slices of a batch."""

import random
import re
import time
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions import text as X
from glyphmill.functions import units as U
from glyphmill.operators import dedup as D
from glyphmill.operators import filters as B
from glyphmill.operators import seqlabel as Q
from glyphmill.operators import spans as S

ODD = list("aBéß你好1２٣Ⅷ😀.,:;!?…。！．।；؛，、،？؟：¿¡-–—\"'«»“”‘’()[]{}*$= \t\n\x1c") + [chr(c) for c in (0x85, 0xA0, 0x1680, 0x2000, 0x2003, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0x180E, 0x301, 0x1C5)]
SPACE = "[" + "".join(chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "]"


def kind(c, *kinds):
    return any(unicodedata.category(c).startswith(k) for k in kinds)


def gone(t, i):
    if t[i] in ".,:":
        return not (i and kind(t[i - 1], "Nd") and i + 1 < len(t) and kind(t[i + 1], "Nd"))
    return t[i] in Q.STOPS + Q.COMMAS + Q.QUESTIONS + Q.COLONS + Q.DROPPED


def strongest(run, greek=False):
    for lab, marks in (("?", Q.QUESTIONS + ";" * greek), (".", Q.STOPS), (":", Q.COLONS), (",", Q.COMMAS)):
        if any(c in marks for c in run):
            return lab
    return "0"


def item(w, greek):
    core = "".join(c for i, c in enumerate(w) if not gone(w, i))
    run = w[max([i + 1 for i, c in enumerate(w) if kind(c, "L", "N")], default=0):]
    what = "dash" if w in ("-", "--", "–", "—") else "mark" if not core else "quote" if all(c in Q.QUOTES for c in core) else "word"
    lab = strongest(run, greek)
    return core, lab, what, lab == "." and w.rstrip("\"'»”’)]").endswith(".")


def spaced(t, greek):
    items = [item(w, greek) for w in re.split(SPACE + "+", t) if w]
    kept = [i for i, x in enumerate(items) if x[2] in ("word", "quote")]
    rank = {"?": 4, ".": 3, ":": 2, "-": 1, ",": 1, "0": 0}
    out = []
    for a, b in zip(kept, [*kept[1:], None]):
        lab = items[a][1]
        for _, other, what, _ in items[a + 1:None if b is None else b + 1]:
            if what == "dash":
                lab = "-" if lab == "0" else lab
            elif what != "word" and rank[other] > rank[lab]:
                lab = other
        out.append((items[a][0], "0" if items[a][3] and b is not None and kind(items[b][0][0], "Ll") else lab))
    return out or [(None, None)]


def glued(t):
    skip = [gone(t, i) or c in "\t\n\x0b\f\r –—" for i, c in enumerate(t)]
    out = []
    for i in (i for i, s in enumerate(skip) if not s):
        j = i + 1
        while j < len(t) and skip[j]:
            j += 1
        lab = strongest(t[i + 1:j])
        near = [c for c in t[i + 1:j] if c in Q.COMMAS + "–—"]
        out.append((t[i], "-" if lab in "0," and near and near[0] in "–—" and t[i] not in "\x85\u2028\u2029" else lab))
    return out


def test_units_of_odd_texts(spark, monkeypatch):
    rnd = random.Random(7)
    texts = [None, "", "!!!", "- -", "U.S. policy", "a. b", "(a.) b", "x . . ? y", "“ a ” .", "1.5 2,000 10:30 .5 5. 1.,2", "a -- -b"]
    texts += ["".join(rnd.choices(ODD if i % 2 else "abA1.,:;-–\"' ?", k=rnd.randint(1, 40))) for i in range(600)]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("en", "zh", "el", None)]
    df = Q.punct_units(spark.createDataFrame(rows, "id int, t string, lang string"), "t", "lang")
    for r in df.collect():
        got = None if r.units is None else [tuple(x) for x in r.units]
        assert got == (None if r.t is None and r.lang == "zh" else glued(r.t) if r.lang == "zh" else spaced(r.t or "", r.lang == "el")), (r.t, r.lang)


def test_units_are_no_patterns_on_every_word(spark):
    df = Q.punct_units(spark.createDataFrame([("a b.", "en")], "t string, lang string"), "t", "lang")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan


def test_units_yield_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(U, "SLICE", 1 << 10)
    texts, kinds = pa.array(["a b, c." * 10] * 300), pa.array([0, 1, 2] * 100, pa.int32())
    out = list(Q._punct.func(iter([(texts, kinds)])))
    assert sum(map(len, out)) == 300 and max(map(len, out)) <= 20
    assert out[0][0].as_py()[:3] == [{"word": "a", "lab": "0"}, {"word": "b", "lab": ","}, {"word": "ca", "lab": "0"}]


def test_offsets_of_laid_out_tokens(spark):
    tokens = [["你", "😀b", "c"], [], None, ["x"], ["", "a", ""]]
    df = spark.createDataFrame([(t, lang) for t in tokens for lang in ("zh", "en")], "t array<string>, lang string").select("t", "lang", S.detokenize("t", "lang").alias("d"))
    for r in df.collect():
        gap, at, want = (0 if r.lang == "zh" else 1), 0, []
        for w in r.t or []:
            want.append((at, at + len(w)))
            at += len(w) + gap
        assert (r.d.text, r.d.units and [tuple(x) for x in r.d.units]) == ((None, None) if r.t is None else ((" " * gap).join(r.t), want)), r


def test_offsets_yield_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(U, "SLICE", 1 << 10)
    sizes, gaps = pa.array([[1, 2, None] * 10] * 300, pa.list_(pa.int32())), pa.array([1] * 300, pa.int32())
    out = list(U._laid_out.func(iter([(sizes, gaps)])))
    assert sum(map(len, out)) == 300 and max(map(len, out)) <= 20
    assert out[0][0].as_py()[:4] == [{"start": 0, "end": 1}, {"start": 2, "end": 4}, {"start": None, "end": 4}, {"start": 5, "end": 6}]


def test_detokenized_texts_are_split_once(spark):
    import catalog

    catalog.load_all()
    plan = catalog.QUERIES["h33_detokenize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "zip_with(" not in plan.lower()


def test_texts_end_in_time(spark):
    """A pattern for the end of a text started anew at every blank and every mark."""
    texts = ["He said " + "x" * 40 + end for end in (".", ".\"’)", ". 　\x1c\n", "\"", ".\"x", "؟»", "", "។ ", " .\n.\r\n")] + [None, "", ".", "a" * 100_000 + " " * 60_000 + "b."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    for r in df.select("t", X.ends_sentence("t").alias("e"), K.strip("t").alias("s"), X.letter_share("t").alias("l")).collect():
        if r.t is None:
            assert r.e is None and r.s is None and r.l is None
            continue
        own = r.t.strip(K.BLANKS)
        solid = [c for c in r.t if c not in K.BLANKS]
        assert r.s == own and r.e == (len(own) >= 30 and own.rstrip(X.CLOSERS)[-1:] in set(".!?…。！？।؟።"))
        assert abs(r.l - (sum(kind(c, "L", "M") for c in solid) / len(solid) if solid else 0)) < 1e-12
    assert time.time() - began < 10


def test_density_of_long_runs(spark):
    rnd = random.Random(3)
    rows = [[], [0], [1], [None, 1, 0, 0], [0] * 59 + [1], [0] * 60 + [1], [1] + [0] * 60, [0, 1] * 3] + [[int(rnd.random() < p) for _ in range(rnd.randint(1, 200))] for p in (0.02, 0.1, 0.3, 0.5) for _ in range(20)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "a array<int>").select("a", B.mark_density("a").alias("d"))
    for r in df.collect():
        runs = "".join("1" if x else "0" for x in r.a or ()).split("1")
        n, k = len(r.a or ()), sum(bool(x) for x in r.a or ())
        assert (r.d is None) if r.a is None else r.d == (0 < k <= n * 0.35 and max(map(len, runs)) < 60), r.a
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_keys_are_made_once(spark):
    df = spark.createDataFrame([(1, "a b c.")], "id int, t string")
    plan = D.sentence_hits(df, "id", "t", df.select(F.col("t").alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 5  # one for the texts; two each for the two parts of the small evaluation set
