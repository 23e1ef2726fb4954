"""Bands of small and large groups follow one rule."""

import math
import random

from pyspark.sql import functions as F

from glyphmill.llm import fertility

from .test_operators import public_tokenizer


def figures(spark, sizes):
    rows = [(g, 100, 0, 2.0 + 0.01 * (i % 5), 0.0, 0.9) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "group string, n_words long, n_repeat_words long, chars_per_token double, byte_share double, evenness double")


def test_bands_change_smoothly_with_the_number_of_texts(spark):
    got = {(r["group"], r["figure"]): r for r in fertility.bands(figures(spark, {"a": 199, "b": 200, "c": 5, "d": 5000})).collect()}
    assert {g for g, _ in got} == {"a", "b", "c", "d"}
    for g, n in (("a", 199), ("b", 200), ("c", 5), ("d", 5000)):
        r = got[g, "chars_per_token"]
        assert abs(r["low"] - 2.01) < 1e-9 and abs(r["high"] - 2.03) < 1e-9 and abs(r["widen"] - 0.1 * math.sqrt(1 + 10 / n)) < 1e-9


def test_a_small_language_is_judged_by_its_own_texts(spark):
    plain = [(i, "en" if i < 300 else "fr", " ".join(f"the {w} house is {c}" for w in ("old", "red", "new", "big", "tall") for c in ("here", "there", f"at number {i}")))
             for i in range(360)]
    junk = [(900, "fr", " ".join("".join(chr(97 + (7 * i * j + j * j) % 26) for j in range(12)) for i in range(1, 60)))]
    other = [(1000 + i, "xx", " ".join(chr(0x10380 + (i + j) % 29) + chr(0x10380 + j * j % 29) for j in range(200))) for i in range(250)]
    for more in ([], other):
        docs = spark.createDataFrame(plain + junk + more, "doc_id long, lang string, text string")
        by = {r["doc_id"]: r for r in fertility.judge(docs, public_tokenizer("piece_bpe_32k.model")).collect()}
        assert by[900]["outside"] and not by[900]["kept"] and by[320]["kept"]


def brute_band(cells, step, least):
    n, s = len(cells), sorted(cells)
    q1, q3 = (next(c for i, c in enumerate(s, 1) if i >= q * n) for q in (0.25, 0.75))
    return q1 * step, q3 * step, max(fertility.REACH * (q3 - q1) * step, least) * math.sqrt(1 + fertility.TEXTS / n)


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(12)
    vocab = ["the", "house", "was", "old", "river", "walked", "and", "green", "over", "children", "under", "bridge"]
    rows = [(i, rnd.choice(["en", "fr", None]), " ".join(rnd.choices(vocab, k=rnd.choice([25, 30, 60, 120])))) for i in range(250)]
    rows += [(900 + i, "en", " ".join("".join(rnd.choices("xqzjkvw", k=9)) for _ in range(40))) for i in range(4)] + [(950, "de", "short"), (951, "de", None), (952, None, "日本 " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in fertility.judge(docs, public_tokenizer("piece_bpe_32k.model")).collect()}
    good = [r for r in got.values() if not r["base_failed"]]
    group = lambda r: ("lang " + r["lang"]) if r["lang"] is not None else "script " + r["script"]
    size = lambda r: (group(r), math.floor(2 * math.log2(max(1, r["word_chars"]))))
    java_round = lambda x: math.floor(x + 0.5)
    for r in good:
        outside = []
        for f, (step, least) in fertility.FIGURES.items():
            cells = lambda key: [java_round(x[f] / step) for x in good if key(x) == key(r)]
            n = len(cells(size))
            (a, b, w), (c, d, v) = brute_band(cells(group), step, least), brute_band(cells(size), step, least * fertility.CLASS_SLACK)
            share, more = n / (n + fertility.TEXTS), math.sqrt(1 + fertility.FEW / r["n_tokens"])
            low, high = share * (c - v) + (1 - share) * (a - w * more), share * (d + v) + (1 - share) * (b + w * more)
            if r[f] < low - 1e-12 or r[f] > high + 1e-12:
                outside.append(f)
        assert r["outside"] == outside and r["kept"] == (not outside)
    assert not any(got[900 + i]["kept"] for i in range(4)) and sum(r["kept"] for r in good) >= 245
    assert got[951]["kept"] is False and got[950]["base_failed"]
    assert fertility.judge(docs.where(F.lit(False)), public_tokenizer("piece_bpe_32k.model")).count() == 0
