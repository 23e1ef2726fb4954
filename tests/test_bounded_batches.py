"""Arrow functions hold slices of a batch, and cut a text without counting from its beginning for every span."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.functions import dictionary as DI
from glyphmill.functions import keys as K
from glyphmill.functions import perturb as PT
from glyphmill.functions import units as U
from glyphmill.operators import augment as A
from glyphmill.operators import compress as Z
from glyphmill.operators import seqlabel as Q
from glyphmill.operators import spans as S

TEXTS = ["", None, " ", "a", "Zwei  Wörter\n", "你好 世界。再见", "😀 smile\x1c😀x", "x\u00a0y\u3000z \u200b q", " pad　", "12,5 %!"]


def test_dictionary_yields_slices_of_a_batch(monkeypatch):
    """The spans of 400 texts of one batch never stand in memory at once."""
    monkeypatch.setattr(U, "SLICE", 1 << 10)
    texts = pa.array([f"aa bb {i} aa bb" * 5 for i in range(400)])
    entities = pa.array([[{"text": "aa", "label": "x"}, {"text": "bb", "label": None}]] * 400, pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())])))
    out = list(DI._arrow(texts, entities, 1, lambda text, spans: spans))
    assert sum(map(len, out)) == 400 and max(map(len, out)) <= 20
    assert [s["start"] for s in out[0][0].as_py()] == [m.start() for m in re.finditer("aa", texts[0].as_py())] + [m.start() for m in re.finditer("bb", texts[0].as_py())]


def test_word_units_over_slices(spark, monkeypatch):
    monkeypatch.setattr(U, "SLICE", 64)
    rnd = random.Random(1)
    rows = [(i, t, lang) for i, t in enumerate(TEXTS + ["".join(rnd.choices("ab \n\t語 ", k=rnd.randint(0, 90))) for _ in range(200)]) for lang in ("en", "zh")]
    df = spark.createDataFrame(rows, "id int, text string, lang string").withColumn("u", U.word_units("text", "lang")).withColumn("t", U.unit_texts("text", "u"))
    for r in df.collect():
        spans = [m.span() for m in re.finditer(r"\S" if r.lang == "zh" else r"\S+", r.text or "")]
        assert [tuple(x) for x in r.u] == spans and r.t == [r.text[a:b] for a, b in spans]


def test_unit_texts_equal_cuts(spark):
    """Any spans: outside the text, reversed, overlapping, negative, null."""
    rows = [(t, [(a, b) for a in (-9, -2, -1, 0, 1, 4, 99) for b in (-1, 0, 2, 5, 999)] + [None]) for t in TEXTS] + [("abc", None), ("abc", [])]
    df = spark.createDataFrame(rows, "t string, u array<struct<start:int,end:int>>")
    got = df.select(U.unit_texts("t", "u").alias("a"), F.transform("u", lambda x: U.cut(F.col("t"), x["start"], x["end"])).alias("b"), "t", "u").collect()
    assert all(r.a == r.b for r in got), [r for r in got if r.a != r.b][:2]


def old_strip(x, text):
    inner = text[x[0]:x[1]]
    alnum = [i for i, c in enumerate(inner) if re.match(r"[^\W_]", c)]
    return (x[0] + len(inner),) * 2 if not alnum else (x[0] + alnum[0], x[0] + alnum[-1] + 1)


def test_strip_spans_of_a_long_text(spark):
    """40,000 spans of one text: cutting each by counting from the text's beginning would take 800 million steps, four times."""
    rnd = random.Random(2)
    long_ = "".join(rnd.choices("ab1.,( é語😀", k=160_000))
    rows = [(i, t, sorted((a, a + rnd.randint(0, 9)) for a in (rnd.randrange(len(t) + 1) for _ in range(40_000 if len(t) > 999 else 5)))) for i, t in enumerate([long_, "", "...", "a", "(é)", "語. x"])]
    rows = [(i, t, [(a, min(b, len(t)), "W") for a, b in s]) for i, t, s in rows]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,label:string>>")
    began = time.time()
    got = {r.id: [tuple(x) for x in r.s] for r in df.select("id", S.strip_spans("text", "spans").alias("s")).collect()}
    assert time.time() - began < 20
    for i, t, s in rows:
        assert got[i] == [(*old_strip(x, t), "W") for x in s]


def test_join_kept_of_a_long_text(spark):
    rnd = random.Random(3)
    rows = []
    for i, t in enumerate([*TEXTS, " ".join(str(k) + rnd.choice(["", "é", "😀"]) for k in range(40_000))]):
        spans = [m.span() for m in re.finditer(r"\S+", t or "")]
        rows.append((i, t, [s for s in spans if rnd.random() < 0.5] if i % 3 else [(a, a + 1) for a, b in spans]))
    rows.append((99, "a b", None))
    df = spark.createDataFrame(rows, "id int, text string, kept array<struct<start:int,end:int>>")
    got = {r.id: r.s for r in df.select("id", Z.join_kept("text", "kept").alias("s")).collect()}
    for i, t, kept in rows:
        want = None if t is None or kept is None else "".join((" " if k and re.search(r"\s", t[kept[k - 1][1]:a]) else "") + t[a:b] for k, (a, b) in enumerate(kept))
        assert got[i] == want


def test_matching_equals_difflib():
    import difflib
    rnd = random.Random(4)
    for _ in range(400):
        x = rnd.choices("abcdefgh", k=rnd.randint(0, 40))
        y = [w for w in x if rnd.random() < 0.7] if rnd.random() < 0.5 else rnd.choices("abcdefgh", k=rnd.randint(0, 40))
        want = [-1] * len(x)
        for i, j, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
            want[i:i + n] = range(j, j + n)
        assert Z.matching(x, y) == want


def test_matching_yields_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(U, "SLICE", 1 << 10)
    words = pa.array([["a", "b"] * 10] * 300)
    out = list(Z.match_map.func(iter([(words, words)])))
    assert sum(map(len, out)) == 300 and max(map(len, out)) <= 20 and out[0][0].as_py() == list(range(20))


def test_nfkc_yields_a_few_rows_at_a_time():
    texts = pa.array(["ﬁne", None, "Ａ"] * 100)
    out = list(K.nfkc.func(iter([texts])))
    assert max(map(len, out)) <= K.ROWS and [x for o in out for x in o.to_pylist()] == ["fine", None, "A"] * 100


def test_payment_numbers_are_made_once(spark):
    """No expression of the plan repeats the check digits of a card at every place that a template has for them."""
    df = A.payment_snippets(spark.range(50).select("id", F.lit("N").alias("name")), "id", "name", 13)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("13.c1") <= 2 and plan.count("13.i1") <= 2
    for r in df.collect():
        for s in r.spans:
            value = r.text[s.start:s.end]
            assert value == "N" if s.label == "PERSON" else value


def test_typo_draws_are_sparks_hashes(spark):
    rows = spark.range(300).select("id", F.xxhash64(F.lit("s"), F.col("id").cast("string")).alias("h"), F.xxhash64(F.lit("s"), F.col("id").cast("string"), F.col("id").cast("int")).alias("i"),
                                   F.xxhash64(F.lit("s"), F.col("id").cast("string"), F.col("id")).alias("l")).collect()
    seed, x = np.array([r.h for r in rows]).view("uint64"), np.arange(300)
    assert PT.hash_on(seed, x).view("int64").tolist() == [r.i for r in rows] and PT.hash_on(seed, x, True).view("int64").tolist() == [r.l for r in rows]


def test_typos_are_no_array_expression(spark):
    """A text's characters no longer pass through interpreted array functions, each with four hashes and two patterns."""
    df = spark.createDataFrame([(1, "Hello there, Wörld"), (2, None), (3, "")], "id int, t string").select("id", "t", PT.typos("t", 0.9, 1, "id").alias("x"))
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.x for r in df.collect()}
    assert got[2] is None and got[3] == "" and got[1] != "Hello there, Wörld"


def test_boundary_window_moves_numbers_only(spark):
    """The map of marks and the array of cases are not shuffled for rows that don't need them any more."""
    marks = F.create_map(*[v for i, l in enumerate(Q.LABELS) for v in (F.lit(l), F.rand(i))])
    df = spark.range(5).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), marks.alias("marks"), F.array(*[F.rand(i) for i in range(3)]).alias("cases"))
    plan = Q.decode_boundary(df.repartition(2), "doc", "pos", "marks", "cases", 0.5).select("pm", "pc")._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(cases" not in plan and "lead(_c0" in plan


def test_pool_files_are_written_by_all_tasks(spark, tmp_path):
    from catalog.q_a_sources import pool_files

    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("t").alias("text")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a split per file
    try:
        paths = pool_files(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [spark.read.parquet(p).select("doc_id", F.input_file_name().alias("f")).collect() for p in paths]
    assert sorted(r.doc_id for rs in rows for r in rs) == list(range(400)) and all(len({r.f for r in rs}) > 1 for rs in rows)
