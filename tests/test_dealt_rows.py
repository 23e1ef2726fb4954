"""Texts and arrays are dealt by document before they are exploded, so unit rows don't move."""

import random
import re

from pyspark.sql import functions as F

import catalog
from glyphmill.functions import units as U
from glyphmill.operators import compress as Z
from glyphmill.operators import seqlabel as Q


def exchanges(df):
    """Exchanges of a plan that stand above a generator."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", plan)


def test_transfer_labels_equals_joins(spark):
    """As the joins on key and position have it, also for what isn't aligned, repeated or null."""
    rnd = random.Random(7)
    words = [(d, s, p, f"w{p}") for d in (1, 2, None) for s in range(4) for p in range(rnd.randint(1, 9))] + [(1, 0, None, "x"), (1, 1, 0, "again")]
    aligned = [(d, s, p, rnd.randint(0, 9)) for d in (1, 2, None) for s in range(5) for p in range(9) if rnd.random() < 0.6] + [(1, 0, 2, None), (2, 1, 0, 1), (2, 1, 0, 1)]
    labels = [(d, s, p, rnd.choice([".", ",", None])) for d in (1, 2, 3, None) for s in range(4) for p in range(7)] + [(1, 2, None, "!"), (2, 1, 1, ";")]
    w = spark.createDataFrame(words, "doc int, sid int, a_pos int, own string")
    a = spark.createDataFrame(aligned, "doc int, sid int, a_pos int, b_pos int")
    l = spark.createDataFrame(labels, "doc int, sid int, b_pos int, label string")
    want = w.join(a, ["doc", "sid", "a_pos"], "left").join(l, ["doc", "sid", "b_pos"], "left").select("doc", "sid", "a_pos", "own", F.coalesce("label", F.lit("0")).alias("label"))
    got = Z.transfer_labels(w, a, l, ["doc", "sid"])
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, Z.transfer_labels(w, a.limit(0), l.limit(0), ["doc", "sid"]).select("label").distinct().collect())) == ["Row(label='0')"]


def test_labels_are_transferred_without_moving_words(spark):
    catalog.load_all()

    found = exchanges(catalog.QUERIES["j16_transfer_labels"](spark, "/root/testdata/sf0.001"))
    assert all(how == "REPARTITION_BY_COL" or by.startswith("own") for by, how in found), found


def test_documents_are_dealt_before_they_are_exploded(spark):
    catalog.load_all()

    for name in ("j12_decode_boundary", "j12_decode_words", "n13_boundary_events", "n13_boundary_words"):
        found = exchanges(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert [how for by, how in found if by.startswith("doc_id")] == ["REPARTITION_BY_COL"], (name, found)
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (1, ["c"])], "id int, w array<string>")
    assert sorted(map(tuple, U.explode_rows(df, ["id"], "w", "x", by=["id"]).collect())) == [(1, 0, "a"), (1, 0, "c"), (1, 1, "b")]


def test_dealt_units_are_the_same(spark):
    texts = ["", None, " ", "...", "a", "Hello, you. Is it 3.5? – Yes: so", "你好，世界。 再见\u3000x", "x\u00a0y\u3000z \u200b q", "😀 smile 😀.", "-- 'a' --", "\x85\u2028"]
    df = spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts) for lang in ("en", "zh", "el", None)], "id int, lang string, text string")
    units = Q.punct_units(df, "text", "lang")
    moved = Q.deal_units(units.select("id", "lang", "units"), "units", ["id"])
    assert [t for c, t in moved.dtypes if c == "units"] == [t for c, t in units.dtypes if c == "units"]
    assert sorted(map(repr, moved.collect())) == sorted(map(repr, units.select("id", "lang", "units").collect()))
