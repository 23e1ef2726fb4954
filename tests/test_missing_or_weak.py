"""Isotonic fits, dictionaries, packed vectors, count cubes, offsets: against brute force and on shapes that used to be slow."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import dictionary as DI
from glyphmill.functions import units as U
from glyphmill.operators import labels as J
from glyphmill.operators import metrics as N
from glyphmill.operators import passages as P
from glyphmill.operators import ranking as R
from glyphmill.operators import retrieval as L
from glyphmill.operators import spans as S


# ---- isotonic fit -----------------------------------------------------------------------------------------------------------

def brute_pav(points):
    """(x_max, mean, n) of {x: [y, ...]}."""
    blocks = []
    for x in sorted(points):
        blocks.append([x, sum(points[x]), len(points[x])])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x_, s, n = blocks.pop()
            blocks[-1] = [x_, blocks[-1][1] + s, blocks[-1][2] + n]
    return [(x, s / n, n) for x, s, n in blocks]


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "steps", "late drop"])
def test_pav_over_many_ranges(spark, monkeypatch, shape):
    rnd = random.Random(4)
    f = {"rising": lambda i: i, "falling": lambda i: -i, "noise": lambda i: rnd.randint(0, 1), "steps": lambda i: i // 100 + rnd.randint(0, 3), "late drop": lambda i: i if i < 990 else -10 ** 6}[shape]
    rows = [(i / 1000, float(f(i))) for i in range(1000) for _ in range(1 + i % 2)] + [(None, 1.0), (0.5, None)]
    points = {}
    for x, y in rows:
        if x is not None and y is not None:
            points.setdefault(x, []).append(y)
    df = spark.createDataFrame(rows, "x double, y double")
    monkeypatch.setattr(J, "POOL", 300)  # a curve with more blocks than a task may hold
    whole = J._pool
    monkeypatch.setattr(J, "_pool", lambda points, parts: whole(points, parts or 16))
    got = sorted((r.x_max, r.y_mean, r.n) for r in J.pav_fit(df, "x", "y").collect())
    assert got == [(x, pytest.approx(m), n) for x, m, n in brute_pav(points)]


def test_pav_of_nothing(spark):
    assert J.pav_fit(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0


# ---- dictionaries -----------------------------------------------------------------------------------------------------------

def brute_located(text, entities, least):
    out = []
    for e, label in entities:
        e = e.strip(" ")
        at = text.find(e) if len(e) >= max(least, 1) else -1
        while at >= 0:
            out.append((at, at + len(e), label))
            at = text.find(e, at + len(e))
    return out


def test_locate_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(rnd.choices("abAé 日😀.", k=rnd.randint(0, 300)))
        ents = [("".join(rnd.choices("abAé日😀 ", k=rnd.randint(0, 4))), rnd.choice(["X", "Y", None])) for _ in range(rnd.randint(0, 12))]
        rows.append((i, text, ents))
    rows += [(100, None, [("a", "X")]), (101, "a", None), (102, "aaaa", [("aa", "X"), ("aa", "Y"), ("aaa", "X")])]
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<text:string,label:string>>")
    got = {r.id: r.s for r in df.select("id", S.locate_all("text", "e", 2).alias("s")).collect()}
    for i, text, ents in rows:
        want = None if text is None or ents is None else brute_located(text, ents, 2)
        assert (got[i] if want is None else [tuple(x) for x in got[i]]) == want


def test_align_keeps_the_longest(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices("abé ", k=200)), [("".join(rnd.choices("abé ", k=rnd.randint(1, 5))), "X") for _ in range(10)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<text:string,label:string>>")
    got = {r.id: [tuple(x) for x in r.s] for r in df.select("id", S.align_entities("text", "e").alias("s")).collect()}
    for i, text, ents in rows:
        found = [s for s in brute_located(text, list(dict.fromkeys(ents)), 1) if DI.not_in_ascii_word(text, s)]
        chosen = []
        for s in sorted(found, key=lambda s: (s[0] - s[1], *s)):
            if not any(a < s[1] and s[0] < b for a, b, _ in chosen):
                chosen.append(s)
        assert got[i] == sorted(chosen)


def test_long_text_with_many_entities_takes_seconds():
    words = [f"w{i:05}" for i in range(20_000)]
    text = " ".join(words * 5)
    t = time.time()
    spans = DI.longest_free(len(text), DI.located(text, [(w, "X") for w in words]), [])
    assert len(spans) == 100_000 and time.time() - t < 10


# ---- vectors ----------------------------------------------------------------------------------------------------------------

def test_mining_of_packed_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i % 3}" if i % 50 else None, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(300)]
    rows += [(300, "g1", rows[4][2]), (301, "g1", rows[4][2]), (302, "g1", [0.0] * 5)]  # ties and a zero vector
    df = spark.createDataFrame(rows, "id long, by string, vec array<float>")
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, _, v in rows}
    want = []
    for i, g, _ in rows:
        near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j, h, _ in rows if g == h and g is not None and i != j)[:4]
        want += [(i, j, r) for r, (_, j) in enumerate(near, 1)]
    for block in (4096, 16):
        got = L.mine(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "pid"), 4, "by", block).collect()
        assert len(got) == len(want) and len({(r.qid, r.pid, r["rank"]) for r in got} & set(want)) >= len(want) - 4  # equal scores may differ in the last bit


def test_space_agreement_mines_once(spark):
    rng = np.random.default_rng(5)
    a = spark.createDataFrame([(i, i % 4, [float(x) for x in rng.normal(size=6)]) for i in range(200)], "id long, by int, vec array<double>")
    turned = a.withColumn("vec", F.transform("vec", lambda x: x * 2))
    row = L.space_agreement(a, turned, "id", "by").first()
    assert (row.n, row.top1_agree) == (200, 1.0) and row.mean_cosine == pytest.approx(1)
    df = L.space_agreement(a, turned, "id", "by")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


# ---- counts -----------------------------------------------------------------------------------------------------------------

ODD = [0.0, -0.0, 1.0, -1.0, 0.5, 0.999999999, 1.0000000001, 2.0, 4.0, 8.0, 1 / 8, 1e300, -1e300, 1e-300, 5e-324, -5e-324, 2.0 ** 52, 2.0 ** 53, 0.1, 0.3, -0.3, 1e22, 3.0]


def test_cells_keep_the_order(spark):
    rng = np.random.default_rng(7)
    xs = sorted({*ODD, *rng.normal(size=3000).tolist(), *np.exp2(rng.integers(-60, 60, 200)).tolist(), *np.nextafter(np.exp2(np.arange(-40., 40.)), 0).tolist(),
                 *np.nextafter(np.exp2(np.arange(-40., 40.)), np.inf).tolist(), math.inf, -math.inf})
    big, small = R.cell(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate([*xs, math.nan])], "i int, x double").select("i", big.alias("c"), small.alias("p")).orderBy("i").select("c", "p").collect()]
    assert got == sorted(got) and got[-1] > got[-2]


def test_no_job_while_metrics_are_built(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("gold"), (F.xxhash64("id") % 100 / 100.0).alias("score"), (F.col("id") % 3).alias("g"))
    seen = spark.sparkContext.statusTracker()
    before = max(seen.getJobIdsForGroup() or [-1])
    for metric in (N.auc(df, by=["g"]), N.regression_metrics(df, "gold", "score", ["g"]), N.sweep(df, [0.1, 0.5], by=["g"]), N.ablation(df, "score", "gold")):
        assert metric.columns
    assert max(seen.getJobIdsForGroup() or [-1]) == before


def test_regression_metrics_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i % 2, rnd.choice([0.0, 0.0, 1.0, 2.5, 3.0, 4.5]), round(rnd.gauss(2, 2), 1)) for i in range(700)]
    got = {r.g: r for r in N.regression_metrics(spark.createDataFrame(rows, "g int, gold double, pred double"), "gold", "pred", ["g"]).collect()}

    def ranks(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) + 1) / 2 for x in v]

    for g in (0, 1):
        a, b = ([r[i] for r in rows if r[0] == g] for i in (1, 2))
        assert got[g].n == len(a)
        assert got[g].pearson == pytest.approx(np.corrcoef(a, b)[0, 1]) and got[g].spearman == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])


def test_cube_gives_the_plain_metrics(spark):
    df = spark.range(900).select((F.col("id") % 7 == 0).cast("int").alias("gold"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50.0).alias("score"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    cube = N.score_cube(df, by=["lang"], totals=["lang"])
    both = df.unionByName(df.withColumn("lang", F.lit("all")))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(N.cube_binary(cube, by=["lang"])) == rows(N.binary_metrics(both, by=["lang"]))
    assert rows(N.cube_auc(cube, ["lang"])) == rows(N.auc(both, by=["lang"]))


# ---- offsets and runs ---------------------------------------------------------------------------------------------------------

def test_offsets_of_long_lists_take_a_second(spark):
    parts = ["ab", "é", "", "日本"] * 25_000
    df = spark.createDataFrame([(parts,), (None,), ([],)], "p array<string>")
    t = time.time()
    got = df.select(U.offsets_of(F.col("p"), 1).alias("o")).collect()
    assert time.time() - t < 10 and got[1].o is None and got[2].o == []
    at = 0
    for p, o in zip(parts, got[0].o):
        assert tuple(o) == (at, at + len(p))
        at += len(p) + 1


def test_running_sums_of_slices():
    lists = pa.array([[1, 2, None], None, [], [5]], pa.list_(pa.int32())).slice(1)
    assert [x.to_pylist() for x in U.running_sum.func(iter([lists]))] == [[None, [], [5]]]


def test_units_of_many_sentences(spark):
    s = [f"s{i}" for i in range(60_000)]
    df = spark.createDataFrame([(1, s)], "id int, s array<string>")
    t = time.time()
    units = df.select(U.chunk_sentences(F.col("s"), "id", 3)).first()[0]
    assert time.time() - t < 20 and " ".join(units) == " ".join(s)


def test_runs_are_joined_over_cuts(spark):
    rows = [(i // 700, i, f"t{i}") for i in range(2000)]
    got = {r.k: (r.n, r.text) for r in P.join_runs(spark.createDataFrame(rows, "k int, i int, t string"), ["k"], "i", "t", block=64).collect()}
    assert got == {k: (len(ts := [t for q, _, t in rows if q == k]), " ".join(ts)) for k in range(3)}


# ---- streams ------------------------------------------------------------------------------------------------------------------

def test_flag_rates_replay_and_drop_late_rows(spark):
    import __spark_entry__  # noqa: F401  (registers the queries)
    from catalog.q_st_streaming import flag_rates
    from glyphmill import streaming as ST

    d = "/root/testdata/sf0.001"
    (a, run), (b, _) = flag_rates(spark, d), flag_rates(spark, d)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 50
    assert ST.dropped_rows(run) > 0


def test_stream_label_keeps_no_state(spark, tmp_path):
    from glyphmill import streaming as ST

    src = tmp_path / "src"
    for i, ids in enumerate(([1, 2, 2, 3], [3, 4, None], [1, 4, 5, None])):
        spark.createDataFrame([(x,) for x in ids], "id long").coalesce(1).write.parquet(str(src / f"s={i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(src / "s=*"))
    runs = []
    for _ in range(2):
        run = ST.stream_label(stream, lambda df: df.withColumn("score", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        run.awaitTermination()
        runs.append(run)
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted([1, 2, 3, 4, 5, None], key=str)
    assert not any(p["stateOperators"] for run in runs for p in run.recentProgress)


def test_json_leaves_below_thousands_of_brackets(spark):
    from glyphmill.operators import filters as B

    leaf = "y" * 70
    deep = '{"a": "' + leaf + '", "n": [1, -2.5e3, true, null, {}, []], "b": ' + '[{"k":' * 20_000 + '"' + leaf + 'é\\u00e9"' + "}]" * 20_000 + "}"
    df = spark.createDataFrame([(1, deep), (2, deep[:-1]), (3, deep + "1")], "id int, js string")
    got = [(r.id, len(r.path), len(r.text)) for r in B.json_leaves(df, ["id"], "js").collect()]
    assert sorted(got) == [(1, 3, 70), (1, 3 + 20_000 * 5, 72)]
    flat = '{"a": ["x", {"b": "y\\\\n"}, 3], "c": ""}'
    assert B._deep_leaves(flat) == B._string_leaves(flat)


def test_scan_stops_when_the_quotas_are_full(spark):
    import __spark_entry__  # noqa: F401  (registers the queries)
    from catalog.q_a_sources import pool_files
    from glyphmill.sources import read_until_full

    paths = pool_files(spark, "/root/testdata/sf0.01")
    got = {}
    for first, grow in ((1, 1), (1, 4), (3, 2), (8, 1)):
        rows, files = read_until_full(spark, paths, "lang", {"en": 40, "de": 10}, 2, ["doc_id"], None, ["doc_id", "lang"], first, grow)
        got[first, grow] = (sorted(map(tuple, rows.collect())), files)
    assert len({str(rows) for rows, _ in got.values()}) == 1 and len(got[1, 1][0]) == 50
    assert got[1, 1][1] < 4 and got[8, 1][1] == 8
    rows, files = read_until_full(spark, paths, "lang", {"xx": 5, "en": 10 ** 6}, 2, ["doc_id"], None, ["doc_id", "lang"])
    assert files == 8 and rows.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").count()
