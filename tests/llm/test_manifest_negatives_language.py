"""Merkle manifest, hard negatives and language identification against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import hard_negatives, language_id, merkle, toxicity

# ---- op11 -----------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, idx long, h string, path string, end string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes):
    """(root, siblings before and after of every leaf, level by level)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p - p % 8
            paths[i].append((nodes[run:p], nodes[p + 1:run + 8]))
            place[i] = p // 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute_manifest(rows):
    """Sorted digests of every row."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = brute_leaf(doc_id, text, lang, source, n_chars)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        changed = brute_leaf(doc_id, text and text.translate(LOWER), lang, source, n_chars) if bad else leaf
        groups[lang].append((doc_id is not None, doc_id, leaf, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees.append(brute_tree([r[2] for r in groups[g]]))
    root, over = brute_tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(names, trees, over):
        for (_, doc_id, leaf, changed), path in zip(groups[g], paths):
            h = changed
            for before, after in path + above:
                h = sha("".join([*before, h, *after]))
            proof = sha("".join("".join(b + a) for b, a in path + above))
            out.append((doc_id, leaf, subroot, root, proof, h, h == root))
    return sorted(out, key=str)


def manifest_rows(sizes, seed=1):
    rnd = random.Random(seed)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 5003, rnd.choice(["Some Text", "", "ß ü é", None, "lower only", "X" * 2000]), lang, rnd.choice(["a", None, "ü"]), rnd.choice([None, 3, 10])))
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 8}, {"a": 9, None: 1}, {"de": 64, "en": 65, "": 3, "é": 512, "z": 513, None: 7}, {"hot": 1200, **{f"l{i:03}": 2 for i in range(70)}}])
def test_merkle_equals_brute_force(spark, sizes):
    rows = manifest_rows(sizes)
    rows += [(None, "no id", "a", None, None), (None, None, None, None, None), rows[0], rows[0], (None, "no id", "a", None, None)]
    docs = spark.createDataFrame([(*r, "g", 1, "h", "p", "e") for r in rows], DOCS).repartition(5)
    got = merkle.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_merkle_proofs_and_other_groups(spark):
    rows = manifest_rows({"a": 600, "b": 20})
    docs = spark.createDataFrame([(*r, "g", 1, "h", "p", "e") for r in rows], DOCS)
    m = merkle.Manifest(docs, ["text", "doc_id"], "g", "n_chars", {"h": F.col("doc_id")})
    proofs = m.proofs().withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(proofs) == len(rows) and {r["again"] for r in proofs} == {m.root().first()["root"]}
    assert len(m.levels) == 3 and m.levels[1].count() < 6  # only every third level is stored


def test_merkle_single_row_and_empty(spark):
    one = spark.createDataFrame([(5, "T", None, None, None, "g", 1, "h", "p", "e")], DOCS)
    row = merkle.digest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == brute_leaf(5, "T", None, None, None) and row["proof_sha256"] == sha("")
    assert merkle.digest(one.limit(0)).count() == 0


# ---- op12 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, key long, score string, rank int"


def brute_negatives(rows, positives=5, negatives=3):
    some = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in some:
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in some if j != i and len(v) == len(w)), key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            fits = [r for r in scored if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, dim, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dim))
    return [(i, int(i % 4), [float(x) for x in np.float32(centres[(i * 3) % 4] + rng.normal(0, spread, dim))]) for i in range(n)]


def mined(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS).repartition(parts)
    return sorted(map(tuple, hard_negatives.digest(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("n, dim", [(600, 64), (420, 7), (300, 1), (200, 130)])
def test_hard_negatives_equal_brute_force(spark, n, dim):
    rows = vectors(n, dim)
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and (want or dim == 1)


def test_hard_negatives_edges(spark):
    rows = vectors(320, 16)
    rows += [(None, 1, rows[3][2]), (1000, None, rows[3][2]), (1050, 2, None), (1100, 2, [*rows[3][2][:-1], None]), (1150, 2, [*rows[3][2][:-1], float("nan")]),
             (1200, 2, [*rows[3][2][:-1], float("inf")]), (1250, 3, []), (1251, 3, []), (1252, 4, []), (1300, 1, rows[3][2][:5]), (1301, 1, rows[3][2][:5]), (1302, 2, rows[4][2][:5])]
    rows += [rows[100], rows[50], rows[33]] + [(2000 + i, i % 3, rows[7][2]) for i in range(40)]  # repeated rows, an anchor among them, and ties
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and any(r[0] == 2000 for r in want)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_hard_negatives_of_large_numbers(spark):
    rows = [(i, y, [x * 2.0 ** 21 for x in v]) for i, y, v in vectors(120, 8)]  # products beyond the integers that doubles hold
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and max(abs(r[4]) for r in want) > 2 ** 53


def test_small_sets_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SET", 2)
    rows = vectors(500, 20)
    assert mined(spark, rows, 7) == brute_negatives(rows)


def test_summaries_bound_products():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 16, 64, 100):
        x, y = rng.integers(-300, 300, (40, dim)).astype("float64"), rng.integers(-300, 300, (30, dim)).astype("float64")
        a, b, first, exact, widths = hard_negatives.summaries(x), hard_negatives.summaries(y), 0, x @ y.T, []
        for s in hard_negatives.levels_of(dim):
            middle, reach = a[:, first:first + s] @ b[:, first:first + s].T, a[:, first + s:first + 2 * s] @ b[:, first + s:first + 2 * s].T
            assert (np.abs(exact - middle) <= reach + 1e-6).all()
            widths.append(reach.mean())
            first += 2 * s
        assert widths == sorted(widths, reverse=True)  # finer segments bound more tightly


def test_bounds_rule_pairs_out():
    rows = vectors(800, 64, spread=0.1)
    x = np.floor(256 * np.array([v for _, _, v in rows]))
    ids, labels = np.arange(800), np.array([y for _, y, _ in rows])
    anchors = [{"key": i, "dim": 64, "kind": "<f8", "ids": ids[i].tobytes(), "labels": labels[i].tobytes(), "vectors": x[i].tobytes(),
                "sums": hard_negatives.summaries(x[i:i + 1]).tobytes(), "lows": [hard_negatives.LEAST], "highs": [hard_negatives.MOST]} for i in range(0, 800, 50)]
    a, scored = hard_negatives.Anchors(anchors, 5, True), []
    whole = a.scores
    a.scores = lambda i, *rest: (scored.append(len(i)), whole(i, *rest))[1]
    for at in range(0, 800, 200):
        part = slice(at, at + 200)
        a.meet(ids[part], labels[part], x[part], hard_negatives.summaries(x[part]))
    assert sum(scored) < 0.6 * 16 * 199  # of the pairs with one label


# ---- op13 -----------------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": "the weather in the city was cold and we went home after work because nothing else was open that evening",
    "de": "das wetter in der stadt war kalt und wir gingen nach der arbeit heim weil sonst nichts mehr offen war",
    "fr": "le temps dans la ville était froid et nous sommes rentrés après le travail car rien d'autre n'était ouvert",
    "ja": "天気は寒かったので仕事のあと家に帰りました ほかに開いている店はありませんでした",
}
TEXTS = "doc_id long, text string, lang string, source string, n_chars long, answer string, score string"


def language_docs(n=400, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SENTENCES))
        rows.append((i, " ".join(rnd.choices(SENTENCES[lang].split(), k=rnd.randint(1, 40))), lang, "s", 1, "a", "b"))
    return rows


@pytest.fixture(scope="module")
def language(spark):
    docs = spark.createDataFrame(language_docs(), TEXTS)
    return docs, language_id.fit(docs, ~toxicity.held_out(F.col("doc_id"), 4, 2))


def test_language_on_held_out_texts(spark, language):
    docs, model = language
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.digest(docs, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held]
    sure = [r["lang_pred"] == truth[r["doc_id"]] for r in held if r["accepted"]]
    assert sum(right) >= 0.95 * len(held) and sum(sure) >= 0.98 * len(sure) and len(sure) >= 0.7 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, language):
    _, model = language
    odd = [(None, None, "en"), (1, "", None), (2, " 12 !! ", "de"), (3, "7", None), (4, "天", None), (5, "x" * 200_000, None), (6, "the city " * 50_000, "en"), (6, "the city " * 50_000, "en"),
           (7, "퟿ é", None), (8, "das wetter in der stadt", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "a", "b") for i, t, lang in odd], TEXTS)
    got = language_id.digest(docs, model).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 and not by[i][0]["accepted"] for i in (None, 1, 2, 3))
    assert by[4][0]["lang_pred"] in SENTENCES and by[6][0]["lang_pred"] == "en" and by[6][0][1:] == by[6][1][1:] and by[8][0]["lang_pred"] == "de"
    kept = language_id.with_language(docs, model, "lang_")
    assert kept.columns == [*docs.columns, "lang_"] and kept.count() == len(odd)
    assert language_id.digest(docs.limit(0), model).count() == 0


def test_language_without_or_with_one_language(spark):
    docs = spark.createDataFrame([(i, "some words", None, "s", 1, "a", "b") for i in range(8)], TEXTS)
    train = ~toxicity.held_out(F.col("doc_id"), 4, 2)
    assert {tuple(r)[2:4] for r in language_id.digest(docs, language_id.fit(docs, train)).collect()} == {("und", 0.0)}
    assert {tuple(r)[2:4] for r in language_id.digest(docs, language_id.fit(docs.withColumn("lang", F.lit("en")), train)).collect()} == {("en", 1.0)}
    two = language_id.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise("de")), train)  # the same words in both: nothing to tell them apart
    assert all(0.3 < r["score"] < 1 for r in language_id.digest(docs, two).collect())


def test_fit_does_not_read_held_out_rows(spark, language):
    docs, model = language
    changed = docs.withColumn("lang", F.when(toxicity.held_out(F.col("doc_id"), 4, 2), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.fit(changed, ~toxicity.held_out(F.col("doc_id"), 4, 2))
    assert again.languages == model.languages and np.allclose(again.table, model.table)


def test_answers_do_not_depend_on_the_batch(language):
    _, model = language
    texts = [r[1] for r in language_docs(60, 9)]
    whole = model.logits(pa.array(texts))
    assert np.allclose(whole, np.concatenate([model.logits(pa.array([t])) for t in texts]))
    bags = [(np.frombuffer(a, "<u2").astype("int64"), np.frombuffer(b, "<f4")) for a, b in language_id._bags(pa.array(texts))]
    assert np.allclose(whole, [model.bias + model.table[:, at] @ n / n.sum() for at, n in bags])
