"""Every operator against a brute-force version on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import cube_mix, fertility, fm_quality, line_windows, sharding, simhash_bk, token_files, toxicity, url_lm, winnowing, words
from glyphmill.llm.common import scratch
from glyphmill.llm.components import components
from glyphmill.llm.queries import public_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, score string, hits string, h string, id string"


def table(spark, rows):
    """rows: (doc_id, text[, source]); the last columns clash with names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", (r[2] if len(r) > 2 else "a"), None, "x", "y", "z", "u", "v") for r in rows], SCHEMA)


def some_docs(n=120, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 7))) for _ in range(300)]
    rows = [(i, "\n".join(" ".join(rnd.choices(vocab, k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 9))), f"s{i % 3}") for i in range(n)]
    rows += [(n, None, None), (n + 1, "", None), (n + 2, " \n\t ", "s1"), (None, "no id at all here", "s2"), (None, None, None), (None, "no id at all here", "s2")]
    rows += [rows[7], rows[7], (n + 5, rows[3][1], "s0"), (n + 6, "word " * 30_000, "s0")]
    return rows


def key(row):
    return tuple((x is not None, x) for x in row)


# ---- op1 ------------------------------------------------------------------------------------------------------------------

def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute_rule(host, path):
    best = None
    for rule, verdict in url_lm.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def brute_urls(urls):
    parts = [split_url(u) for u in urls]
    ruled = [brute_rule(*p) for p in parts]
    count = {v: {} for v in ("allow", "block")}
    for (h, p), (_, v) in zip(parts, ruled):
        t = " " * 4 + h + p
        for i in range(len(h + p)):
            if v:
                for o in range(5):
                    g = t[i + 4 - o:i + 5]
                    count[v][g] = count[v].get(g, 0) + 1

    def prob(v, g):
        p = 1 / url_lm.ALPHABET
        for o in range(5):
            ctx, tail = g[4 - o:4], g[4 - o:]
            seen = [n for x, n in count[v].items() if len(x) == o + 1 and x[:-1] == ctx]
            if seen:
                p = (count[v].get(tail, 0) + len(seen) * p) / (sum(seen) + len(seen))
        return p

    def score(h, p):
        t = " " * 4 + h + p
        r = [math.log(prob("allow", t[i:i + 5]) / prob("block", t[i:i + 5])) for i in range(len(h + p))]
        return sum(r) / len(r) if r else 0.0

    scores = [score(*p) for p in parts]
    mean = lambda v: np.mean([s for s, (_, x), (h, p) in zip(scores, ruled, parts) if x == v and h + p])
    cut = (mean("allow") + mean("block")) / 2
    return [(h, p, r, v or ("block" if s < cut - 1e-9 else "allow"), s) for (h, p), (r, v), s in zip(parts, ruled, scores)]


def test_url_language_model(spark):
    urls = ["http://a.example.net/en/1", "https://x.example.net/de/2?q", "http://b.org/fr/3#x", "http://B.Example.COM/de/4", "http://net/5", "http://c.example.com/en/66", None,
            "no scheme", "http://", "http://x.org", "http://cheap.example.com/pills/1", "https://x.example.net/de/2?q", "http://fakenet/1", "a://b://c/d", "http://é.org/fr/ñ"]
    df = spark.createDataFrame([(i, u, "h", "s", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, score string, n int")
    got = sorted(url_lm.judge(df).collect())
    want = brute_urls(urls)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [w[:4] for w in want]
    assert np.allclose([r["score"] for r in got], [w[4] for w in want], atol=1e-6)
    assert url_lm.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_lm.judge(df.where("page_id in (5, 10)")).collect()} == {"allow"}


def test_url_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = url_lm.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- op2 ------------------------------------------------------------------------------------------------------------------

def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    x = rng.random((700, 40)) * (rng.random((700, 40)) < 0.1)
    x[3] = x[9]
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    doc, term = np.nonzero(x)
    index = toxicity.BlockMaxIndex(doc, term, x[doc, term], 700, 40)
    for i in range(0, 700, 7):
        t = np.flatnonzero(x[i])
        sims = x @ x[i]
        want = sorted(((s, j) for j, s in enumerate(sims) if s > 1e-12), key=lambda p: (-round(p[0], 9), p[1]))[:15]
        sims, found = index.nearest(t, x[i][t], 15)
        assert found.tolist() == [j for _, j in want] and np.allclose(sims, [s for s, _ in want])
        assert i not in index.nearest(t, x[i][t], 15, without=i)[1].tolist()


def labelled(n=400):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        ws, bad = rnd.choices(vocab, k=rnd.randint(5, 60)), rnd.random() < 0.3
        if bad:
            ws[rnd.randrange(len(ws))] = "vilewo" + rnd.choice(["rd", "rds", "rded"])
        rows.append((i, " ".join(ws)))
        labels.append((i, 0 if bad else 1, int(bad), "extra"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    docs = table(spark, rows + [(1000, None), (1001, ""), (None, "vileword"), (1, rows[1][1])])
    known = spark.createDataFrame(labels + [(None, 1, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, score string")
    model = toxicity.fit(docs, known, "toxic", ~toxicity.held_out(F.col("doc_id"), 5, 0))
    got = toxicity.digest(docs, model).collect()
    truth = {i: t for i, _, t, _ in labels}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.97
    assert [r["predicted"] for r in got if r["doc_id"] in (1000, 1001)] == [0, 0]
    assert any("vilewo*" in (r["terms"] or []) and r["neighbours"] for r in got)
    clean = toxicity.clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.digest(docs.limit(0), model).count() == 0
    for nothing in (known.limit(0), known.where("toxic = 1")):
        flat = toxicity.fit(docs, nothing, "toxic", F.lit(True))
        assert len({r["score"] for r in toxicity.digest(docs, flat).collect()}) == 1


@pytest.mark.parametrize("n", [6, 7, 40])
def test_few_examples_have_terms_too(spark, n):
    rows = [(i, f"{'vileword' if i < n else 'meadow'} number {i}") for i in range(2 * n)]
    labels = spark.createDataFrame([(i, int(i < n)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), labels, "toxic", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.digest(table(spark, rows), model).collect()}
    assert min(got[i] for i in range(n)) > 0.5 > max(got[i] for i in range(n, 2 * n))


# ---- op3 ------------------------------------------------------------------------------------------------------------------

def brute_lines(rows):
    seen, gone = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        at = [j for j, s in enumerate(text.split("\n")) if s.strip(" \t\n\x0b\x0c\r")]
        ls = text.split("\n")
        for a in range(max(len(at) - 2, min(len(at), 1))):
            w, pos = tuple(ls[j] for j in at[a:a + 3]), at[a:a + 3]
            if w in seen:
                own = seen[w][1] if seen[w][0] == i else []
                gone.setdefault(i, set()).update(set(pos) - set(own))
            else:
                seen[w] = (i, pos)
    return [(i, t if t is None or i not in gone else "\n".join(s for j, s in enumerate(t.split("\n")) if j not in gone[i]), len(gone.get(i, ()))) for i, t, *_ in rows]


def test_line_windows(spark):
    passage = "one fine line\nsecond line\n\nthird line\nfourth"
    rows = [(5, "head\n" + passage), (2, passage + "\ntail"), (3, "x\nx\nx\nx\nx\nx"), (9, "head\n" + passage), (7, None), (8, ""), (None, passage), (11, "a\nb"), (12, "a\n\nb"), (15, "one line"), (16, "one line"), (17, " \none line\n"), (18, "a"),
            (13, "\n\n\n\n"), (14, "x\nx\nx"), (20, "p\nq\nr\ns\np\nq\nr\nt")] + [(100 + i, f"own {i}\n" + passage) for i in range(30)]
    df = table(spark, rows)
    got = line_windows.dedup(df, n_removed="n_gone")
    assert got.columns == [*df.columns, "n_gone"]
    assert sorted(((r["doc_id"], r["text"], r["n_gone"]) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)
    assert line_windows.dedup(df).columns == df.columns and line_windows.dedup(df.limit(0)).count() == 0


# ---- op4 ------------------------------------------------------------------------------------------------------------------

def test_virtual_slots(spark):
    rows = some_docs(3000)
    docs = table(spark, rows)
    marked = sharding.with_slot(docs)
    weights = sharding.slot_weights(marked)
    first = sharding.first_map(weights, 40)
    path = scratch(spark, "map")
    sharding.store_map(spark, path, 1, first, weights)
    got = sharding.digest(sharding.assign(marked, sharding.load_map(spark, path, 1))).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert len(got) == len(rows)
    loads = {}
    for shard in range(40):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        loads[shard] = sum(r["size"] for r in own)
    rest = sorted(loads.values())[:-1]  # the largest document alone exceeds a shard's share
    assert max(rest) < 1.05 * min(rest)
    # growing and shrinking edit the map: other slots stay
    grown = sharding.rebalance(first, weights, 41)
    moved = [s for s in first if grown[s] != first[s]]
    assert 0 < len(moved) < len(first) / 20 and sum(grown[s] == 40 for s in moved) >= len(moved) / 2
    loads = [sum(weights[s][0] for s in grown if grown[s] == i) for i in range(41)]
    assert sorted(loads)[-2] < 1.1 * min(loads)
    shrunk = sharding.rebalance(grown, weights, 40)
    assert set(shrunk.values()) <= set(range(40))
    sharding.store_map(spark, path, 2, grown, weights)
    assert sharding.load_map(spark, path, 1).count() == sharding.load_map(spark, path, 2).count() == sharding.SLOTS
    empty = sharding.with_slot(docs.limit(0))
    assert sharding.slot_weights(empty)[0] == (0, 0) and sharding.assign(empty, sharding.load_map(spark, path, 1)).count() == 0


# ---- op5 ------------------------------------------------------------------------------------------------------------------

def test_factorisation_machine_identity():
    rows, labels = labelled(200)
    texts = [(t if q else " ".join(w + "!!" for w in t.upper().split())) for (_, t), (_, q, _, _) in zip(rows, labels)]
    stats, doc, bucket = fm_quality.features(pa.array([*texts, None, "", "ä" * 50_000]))
    assert len(stats) == 203 and np.isfinite(stats).all()
    cuts = np.searchsorted(doc, np.arange(201))
    model = fm_quality.Model(0.7)
    model.fit(stats[:200], [bucket[a:b] for a, b in zip(cuts, cuts[1:])], np.array([q for _, q, _, _ in labels], "float32"), epochs=3)
    starts, feature, value = model.inputs(pa.array(texts[:9]))
    got = model.raw(starts, feature, value)[0]
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        f, x = feature[a:b], value[a:b].astype("float64")
        pairs = sum(float(model.v[f[i]] @ model.v[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(float(model.w0) + float(model.w[f] @ x) + pairs - got[k]) < 1e-3
    whole = model.score(pa.array([*texts, None, ""]))
    assert np.allclose(whole[:5], [model.score(pa.array([t]))[0] for t in texts[:5]], atol=1e-5)


def test_quality(spark):
    rows, labels = labelled()
    rows = [(i, t if q else " ".join(w + "!!" for w in t.upper().split())) for (i, t), (_, q, _, _) in zip(rows, labels)]
    docs = table(spark, rows + [(1000, None), (1001, ""), (None, "vileword"), (1, rows[1][1])])
    known = spark.createDataFrame(labels + [(None, 1, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, score string")
    model = fm_quality.fit(docs, known, "quality", ~toxicity.held_out(F.col("doc_id"), 4, 2))
    got = fm_quality.digest(docs, model).collect()
    truth = {i: q for i, q, _, _ in labels}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.97
    assert fm_quality.digest(docs.limit(0), model).count() == 0
    flat = fm_quality.fit(docs, known.limit(0), "quality", F.lit(True))
    assert {r["predicted"] for r in fm_quality.digest(docs, flat).collect()} == {1}


# ---- op6 ------------------------------------------------------------------------------------------------------------------

def brute_hits(text, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    d, hit, found = ws(text), set(), set()
    for name, item in items:
        w = ws(item)
        n = min(13, len(w))
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1 if n else 0):
            if tuple(d[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)


@pytest.mark.parametrize("chunk", [winnowing.CHUNK, 400])
def test_winnowing(spark, chunk, monkeypatch):
    rnd = random.Random(3)
    vocab = ["the", "Of", "a1", "über", "x", "yy", "zed", "it's"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(25)] + [(90, ""), (91, None), (92, "same " * 30), (3, "dup id here")]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"lead {i} words. " + (t or "")[:rnd.randint(10, 200)] + " tail " * rnd.randint(0, 400)) for i, t in items]
    rows += [(200, None), (201, ""), (None, items[5][1]), (203, "same " * 3000), (60, rows[0][1])]
    docs, bench = table(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    monkeypatch.setattr(winnowing, "CHUNK", chunk)
    got = sorted(map(tuple, winnowing.digest(docs, bench).collect()), key=key)
    assert got == sorted(((i, *brute_hits(t, items)) for i, t in rows), key=key)
    clean = winnowing.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not g[5] for g in got)
    assert winnowing.digest(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in winnowing.digest(docs, bench.limit(0)).collect()} == {0}


def test_hits_of_repeated_words_are_linear():
    started = time.time()
    assert winnowing.extend("same " * 200_000, ["same " * 20_000, "other " * 20_000, "same same"], 13) == ([0], [200_000], [0, 2])
    assert time.time() - started < 10


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    whole = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **kw: whole(np.zeros_like(x), **kw) if x.ndim == 1 and kw.get("return_index") else whole(x, **kw))
    got = winnowing._numbered(ids, 3, range(7)).tolist()
    assert got[0] == got[6] and len({*got}) == 6


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared = rng.integers(0, 5, 13)
        a, b = (np.concatenate([rng.integers(0, 5, rng.integers(0, 20)), shared, rng.integers(0, 5, rng.integers(0, 20))]) for _ in range(2))
        assert set(winnowing.winnow(a, 7, 7)[1]) & set(winnowing.winnow(b, 7, 7)[1])


# ---- op7 ------------------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full, left = {s: 0.0 for s in names}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return {**goal, **{s: left * weight[s] / total for s in rest}}
        for s in over:
            goal[s] = cap * sizes[s]
            full.add(s)
            left -= goal[s]


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size, pi = rng.lognormal(4, 1, 500).round(), np.full(500, 0.37)
    out = cube_mix.flight(pi, size, rng, last=False)
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-4 and ((out > 0) & (out < 1)).sum() <= 2
    assert set(cube_mix.flight(pi, size, rng, last=True)) <= {0.0, 1.0}
    mean = np.mean([cube_mix.flight(pi[:9], size[:9], rng, last=False) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.03


@pytest.mark.parametrize("block", [cube_mix.BLOCK, 16])
def test_mix(spark, block):
    rows = [(i, " ".join(["w"] * (i % 97 + 1)), ["big", "mid", "small", None, "zero"][0 if i % 3 else i % 4]) for i in range(1500)]
    rows += [(2000, None, "zero"), (2001, "", "zero"), (None, "a b", "mid"), (None, "a b", "mid"), (7, rows[7][1], rows[7][2])]
    docs = table(spark, rows)
    got = cube_mix.mix(docs, [5, 2, 1], block=block).collect()
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + len((t or "").split())
    goal = brute_targets(per, [5, 2, 1], 1.5, 2.0)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    names = {t: s for s, t in goal.items()}
    for target in {r["target"] for r in got}:
        name = min(goal, key=lambda s: abs(goal[s] - target))
        own = [r for r in got if r["target"] == target]
        assert abs(goal[name] - target) < 1e-6 and {r["source_size"] for r in own} == {per[name]} and names
        assert abs(sum(r["taken"] for r in own) - target) <= 100
    again = cube_mix.mix(docs.repartition(7), [5, 2, 1], block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = cube_mix.taken(docs, weights=[5, 2, 1], block=block)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)
    assert cube_mix.mix(docs.limit(0), [5, 2, 1]).count() == 0 and cube_mix.taken(docs.limit(0), weights=[1]).count() == 0


# ---- op8 ------------------------------------------------------------------------------------------------------------------

def brute_base(text):
    t = text or ""
    ws, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = {}
    for i in range(len(ws) - 7):
        wins.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(ws)
    return n, sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_fertility(spark):
    rows = some_docs(300) + [(900, ("one two three four five six seven eight nine ten " * 3).strip()), (901, "a b c d e f g h i j k\n" * 4 + "#<> | *$%& z\u00a0z\u3000y " * 9),
                             (902, "日本語の文章 " * 40), (903, "\x85\x1c odd " * 50)]
    rows += [(950 + i, " ".join(chr(0x10380 + (i + j) % 29) + chr(0x10380 + j * j % 29) for j in range(200))) for i in range(2)]
    got = fertility.judge(table(spark, rows), public_tokenizer("piece_bpe_32k.model")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in names)) for r in got) == sorted((r[0] is not None, r[0] or 0, *brute_base(r[1])) for r in rows)
    assert all(r["kept"] == (not r["base_failed"] and not r["outside"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[902]["outside"] and "byte_share" in by[950]["outside"] and not by[950]["kept"] and by[902]["script"] in ("kana", "han")
    assert sum(r["kept"] for r in got if not r["base_failed"]) > 100
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizer("piece_bpe_32k.model"))
    for i, t, *_ in rows[:20]:
        assert by[i]["n_tokens"] == len(sp.encode(" ".join((t or "").split())))
    assert fertility.judge(table(spark, rows).limit(0), public_tokenizer("piece_bpe_32k.model")).count() == 0


# ---- op9 ------------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text, n=3):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda c: c[0].lower(), (text or "").encode()))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vs}


def test_simhash_near_duplicates(spark):
    rows = some_docs(150)
    long = " ".join(f"w{i}" for i in range(400))
    rows += [(500 + i, long.replace(f"w{i * 9}", "CHANGED", 1).upper()) for i in range(25)]
    docs = table(spark, rows)
    got = simhash_bk.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root, least = brute_components(set(fps)), {}
    for (i, *_), fp in zip(rows, fps):
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    want = [(i, fp, least.get(root[fp])) for (i, *_), fp in zip(rows, fps)]
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    kept = simhash_bk.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(root.values())) and {i for i in ids if i is not None} == set(least.values())
    assert simhash_bk.near_duplicates(docs.limit(0)).count() == 0 and simhash_bk.one_per_group(docs.limit(0)).count() == 0


def test_links_in_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash_bk, "SHARD", 20)
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:10]:
        for _ in range(40):
            y = b
            for _ in range(rnd.randint(0, 6)):
                y ^= 1 << rnd.randrange(64)
            values.add(y)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash_bk.links(spark.createDataFrame(signed, "fp long"))
    assert links.where("a <> b").count() < 60 * len(values)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    classes = {}
    for (v,) in signed:
        classes.setdefault(got.get(v, v), set()).add(v & (1 << 64) - 1)
    want = {}
    for v, r in brute_components(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


# ---- op10 -----------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b", " a b", "a b ", "a\n\nb c", "a \nb", "a\n b", "x\ty z", "it's 'tis  don't\n", "<|endoftext|> a<|endoftext|>b", "a\u00a0b c", "a \u00a0b", "\n", "\n\n a", "é 12 3!! ?",
       "a\r\nb", "日本 語　テ", "\x1c a b", "a\tb c\td", "\u2028 x\u2028y z", " \u0301a b", "😀 a😀b  \n c"]


def test_word_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizer("byte_bpe_50k.json")
    texts = ODD + [t or "" for _, t, *_ in some_docs(80)] + [chr(c) + " a" + chr(c) + "b " + chr(c) for c in range(0x3000) if chr(c).isspace()]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.WordEncoder(path, "uint16")
    for _ in range(2):
        assert [np.frombuffer(b, "uint16").tolist() for b in encoder.encode(pa.array(texts))] == want
    assert encoder.encode(pa.array([None], pa.string())) == [b""]


@pytest.mark.parametrize("dtype", ["uint16", "uint32"])
def test_token_files_round_trip(spark, dtype):
    from tokenizers import Tokenizer

    rows = some_docs(60) + [(300 + i, t) for i, t in enumerate(ODD)]
    folder, path = scratch(spark, "tokens"), public_tokenizer("byte_bpe_50k.json")
    manifest = token_files.write(table(spark, rows), folder, path, dtype=dtype)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    tok, start = Tokenizer.from_file(path), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(got) == len(rows) and sum(m[1] for m in manifest) == len(rows)
    for r, (i, t, *_) in zip(got, ordered):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = scratch(spark, "tokens")
    token_files.write(table(spark, rows).limit(0), empty, path)
    assert token_files.read(spark, empty).count() == 0


def test_words_of_batches():
    texts = pa.array(["A  b\tÉ", None, "", " x ", "y" * 100])
    codes, starts, values = words.split(words.translated(texts.slice(0, 4), words.SPACED_LOWER))
    assert [[values[c] for c in codes[a:b]] for a, b in zip(starts, starts[1:])] == [[b"a", b"b", "É".encode()], [], [], [b"x"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50])], ["t"])
    assert sum(p.num_rows for p in words.pieces(batch, 0)) == 3


def test_memory_of_words_without_spaces_is_bounded():
    vocabulary = fertility.Vocabulary(public_tokenizer("piece_bpe_32k.model"))
    for i in range(30):
        long = [bytes([97 + (i + j) % 26]) * (100 + j) for j in range(20)]
        assert len(vocabulary.encode([*long, b"short", b"word"])) == 22
    assert max(map(len, [*vocabulary.known, *vocabulary.known.old])) <= fertility.REMEMBERED


def test_token_ids_of_distinct_long_words(monkeypatch):
    from tokenizers import Tokenizer

    path, rnd = public_tokenizer("byte_bpe_50k.json"), random.Random(6)
    tok, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, "uint16")
    han = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(1000)) for _ in range(40)]
    texts = [*han, "a\tb c", " lead", "two  blanks", "end ", "x\n\ny", "it's 'q' \u00a0z", "\n", "\n\n", " ", "", "a\nb\nc d", None, "\u00e9\u0301 \u4e2d", "tab\t\tx y"]
    got = encoder.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "uint16").tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
