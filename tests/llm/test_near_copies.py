"""Near copies against brute-force Jaccard similarity, and planted ones through the pipeline's stages."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import near_copies

from .test_operators import some_docs, table

D = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Sorted ids that stay, and the number of rows that stay."""
    sets = []
    for _, t, *_ in rows:
        ws = re.sub(b"[A-Z]", lambda c: c[0].lower(), (t or "").encode()).split()
        sets.append(frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    root = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    for a in list(root):
        for b in root:
            if root[a] != root[b] and 5 * len(a & b) >= 4 * len(a | b) > 0:
                low, high = sorted((root[a], root[b]))
                root.update({s: low for s, r in root.items() if r == high})
    ids = {}
    for (i, *_), s in zip(rows, sets):
        ids.setdefault(root[s], []).append(i)
    return sorted(min(x for x in v if x is not None) for v in ids.values() if any(x is not None for x in v)), len(ids)


def edited(words, n, rnd):
    out = list(words)
    for at in rnd.sample(range(6, len(words) - 6, 6), n):
        out[at] = f"new{rnd.random()}"
    return " ".join(out)


def planted():
    rnd, rows = random.Random(3), some_docs(40)
    for b in range(12):
        words = [f"b{b}x{rnd.randrange(10 ** 6)}" for _ in range(200)]
        rows += [(1000 + 10 * b + i, edited(words, n, rnd)) for i, n in enumerate((0, 1, 2, 4, 6, 9))]
    return rows


def ids(df):
    got = [r["doc_id"] for r in df.select("doc_id").collect()]
    return sorted(i for i in got if i is not None), len(got)


def test_planted_near_copies_leave_the_pipeline(spark):
    docs = table(spark, planted())
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, D)
    assert got.columns == docs.columns and ids(got) == brute_kept(planted())
    assert [i for i in ids(got)[0] if i >= 1000][:3] == [1000, 1004, 1005]  # four edits of 200 words: 0.81; six: 0.73


def test_candidates_are_verified_and_compared_in_parts(spark, monkeypatch):
    docs = table(spark, planted())
    near = near_copies.marks(docs).select("id", "h", F.lit(1).cast("long").alias("bucket"))
    for shard in (1024, 10):
        monkeypatch.setattr(near_copies, "SHARD", shard)
        assert ids(near_copies.one_per_group(docs, near)) == brute_kept(planted())
    assert near_copies.one_per_group(docs.limit(0)).count() == 0
