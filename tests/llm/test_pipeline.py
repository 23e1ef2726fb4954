"""The registered queries and the pipeline over the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from glyphmill.llm.queries import ORACLES, QUERIES, public_tokenizer
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import brute_hits, brute_targets
from tools_check import TABLES, canon

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cur = con.execute(ORACLES[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_document(spark, name):
    assert QUERIES[name](spark, D).count() == spark.read.parquet(f"{D}/documents.parquet").count()


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, D)
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity_knn"](spark, D).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, p in scored.items() if not p}
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in clean.collect())
    near = stages["simhash"](spark, clean, D)
    stay, _ = brute_kept(rows)
    rows = [r for r in rows if r[0] in set(stay)]
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [i for i, _, _ in rows]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    kept = stages["decontamination"](spark, near, D)
    rows = [r for r in rows if not brute_hits(r[1], items)[4]]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _ in rows]
    mixed = stages["mix"](spark, kept, D)
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    sizes, taken, n = {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for i, t, s in got:
        taken[s] = taken.get(s, 0) + len(t.split())
        n[i] = n.get(i, 0) + 1
    largest = {s: max(len(t.split()) for _, t, x in rows if x == s) for s in sizes}
    assert mixed.columns == docs.columns and set(got) <= set(rows) and max(n.values()) <= 2
    assert all(abs(taken.get(s, 0) - t) <= largest[s] for s, t in brute_targets(sizes, [5, 2, 1], 1.5, 2.0).items())
    tok, start = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json")), 0
    index = sorted(map(tuple, stages["tokens"](spark, mixed, D).collect()), key=lambda r: r[1])
    assert len(index) == len(got)
    for row, (i, t, _) in zip(index, got):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert row == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_and_empty_tables(spark):
    assert corpus_pipeline.run(spark, D).count() > 100
    none = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, D).count() == 0
