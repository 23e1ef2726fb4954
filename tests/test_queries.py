"""Registry checks and a sample of queries against their SQL twins (tools_check.py runs them all)."""

import duckdb
import pytest

import catalog
from tools_check import TABLES, canon

D = "/root/testdata/sf0.001"
SAMPLE = ["a13_build_report", "b16_translation_reason", "c9_ranking_rows", "d2a_conflicts_and_dedup", "e12_run_ids", "f2_sentence_except", "g3_top_units_by_paragraph",
          "h20_clean_spans", "i7_insert_payloads", "j11_claim_pairs", "l5_subsample", "n8_tune_thresholds", "st3_stream_decontaminate", "st4_stream_quota", "w1_training_table"]

catalog.load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def test_every_sql_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 250


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    cur = con.execute(catalog.ORACLES[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [c[0] for c in cur.description])


def test_flagship_plan_prunes_columns(spark):
    plan = catalog.QUERIES["a1_parquet_scan"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,200)]" in plan and "ReadSchema: struct<lang:string,n_chars:bigint>" in plan


def test_training_table_reads_each_text_table_twice_at_most(spark):
    """The rules run on a narrow key table that was written before; the final plan scans the documents once more."""
    plan = catalog.QUERIES["w1_training_table"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") <= 1 and plan.count("Relation") <= 8


def test_mining_stands_once_in_the_retrieval_report(spark):
    plan = catalog.QUERIES["w10_retrieval_report"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan
