"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube_mix, fertility, fm_quality, hard_negatives, language_id, line_windows, merkle, sharding, simhash_bk, token_files, toxicity, url_lm, winnowing
from .common import scratch, table

#: Parameters of the contracts, shared with the pipeline.
MIX = {"weights": [5, 2, 1], "share": 1.5, "cap": 2.0}
NEAR = {"n": 3, "radius": 3}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_virtual_slots")
def op4(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    rows = sharding.with_slot(table(spark, sf_dir, "documents"))
    weights, path = sharding.slot_weights(rows), scratch(spark, "slot-map")
    sharding.store_map(spark, path, 1, sharding.first_map(weights, shards), weights)
    return sharding.digest(sharding.assign(rows, sharding.load_map(spark, path, 1)))


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write(docs, folder, public_tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, table(spark, sf_dir, "documents"))


@query("op6_winnowing", winnowing.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_cube_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents"), **MIX).drop("id", "h")


@query("op9_simhash_bk")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"), **NEAR)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~toxicity.held_out(F.col("doc_id"), 5, 0))


@query("op2_toxicity_knn")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity_model(spark, docs, sf_dir))


@query("op5_fm_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fm_quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~toxicity.held_out(F.col("doc_id"), 4, 2))
    return fm_quality.digest(docs, model)


@query("op8_fertility")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fertility.judge(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "evenness", "outside")


@query("op1_url_lm", url_lm.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages"))


@query("op3_line_windows", line_windows.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), n_removed="n_removed")


@query("op11_merkle_manifest", merkle.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", hard_negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.digest(docs, language_id.fit(docs, ~toxicity.held_out(F.col("doc_id"), 4, 2)))
