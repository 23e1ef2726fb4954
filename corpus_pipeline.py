"""The corpus pipeline: documents pass the stages one after the other, each written as Parquet and read again.

1. toxicity: documents that the nearest-example classifier rejects go;
2. simhash: of each group of texts with a Jaccard similarity of 0.8 or more over five-word shingles the smallest id stays. Candidates
   are what SimHash fingerprints link, and, as those miss many pairs near 0.8, what shares a band of min-hashes; all are verified;
3. decontamination: documents contaminated by the benchmark go;
4. mix: every document is repeated as often as the balanced sample of its source takes it;
5. tokens: the rest becomes token files; their index is the result (doc_id, start, n_tokens, ids_crc32).

All but the last keep the columns of documents. A copy of a repeated document keeps its id, so ids repeat after the mix. A row
without id is kept by stage 2 only if its group has no row with an id; a text that is null passes as empty.
Weights are learned from the rows that reach the first stage and the labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import cube_mix, near_copies, simhash_bk, toxicity, winnowing
from glyphmill.llm.common import saved, table
from glyphmill.llm.queries import MIX, NEAR, token_rows, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = simhash_bk.near_duplicates(docs, **NEAR)
    return near_copies.one_per_group(docs, near.select("id", "h", F.xxhash64("first").alias("bucket")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube_mix.taken(docs, **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_rows(spark, docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("mix", mix), ("tokens", tokens)]
#: SQL has neither the learned scores nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
