"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(docs: DataFrame) -> list[Column]:
    """(id, h): the id as text, never null, and a hash of all plain columns; rows that agree in both are copies of one row."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    return [F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")).alias("id"), F.xxhash64(*plain).alias("h")]


def repeat_rows(docs: DataFrame, counts: DataFrame, what: str) -> DataFrame:
    """Rows of docs by counts(id, h, rows, copies), one row per row_key: a key's row comes `copies` times in all, with every column.

    `rows` says how often the key stands in docs. Keys that stand there once need one join; the few others go through a join of
    their own in which equal rows are merged, so the large join never carries them."""
    key, wanted = [fresh(docs, "id"), fresh(docs, "h")], fresh(docs, "copies")
    counts = counts.where("copies > 0").withColumnsRenamed({"id": key[0], "h": key[1], "copies": wanted})
    counts = saved(counts.withColumnRenamed("rows", "rows_of_key"), what)
    many = saved(counts.where("rows_of_key > 1"), what)
    keyed = docs.withColumns({k: c for k, c in zip(key, row_key(docs))})
    once = keyed.join(counts.where("rows_of_key = 1").drop("rows_of_key"), key)
    merged = keyed.join(many.drop("rows_of_key"), key).dropDuplicates(key)
    both = once.unionByName(merged)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(wanted)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(wanted)).drop(wanted)
