"""Writers and build reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, cols: list[str], split: str = "split") -> None:
    """One parquet folder per split with a fixed column list.

    Rows are not repartitioned by split: that would send a whole split through one task."""
    df.select(*cols, split).write.mode("overwrite").partitionBy(split).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def build_report(df: DataFrame, dims: list[str], label: str | None = None) -> DataFrame:
    """Counts (and mean label) per value of every dimension plus the total: one pass with grouping sets."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.avg(label).alias("mean_label"))
    sets = [[F.col(d)] for d in dims] + [[]]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(*aggs, F.grouping_id().alias("_gid"))
    # grouping_id has a 0 bit for the dimension that is kept
    full = (1 << len(dims)) - 1
    dim, value = F.lit("total"), F.lit("")
    for i, d in enumerate(dims):
        kept = full ^ (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("_gid") == kept, d).otherwise(dim)
        value = F.when(F.col("_gid") == kept, F.coalesce(F.col(d).cast("string"), F.lit("null"))).otherwise(value)
    return g.select(dim.alias("dim"), value.alias("value"), "n", *(["mean_label"] if label else []))


def append_missing(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id was not written yet (append the result to the same table)."""
    return df.join(done.select(key).distinct(), key, "left_anti")
