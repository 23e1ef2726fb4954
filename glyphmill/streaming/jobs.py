"""Incremental counterparts of the batch jobs; each gives the rows of its batch twin once the input is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import h32, norm_key, text_hash
from ..operators.dedup import _digest, eval_keys
from ..operators.sampling import quota


#: Folders that the ids seen by a labelling stream are dealt into by hash.
BUCKETS = 256


def stream_label(src: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id"):
    """Resumable labelling: each micro-batch scores only ids that were not seen before and writes them once.

    Seen ids are a table beside the checkpoint, dealt into BUCKETS folders by hash, and nothing is kept in memory between batches:
    a batch reads the folders that its own ids fall into, and of each no more than the ids. A batch writes its own folders and
    overwrites them when it is replayed, and counts only what earlier batches saw: a restart neither loses nor doubles rows."""
    seen_path, bucket = f"{checkpoint.rstrip('/')}-seen", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, batch long, bucket int"

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates([key])
        if batch_id:
            own = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
            known = spark.read.schema(schema).parquet(seen_path).where(F.col("bucket").isin(own) & (F.col("batch") < batch_id))
            known = known.select(F.col(key).alias("_seen"))
            rows = rows.join(known, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
        score(rows).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        written = df.select(key).distinct().withColumn("bucket", bucket)
        written.write.mode("overwrite").partitionBy("bucket").parquet(f"{seen_path}/batch={batch_id}")

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_dedup(sdf: DataFrame, text: str, watermark: tuple[str, str] | None) -> DataFrame:
    """First-come survivor per normalised key; state holds 32-byte digests.

    watermark (time column, delay) bounds the state; None keeps every key for ever, which a caller has to ask for."""
    k = sdf.withColumn("_k", text_hash(norm_key(text)))
    if watermark:
        return k.withWatermark(*watermark).dropDuplicatesWithinWatermark(["_k"]).drop("_k")
    return k.dropDuplicates(["_k"]).drop("_k")


def stream_decontaminate(sdf: DataFrame, text: str, evals: DataFrame, eval_text: str = "text") -> DataFrame:
    """Stream rows whose normalised text is in no evaluation set (stream-static anti join)."""
    k = sdf.withColumn("_k", _digest([norm_key(text)]))
    return k.join(eval_keys(evals, eval_text), "_k", "left_anti").drop("_k")


def stream_quota(src: DataFrame, by: str, n: int, key: str, sink: str, checkpoint: str):
    """The first n rows of every group, by micro-batch and inside one by hash of the key; exactly n if as many arrive.

    A batch is cut to n rows per group by bucket counts, so a group that holds most of the stream is many small tasks. What is
    still missing comes from a ledger of one row per group and batch; only batches before the own count, so replays agree."""
    ledger_schema = f"`{by}` {src.schema[by].dataType.simpleString()}, taken long, batch int"

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        some = quota(df, [by], n, "stream", [key])
        if batch_id:
            done = spark.read.schema(ledger_schema).parquet(f"{sink}/ledger").where(F.col("batch") < batch_id)
            done = done.groupBy(F.col(by).alias("_by")).agg(F.sum("taken").alias("_taken"))
            rank = F.row_number().over(Window.partitionBy(by).orderBy(h32("stream", key), key))  # n rows per group at most
            some = some.withColumn("_rank", rank).join(done, F.col(by).eqNullSafe(F.col("_by")), "left")
            some = some.where(F.col("_rank") <= n - F.coalesce("_taken", F.lit(0))).drop("_rank", "_by", "_taken")
        rows, path = some.select(*df.columns), f"{sink}/rows/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        kept = spark.read.schema(rows.schema).parquet(path)
        kept.groupBy(by).agg(F.count(F.lit(1)).alias("taken")).write.mode("overwrite").parquet(f"{sink}/ledger/batch={batch_id}")

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_flag_rate(sdf: DataFrame, time: str, width: str, delay: str, by: list[str], flag: Column) -> DataFrame:
    """(start, end, by, n, flagged, rate): rows and flagged rows per event-time window and group of a scored stream.

    For append output: a window is emitted once, when rows `delay` later than its end have been seen; its state goes with it, so
    state holds open windows only. Rows that come after that are dropped, and `dropped_rows` tells how many such updates there were."""
    hit = F.coalesce(flag.cast("int"), F.lit(0))
    g = sdf.withWatermark(time, delay).groupBy(F.window(time, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("flagged"))
    return g.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"))


def dropped_rows(query) -> int:
    """Late rows that a finished or running query has dropped, as far as its kept progress reports say (per group and task)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
