"""Structured Streaming jobs, run to the end of their input and compared with batch SQL."""

from pyspark.sql import functions as F

from glyphmill import streaming as ST

from . import query
from . import sqlkit as q
from .common import docs, scratch, table


def _source(spark, d, parts=4):
    """Documents written as several files and read back as a stream."""
    path = scratch(spark)
    t = docs(spark, d, "doc_id", "lang", "text")
    t.repartition(parts, "doc_id").write.parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drain(spark, sdf, mode="append"):
    out = scratch(spark)
    run = sdf.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


@query("st1_stream_label", "select doc_id, length(text)::BIGINT as score from documents")
def _(spark, d):
    sink, ckpt = scratch(spark), scratch(spark)
    src = _source(spark, d)
    score = lambda df: df.select("doc_id", F.length("text").alias("score"))
    for _ in range(2):  # the second run finds everything done
        ST.stream_label(src, score, sink, ckpt, "doc_id").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "score")


@query("st2_stream_dedup", f"select distinct md5({q.k1('text')}) as h from documents")
def _(spark, d):
    # the surviving row depends on arrival; the set of keys does not
    from glyphmill.functions.keys import norm_key

    return _drain(spark, ST.stream_dedup(_source(spark, d), "text", None)).select(F.md5(norm_key("text")).alias("h"))


@query("st3_stream_decontaminate", f"select doc_id, lang from documents where {q.k1('text')} not in (select {q.k1('text')} from documents where doc_id % 40 = 0)")
def _(spark, d):
    ev = docs(spark, d, "doc_id", "text").where("doc_id % 40 = 0")
    return _drain(spark, ST.stream_decontaminate(_source(spark, d), "text", ev)).select("doc_id", "lang")


@query("st4_stream_quota", "select lang, least(count(*), 60)::BIGINT as n from documents group by lang")
def _(spark, d):
    sink, ckpt = scratch(spark), scratch(spark)
    ST.stream_quota(_source(spark, d), "lang", 60, "doc_id", sink, ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/rows").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, d, steps=4):
    """Events as files in order of time, written one after the other; every 97th event of the first third comes last of all."""
    path, t = scratch(spark), table(spark, d, "events", "event_id", "ts", "event_type", "value")
    # the table's times have no zone: they are taken as UTC, whatever the session's zone
    t = t.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    lo, hi = (r := t.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first())[0], r[1]
    at = (F.unix_micros("ts") - lo) / F.lit(hi - lo + 1)
    late = (F.col("event_id") % 97 == 0) & (at < 1 / 3)
    for step in range(steps + 1):
        part = late if step == steps else ~late & (F.floor(at * steps) == step)
        t.where(part).coalesce(1).write.parquet(f"{path}/step={step}")
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/step=*")


def flag_rates(spark, d):
    """(rows of the windowed flag rate, the finished query)."""
    out = scratch(spark)
    rates = ST.stream_flag_rate(_event_stream(spark, d), "ts", "6 hours", "2 hours", ["event_type"], F.col("value") >= 50)
    run = rates.writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(rates.schema).parquet(out), run


@query("st5_flag_rate", """with m as (select min(ts) as lo, max(ts) as hi from events), e as (select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, value
   from events, m where not (event_id % 97 = 0 and (epoch_us(ts) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo) + 1) < 1 / 3)),
 w as (select start, event_type, count(*) as n, sum((value >= 50)::INT) as flagged from e group by all)
select epoch_us(start) // 1000000 as start, event_type, n::BIGINT as n, flagged::BIGINT as flagged, round(flagged / n, 6) as rate from w, m
where start + interval '6 hours' <= date_trunc('milliseconds', hi) - interval '2 hours'""")
def _(spark, d):
    # a window comes out once the watermark has passed its end; the events that come last are too late for theirs
    return flag_rates(spark, d)[0].select((F.unix_micros("start") / 1000000).cast("bigint").alias("start"), "event_type", "n", "flagged", "rate")
