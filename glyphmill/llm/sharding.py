"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands). Bytes are summed per slot, and a small table, the slot
map, says which shard owns which slot. Rebalancing never rehashes a record: it edits the map and stores it as a new version,
so only the rows of moved slots change shards.

Only narrow columns (id, size, checksum) are shuffled, hashed by slot; a source or a group of copies with a third of all rows
is spread over all slots, because the record's id is hashed. What reaches the driver is one row per slot (`slots` at most).

Cases: a null text has no bytes; a null id is hashed by its size and checksum; repeated rows share a slot and get places of
their own; an empty table gives an empty result and an even map; other columns of the input are not read."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 8192
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def with_slot(docs: DataFrame, overhead: int = 16, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most `slots` entries."""
    got = {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    return {s: got.get(s, (0, 0)) for s in range(slots)}


def first_map(weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Heaviest slot first, always to the lightest shard; ties by slot and shard number."""
    heap = [(0, 0, i) for i in range(shards)]
    out = {}
    for slot, (size, rows) in sorted(weights.items(), key=lambda x: (-x[1][0], x[0])):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, n + rows, shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edit a map: slots of dropped shards go to the lightest shard, then single slots move from the heaviest shard that has a
    fitting one to the lightest, until they differ by `tolerance` of the mean at most. All other slots stay."""
    out = dict(old)
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in sorted(old.items(), key=lambda x: (-weights[x[0]][0], x[0])):
        if shard < shards:
            own[shard].append(slot)
    loads = [sum(weights[s][0] for s in slots) for slots in own]

    def put(slot: int, shard: int) -> None:
        out[slot] = shard
        own[shard].append(slot)
        loads[shard] += weights[slot][0]

    for slot in sorted((s for s, shard in old.items() if shard >= shards), key=lambda s: (-weights[s][0], s)):
        put(slot, min(range(shards), key=lambda i: (loads[i], i)))
    mean, stuck = sum(loads) / shards, set()
    while len(stuck) < shards - 1:
        light = min(range(shards), key=lambda i: (loads[i], i))
        heavy = max((i for i in range(shards) if i not in stuck and i != light), key=lambda i: (loads[i], -i), default=light)
        gap = loads[heavy] - loads[light]
        if gap <= tolerance * mean:
            break
        fitting = [s for s in own[heavy] if 0 < weights[s][0] <= gap / 2]
        if not fitting:
            stuck.add(heavy)
            continue
        slot = max(fitting, key=lambda s: (weights[s][0], -s))
        own[heavy].remove(slot)
        loads[heavy] -= weights[slot][0]
        put(slot, light)
    return out


def store_map(spark: SparkSession, path: str, version: int, mapping: dict[int, int], weights: dict[int, tuple[int, int]]) -> None:
    """Write one version of the map; earlier versions stay readable. A rerun replaces its own version."""
    rows = [(version, s, shard, *weights[s]) for s, shard in sorted(mapping.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v={version}")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with their shard and their place in it, gapless from 0: rows of lower slots of the shard come first, then by id."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return rows.join(F.broadcast(bases), "vslot").withColumn("slot", F.col("base") + place - 1)  # bases: one row per slot


def digest(rows: DataFrame) -> DataFrame:
    none: Column = F.lit(None).cast("int")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
