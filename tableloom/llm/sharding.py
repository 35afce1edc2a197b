"""Sharding over fixed virtual slots.

Every record is hashed into one of ``N_SLOTS`` virtual slots. Bytes and rows are summed per slot,
and a versioned map says which shard holds a slot: slots go, largest first, to the shard with the
fewest bytes. Rebalancing edits the map: growing by one shard moves slots into the new shard
only. Only the slot table, whose size is fixed, is ever planned on the driver.

Defined results: null text has no bytes (a record still costs ``OVERHEAD``); a null doc_id is
hashed like any value; of repeated rows the n-th has a hash of its own, so that they spread over slots,
the same ones at every run; an empty table gives an empty result and a map over empty slots; other
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, shared_dir

N_SLOTS = 16_384
N_SHARDS = 40
OVERHEAD = 16
MAP_SCHEMA = "virtual_slot int, shard int, first_row long"


def hashed(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), text_crc32, virtual_slot, copy: written once, as sizes are read twice."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("mark"),
    )
    slot = F.pmod(F.xxhash64("mark", "copy"), F.lit(n_slots)).cast("int")
    return materialize(numbered(rows, ["mark"]).withColumn("virtual_slot", slot), "records")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of every slot in use; partial sums are made before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def plan_map(sizes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """slot -> shard: largest slot first, each to the shard that has the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    plan = {}
    for slot in sorted(range(n_slots), key=lambda v: (-sizes.get(v, 0), v)):
        held, shard = heapq.heappop(heap)
        plan[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, 0), shard))
    return plan


def grow_map(plan: dict[int, int], sizes: dict[int, int]) -> dict[int, int]:
    """The map edited for one more shard: slots leave the fullest shards, only into the new one."""
    new = max(plan.values()) + 1
    held: dict[int, int] = {}
    slots: dict[int, list[int]] = {}
    for slot, shard in plan.items():
        held[shard] = held.get(shard, 0) + sizes.get(slot, 0)
        slots.setdefault(shard, []).append(slot)
    for own in slots.values():
        own.sort(key=lambda v: (sizes.get(v, 0), -v))
    goal, got, edited = sum(held.values()) / (new + 1), 0, dict(plan)
    heap = [(-b, s) for s, b in held.items()]
    heapq.heapify(heap)
    while heap:
        full, shard = heapq.heappop(heap)
        while slots[shard]:
            slot = slots[shard].pop()
            size = sizes.get(slot, 0)
            if size and got + size <= goal and -full - size >= goal * 0.98:
                edited[slot], got = new, got + size
                heapq.heappush(heap, (full + size, shard))
                break
    return edited


def save_map(spark: SparkSession, path: str, version: int, plan: dict[int, int], rows: dict[int, int]) -> None:
    """Write one version of the map; ``first_row`` is where a slot's rows begin in their shard."""
    at: dict[int, int] = {}
    table = []
    for slot in sorted(plan):
        shard = plan[slot]
        table.append((slot, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + rows.get(slot, 0)
    spark.createDataFrame(table, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot (the record's place in its shard, gapless from 0).

    The map has ``N_SLOTS`` rows whatever the input, so it is broadcast. Places are counted within
    a virtual slot, so no task ever holds a whole shard.
    """
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "mark", "copy")
    return records.join(F.broadcast(slot_map), "virtual_slot").withColumn(
        "slot", F.col("first_row") + F.row_number().over(place) - 1
    )


def moved(placed: DataFrame, edited_map: DataFrame) -> DataFrame:
    """Adds next_shard: where an edited version of the map holds the record."""
    return placed.join(F.broadcast(edited_map.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot, and next_shard after a rebalancing.

    Version 1 of the map, by which shard and slot are, and version 2, edited for one more shard, are at
    ``map_path``.
    """
    import uuid

    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    records = hashed(docs)
    table = slot_sizes(records).collect()
    sizes, rows = {r[0]: r[1] for r in table}, {r[0]: r[2] for r in table}
    plan = plan_map(sizes, n_shards)
    save_map(spark, path, 1, plan, rows)
    save_map(spark, path, 2, grow_map({r.virtual_slot: r.shard for r in load_map(spark, path, 1).collect()}, sizes), rows)
    return moved(assign(records, load_map(spark, path, 1)), load_map(spark, path, 2)).drop("first_row", "mark", "copy")


def op9_sharding(spark, sf_dir):
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )
