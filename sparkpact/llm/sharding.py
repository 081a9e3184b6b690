"""Sharding by fixed virtual slots.

Records hash into VIRTUAL_SLOTS slots by doc_id and text. Rows that agree in both also take their place in the input,
so neither a text nor a row that a third of all rows repeat can weigh a slot down. Bytes are summed by slot. A
slot-to-shard map is kept as a versioned table under a directory: version 1 deals the slots out in turn, and each
rebalancing reads the newest version, moves whole slots from loaded to light shards, and writes the next one where
anything moved. Versions are never overwritten. Rows never move but with their slot.

All work on rows is DataFrame operations; only tables of a row a slot, whose number is fixed, reach the driver.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch

VIRTUAL_SLOTS = 4096
TOLERANCE = 0.001


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (hash of doc_id and text), place (in the input). A null text counts as empty."""
    raw = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long"), raw).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )


def with_slots(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``rows`` with their virtual slot: by key, and by place too where the key is repeated."""
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("again"))
    met = rows.join(again.hint("merge"), "key", "left")
    own = F.when(F.col("again"), F.xxhash64("key", "place")).otherwise(F.xxhash64("key"))
    return met.select("doc_id", "size", "text_crc32", F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n: sums by slot, combined in each task before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def initial_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(slot_map: list[int], loads: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Edit a map: move or swap whole slots until every shard is within ``tolerance`` of the mean, or none helps.

    Slots that need not move keep their shard; those of shards that are no more are dealt out in turn. Deterministic:
    ties go to the smaller number.
    """
    edited, held, sums = [s if s < shards else k % shards for k, s in enumerate(slot_map)], [set() for _ in range(shards)], [0] * shards
    for slot, shard in enumerate(edited):
        held[shard].add(slot)
        sums[shard] += loads[slot]
    mean = sum(sums) / shards
    for _ in range(4 * len(edited)):
        high, low = max(range(shards), key=lambda s: (sums[s], -s)), min(range(shards), key=lambda s: (sums[s], s))
        gap = sums[high] - sums[low]
        if gap <= tolerance * mean:
            break
        # one slot whose move leaves the two shards closest; else the best swap with a slot of the light shard
        slot = min((s for s in held[high] if 0 < loads[s] < gap), key=lambda s: (abs(gap - 2 * loads[s]), s), default=None)
        back, gain = None, (gap - abs(gap - 2 * loads[slot])) if slot is not None else 0
        if gain < gap / 2:
            light = sorted((loads[s], s) for s in held[low])
            for s in sorted(held[high]):
                want = loads[s] - gap / 2
                at = _nearest(light, want)
                if at is not None and (better := gap - abs(gap - 2 * (loads[s] - loads[at]))) > gain:
                    slot, back, gain = s, at, better
        if slot is None or gain <= 0:
            break
        for s, a, b in ((slot, high, low), (back, low, high)):
            if s is not None:
                edited[s] = b
                held[a].remove(s)
                held[b].add(s)
                sums[a] -= loads[s]
                sums[b] += loads[s]
    return edited


def _nearest(light: list[tuple[int, int]], want: float):
    at = bisect.bisect_left(light, (want, -1))
    near = [light[k] for k in (at - 1, at) if 0 <= k < len(light)]
    return min(near, key=lambda x: (abs(x[0] - want), x[1]))[1] if near else None


class SlotMap:
    """Versions of the slot-to-shard map as Parquet tables ``version=N`` under one directory, numbered from 1."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def newest(self) -> int:
        """0 where there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        whole = [n for n in names if n.startswith("version=") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}/_SUCCESS"))]
        return max((int(n[8:]) for n in whole), default=0)

    def write(self, version: int, shard_of: list[int]) -> None:
        listed = ",".join(map(str, shard_of))
        rows = self.spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("virtual_slot", "shard"))
        rows.select("virtual_slot", F.col("shard").cast("int")).coalesce(1).write.parquet(f"{self.base}/version={version}")

    def read(self, version: int) -> list[int]:
        rows = self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.base}/version={version}").collect()
        return [r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)]


def edit_map(store: SlotMap, loads: list[int], shards: int, tolerance: float = TOLERANCE) -> tuple[int, list[int]]:
    """(version, map) after rebalancing the newest version for the bytes of each slot; a map that fits is left alone."""
    version = store.newest()
    if not version:
        store.write(version := 1, initial_map(len(loads), shards))
    current = store.read(version)
    if len(current) != len(loads):
        raise ValueError(f"the map has {len(current)} slots, not {len(loads)}: their number is fixed")
    edited = rebalance(current, loads, shards, tolerance)
    if edited != current:
        store.write(version := version + 1, edited)
    return version, edited


def assign(spark: SparkSession, docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS, map_dir: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    ``slot`` numbers the rows of a shard from 0 without gaps; ``virtual_slot`` is the row's key in the map. ``map_dir``
    (a URI) holds the map's versions; without one, the map is new. Null doc_ids, null texts and repeated rows are
    placed like any others. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(spark, "sharding")
    rows = scratch.write(with_slots(scratch.write(records(docs), "rows"), slots), "slotted")
    loads, counts = [0] * slots, [0] * slots
    for r in slot_bytes(rows).collect():  # a row a slot
        loads[r.virtual_slot], counts[r.virtual_slot] = r.bytes, r.n
    version, shard_of = edit_map(SlotMap(spark, map_dir or scratch.path("map")), loads, shards, tolerance)
    starts, filled = [], [0] * shards
    for s, n in zip(shard_of, counts):
        starts.append(filled[s])
        filled[s] += n
    listed = ",".join(f"{s}:{n}" for s, n in zip(shard_of, starts))
    parts = F.split("e", ":")
    places = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("virtual_slot", "e"))
    places = places.select("virtual_slot", parts[0].cast("int").alias("shard"), parts[1].cast("long").alias("start"))
    # rank within a slot, then add the rows of the shard's earlier slots: no task sorts a whole shard
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("rank", within).join(F.broadcast(places), "virtual_slot")  # a row a slot
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
