"""Sharding by fixed virtual slots.

Records are hashed into a few thousand slots, which never change. A slot-to-shard map says which shard
holds which slot. Rebalancing edits the map, and only the slots whose entry changed move; each edit gives
a new version of the map, stored as a table.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconloom.llm.common import shared_dir, table

#: Virtual slots; what the driver holds is bounded by this.
SLOTS = 4096
MAP = T.StructType([T.StructField(n, T.LongType()) for n in ("version", "virtual_slot", "shard")])


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slot i in shard i mod shards."""
    return [i % shards for i in range(slots)]


def rebalance(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """A map with the same slots whose shards carry near-equal loads; few entries differ.

    Entries of shards that no longer exist go to the lightest shard. Then, while it lowers the spread, the
    slot that fits half the gap best goes from the heaviest shard to the lightest, or they swap slots.
    """
    out = list(shard_of)
    total = [0] * shards
    members: list[dict[int, int]] = [{} for _ in range(shards)]
    loose = []
    for slot, s in enumerate(out):
        if s < shards:
            members[s][slot] = load[slot]
            total[s] += load[slot]
        else:
            loose.append(slot)
    light = [(t, s) for s, t in enumerate(total)]
    heapq.heapify(light)
    for slot in sorted(loose, key=lambda i: (-load[i], i)):
        t, s = heapq.heappop(light)
        out[slot], members[s][slot] = s, load[slot]
        total[s] = t + load[slot]
        heapq.heappush(light, (total[s], s))
    for _ in range(4 * len(out)):
        hi = max(range(shards), key=lambda s: (total[s], -s))
        lo = min(range(shards), key=lambda s: (total[s], s))
        gap = total[hi] - total[lo]
        if gap <= 1:
            break
        best = min(((abs(gap - 2 * b), slot, None) for slot, b in members[hi].items() if 0 < b < gap), default=(gap, -1, None))
        if best[0] > gap // 8:  # no single slot fits well: look for a swap
            there = sorted((b, slot) for slot, b in members[lo].items())
            for slot, b in members[hi].items():
                want = b - gap / 2
                i = _nearest(there, want)
                for c, other in there[max(0, i - 1) : i + 1]:
                    if 0 < b - c < gap and abs(gap - 2 * (b - c)) < best[0]:
                        best = (abs(gap - 2 * (b - c)), slot, other)
        if best[1] < 0:
            break
        _move(out, members, total, load, best[1], hi, lo)
        if best[2] is not None:
            _move(out, members, total, load, best[2], lo, hi)
    return out


def _nearest(there: list[tuple[int, int]], want: float) -> int:
    lo, hi = 0, len(there)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if there[mid][0] < want else (lo, mid)
    return lo


def _move(out, members, total, load, slot, a, b) -> None:
    del members[a][slot]
    members[b][slot] = load[slot]
    total[a] -= load[slot]
    total[b] += load[slot]
    out[slot] = b


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Append a version of the map to the table at path."""
    spark.createDataFrame([(version, i, s) for i, s in enumerate(shard_of)], MAP).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot): the latest version, or the one asked for."""
    t = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = t.agg(F.max("version")).collect()[0][0]
    rows = t.filter(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, [r["shard"] for r in rows]


#: Equal rows that one task numbers at a time.
STRETCH = 4096


def _numbered(src: DataFrame) -> DataFrame:
    """src (id, size, text_crc32) with nth, the number of a row among its equals, from 0.

    Equal rows are the same in all that is returned, so they are counted where they are, their counts added up, and that many rows
    made of each: stretches of numbers first, which are dealt out anew, then the numbers of a stretch. No task holds the copies of a row.
    """
    counts = src.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    once = counts.filter(F.col("n") <= STRETCH).withColumn("first", F.lit(0).cast("long"))
    often = counts.filter(F.col("n") > STRETCH).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
    often = often.repartition("id", "text_crc32", "first")
    last = F.least(F.col("n"), F.col("first") + STRETCH) - 1
    return once.unionByName(often).select("id", "size", "text_crc32", F.explode(F.sequence("first", last)).alias("nth"))


def _slot_hash():
    return F.when(F.col("nth") == 0, F.xxhash64("id", "text_crc32")).otherwise(F.xxhash64("id", "text_crc32", "nth"))


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """One row for each row of df: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), virtual_slot, map_version.

    size is the text's UTF-8 bytes plus 1 (a null text has none, its crc32 is that of the empty text).
    slot is the place of the row in its shard, from 0 without gaps. Rows are hashed by id, the text's checksum and, where both
    repeat, their number among the rows that share them; so rows repeated whole, and null ids of one text, are spread over the slots too,
    and sizes stay near equal whatever share of the table they are. Equal texts of different ids are not kept together: a group of copies is spread over the slots, so
    that no shard carries it alone. A map stored at map_path is edited, else one is begun in a new folder: slot i in shard
    i mod shards is version 0, which the bytes of this table then edit to version 1. The law is 'bytes', so the
    slots' bytes decide where rows go, not doc_id and shard count alone. An empty table gives no rows; other columns of df play no part.
    """
    spark = df.sparkSession
    src = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
    )
    base = table(_numbered(src).withColumn("virtual_slot", F.pmod(_slot_hash(), F.lit(slots)).cast("int")), "shard-base")
    load, rows = [0] * slots, [0] * slots
    for r in base.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # as many rows as slots
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    if map_path is None:
        map_path = table_path(spark)
        version, old = 0, initial_map(shards, slots)
        store_map(spark, map_path, 0, old)
    else:
        version, old = load_map(spark, map_path)
    new = rebalance(old, load, shards)
    if new != old:
        version += 1
        store_map(spark, map_path, version, new)
    start, at = [0] * shards, [0] * slots
    for i, s in enumerate(new):
        at[i], start[s] = start[s], start[s] + rows[i]
    schema = "virtual_slot int, shard int, first long"
    placing = F.broadcast(spark.createDataFrame([(i, new[i], at[i]) for i in range(slots)], schema))  # a row for each slot
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size", "nth")) - 1
    return (
        base.withColumn("place", place)
        .join(placing, "virtual_slot")
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")
        )
    )


def table_path(spark: SparkSession) -> str:
    """A new folder for a map in the shared folder."""
    return f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
