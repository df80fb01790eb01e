"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots, which never changes. A small
table maps slots to shards; version 1 deals the slots out evenly, and each
rebalancing writes a next version that moves few slots. Only per-slot totals
(one row a slot) reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_path, staged

SLOTS = 8192


def slot_of(*cols: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot, as even as can be, a function of the two counts only."""
    return [s * shards // slots for s in range(slots)]


def grown_map(old: list[int]) -> list[int]:
    """One more shard: every old shard gives its last slots up to the new one, nothing else moves."""
    shards = max(old) + 1
    want = len(old) // (shards + 1)
    held = [[s for s, x in enumerate(old) if x == k] for k in range(shards)]
    new = list(old)
    for _ in range(want):
        fullest = max(range(shards), key=lambda k: (len(held[k]), -k))
        new[held[fullest].pop()] = shards
    return new


def shrunk_map(old: list[int], shards: int) -> list[int]:
    """Without the shards from `shards` on: their slots go, one after the other, to the shard that has the fewest, the others stay."""
    held = [0] * shards
    for k in old:
        if k < shards:
            held[k] += 1
    new = list(old)
    for s, k in enumerate(old):
        if k >= shards:
            new[s] = min(range(shards), key=lambda x: (held[x], x))
            held[new[s]] += 1
    return new


def rebalanced_map(old: list[int], shards: int, weight: list[int], tolerance: float = 0.0005) -> list[int]:
    """Move, or else swap, the slots that best level the heaviest and the lightest shard until they differ by the tolerance or nothing helps."""
    new = list(old)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for s, k in enumerate(new):
        load[k] += weight[s]
        held[k].append(s)
    mean = max(1, sum(load) / shards)
    for _ in range(8 * len(old)):
        hi, lo = max(range(shards), key=lambda k: (load[k], k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[hi] - load[lo]
        if gap <= tolerance * mean:
            break
        give = min((s for s in held[hi] if 0 < weight[s] < gap), key=lambda s: (abs(gap - 2 * weight[s]), s), default=None)
        take = None
        if give is None or abs(gap - 2 * weight[give]) > 0.5 * gap:
            best = abs(gap - 2 * weight[give]) if give is not None else gap
            there = sorted(held[lo], key=lambda s: (weight[s], s))
            j = 0
            for a in sorted(held[hi], key=lambda s: (weight[s], s)):
                while j < len(there) and gap - 2 * (weight[a] - weight[there[j]]) < 0:
                    j += 1
                for b in there[max(0, j - 1) : j + 1]:
                    if (x := abs(gap - 2 * (weight[a] - weight[b]))) < best:
                        best, give, take = x, a, b
        if give is None:
            break
        for s, a, b in ((give, hi, lo), (take, lo, hi)):
            if s is not None:
                held[a].remove(s)
                held[b].append(s)
                new[s] = b
                load[a] -= weight[s]
                load[b] += weight[s]
    return new


MAP = "version int, slot int, shard int"


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest version of a stored map and the shard of each slot; (0, []) where none is stored. One row a slot reaches the driver."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, []
    table = spark.read.schema(MAP).parquet(path)
    version = table.agg(F.max("version")).first()[0] or 0
    rows = table.where(F.col("version") == version).orderBy("slot").collect()
    return version, [r.shard for r in rows]


def save_map(spark: SparkSession, shard_of: list[int], path: str) -> int:
    """Append the map as the next version (version, slot, shard) to the table at `path`; returns its number."""
    version = newest_map(spark, path)[0] + 1
    spark.createDataFrame([(version, s, k) for s, k in enumerate(shard_of)], MAP).coalesce(1).write.mode("append").parquet(path)
    return version


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, map_path: str | None = None) -> DataFrame:
    """Place every row in a shard; shard sizes in bytes are near equal (law `bytes`).

    Returns doc_id, size (UTF-8 bytes of the text plus `overhead`; null text:
    none), text_crc32, law, shard, slot (the row's place in its shard, gapless
    from 0), grown_shard (null under this law), and the virtual slot. The
    virtual slot hashes id and checksum, so repeated ids with other texts
    spread. Null ids and repeated rows are placed like others, equal rows in
    any order; an empty table gives an empty result.

    The newest map stored at `map_path` is loaded, or a first one stored there
    if there is none; it is edited until the shards are level, growing by one
    shard at a time up to `shards`, or drained of the last ones down to it, and
    each edit is appended as a new version. Another number of slots than the
    stored map has is refused. One writer at a time edits a map.
    Slots that need not move stay where the stored map has them."""
    spark = docs.sparkSession
    map_path = map_path or fresh_path(spark, "slot-map")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = staged(rows.withColumn("virtual_slot", slot_of("doc_id", "text_crc32", slots=slots)), "sized")
    weight, count = [0] * slots, [0] * slots
    for s, w, c in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        weight[s], count[s] = w, c
    stored = newest_map(spark, map_path)[1]
    if stored and len(stored) != slots:
        raise ValueError(f"the map at {map_path} has {len(stored)} slots, not {slots}: slots are fixed, as rows are hashed to them")
    if not stored:
        stored = first_map(shards, slots)
        save_map(spark, stored, map_path)
    if max(stored) + 1 > shards:
        stored = shrunk_map(stored, shards)
    while max(stored) + 1 < shards:
        stored = grown_map(stored)
    save_map(spark, rebalanced_map(stored, shards, weight), map_path)
    version, shard_of = newest_map(spark, map_path)
    current = spark.read.schema(MAP).parquet(map_path).where(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")
    before, next_ = [0] * slots, [0] * shards
    for s, k in enumerate(shard_of):
        before[s] = next_[k]
        next_[k] += count[s]
    bases = spark.createDataFrame(list(enumerate(before)), "virtual_slot int, base long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    current = F.broadcast(current.join(bases, "virtual_slot"))  # one row for each of the fixed number of slots
    out = rows.withColumn("place", place).join(current, "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
