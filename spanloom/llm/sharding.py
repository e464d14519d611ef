"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's hash gives one of 4,096 slots for good. Bytes are summed per slot, and a versioned map puts slots into shards:
largest slot first, each into the shard with the least bytes so far. A later version starts from the last one and moves
only slots whose shard would exceed its fair share; records never change their slot. The map has as many rows as slots,
whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
#: A shard keeps its slots up to this share beyond the mean.
TOLERANCE = 0.002


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """A record's virtual slot: by its key, or by its text where the key is null."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    """UTF-8 bytes and 8; a null has no bytes."""
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 8


def slot_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n_rows) for all slots, those without records too."""
    used = docs.groupBy(slot_of(key, text, slots).alias("vslot")).agg(F.sum(size_of(text)).alias("bytes"), F.count("*").alias("n_rows"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def slot_map(sizes: DataFrame, shards: int, previous: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(version, vslot, shard, bytes, n_rows): the next version of the map.

    One fold over the slots, largest first: a slot stays in its shard while that stays within its share, else it goes to the
    shard with the least bytes. Without a previous map all slots are placed anew. The fold runs over a fixed number of slots.
    Slots of equal size go by number, shards of equal load likewise; without records every slot is of size zero and placed.
    """
    before = previous.select("vslot", F.col("shard").alias("old"), F.col("version").alias("was")) if previous is not None else sizes.select("vslot", F.lit(None).cast("int").alias("old"), F.lit(0).alias("was"))
    entry = F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "n_rows", "old")
    line = sizes.join(before, "vslot", "left").agg(F.array_sort(F.collect_list(entry)).alias("slots"), F.max("was").alias("was"), (F.sum("bytes") / shards * (1 + tolerance)).alias("share"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        load = F.get(a["loads"], s["old"])
        stays = F.coalesce((s["old"] < shards) & (load + s["bytes"] <= F.col("share")), F.lit(False))
        least = (F.array_position(a["loads"], F.array_min(a["loads"])) - 1).cast("int")
        put = F.when(stays, s["old"]).otherwise(least)
        return F.transform(F.array(put), lambda t: F.struct(F.transform(a["loads"], lambda x, i: F.when(i == t, x + s["bytes"]).otherwise(x)).alias("loads"), F.concat(a["out"], F.array(t)).alias("out")))[0]

    folded = line.select("slots", "was", F.aggregate("slots", zero, step, lambda a: a["out"]).alias("shards"))
    rows = folded.select((F.col("was") + 1).alias("version"), F.explode(F.arrays_zip("slots", "shards")).alias("z"))
    return rows.select("version", F.col("z.slots.vslot").alias("vslot"), F.col("z.shards").alias("shard"), F.col("z.slots.bytes").alias("bytes"), F.col("z.slots.n_rows").alias("n_rows"))


def store(mapped: DataFrame, path: str) -> None:
    """Add a version of the map to its table; versions already there stay."""
    mapped.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest by default."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version)


def assign(docs: DataFrame, mapped: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, shard, slot, vslot, version): every record's shard and its gapless place there, from 0.

    A place is the number of records in the shard's earlier virtual slots and the rank within its own, so no task orders
    a whole shard. Null texts count as empty. Equal rows rank next to each other in either order.
    """
    order = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = mapped.select("version", "vslot", "shard", F.coalesce(F.sum("n_rows").over(order), F.lit(0)).alias("first"))
    rows = docs.select(F.col(key), size_of(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), slot_of(key, text, slots).alias("vslot"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")))
    # The map has one row for each slot, a fixed number, so it may be broadcast.
    return ranked.join(F.broadcast(first), "vslot").select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "vslot", "version")
