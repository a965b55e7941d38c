"""Shards by fixed virtual slots: DataFrame functions only.

A record's text hashes to one of SLOTS virtual slots, so equal texts lie together; only copies that
together have more than a SPREAD-th of a shard's share of the bytes are spread, by a hash of their keys.
Bytes are summed per slot, and a versioned map says which shard a slot lies in. Version 1 deals even
runs of slots, before anything is known of them. Rebalancing writes the next version with a few slots
edited; records keep their slots. The map has SLOTS rows, whatever the input.

Defined cases: a null text has no bytes (size 1); a null key hashes like any value; repeated rows are
rows of their own, each with a place; an empty table gives an empty result and a map of even runs. Rows
that are equal in key and text share a slot and a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

SLOTS = 4_096
#: Parts of a slot, among which its rows are ranked apart: a rank never gathers a whole slot.
CELLS = 64
#: Equal texts stay together up to this part of a shard's fair share.
SPREAD = 64


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_of(key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(slots)).cast("int")


def slot_bytes(spark: SparkSession, records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes) of all slots, empty ones too, from records with columns slot and size."""
    sums = records.groupBy("slot").agg(F.sum("size").alias("bytes"))
    return spark.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("slot")).join(sums, "slot", "left").na.fill(0, ["bytes"])


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: (version, shard, slot), even runs of slots."""
    slot = F.col("id").cast("int")
    return spark.range(slots, numPartitions=1).select(F.lit(1).alias("version"), F.floor(slot * shards / slots).cast("int").alias("shard"), slot.alias("slot"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """A map (version, shard, slot) from sizes alone: largest slot first, each to the lightest shard so far."""
    walked = sizes.agg(_walked(F.collect_list(F.struct("bytes", "slot")), F.array_repeat(F.lit(0).cast("long"), shards)).alias("map"))
    return walked.select(F.inline("map")).select(F.lit(1).alias("version"), "shard", "slot")


def _walked(slots: Column, loads: Column) -> Column:
    """(slot, shard) of structs (bytes, slot), largest first, each to the shard that is lightest by then.

    The slots fit in one array of fixed length, which one aggregate walks through.
    """
    start = F.struct(loads.alias("load"), F.array().cast("array<struct<slot:int,shard:int>>").alias("map"))

    def put(done: Column, x: Column) -> Column:
        shard = (F.array_position(done["load"], F.array_min(done["load"])) - 1).cast("int")
        load = F.transform(done["load"], lambda v, i: v + F.when(i == shard, x["bytes"] + 1).otherwise(0))
        return F.struct(load.alias("load"), F.array_append(done["map"], F.struct(x["slot"].alias("slot"), shard.alias("shard"))).alias("map"))

    return F.aggregate(F.reverse(F.array_sort(slots)), start, put, lambda done: done["map"])


def rebalanced_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version: an edit that makes the shards' bytes near equal.

    A shard keeps its slots, largest first, as long as they stay within its fair share; the others
    are dealt anew, largest first, each to the lightest shard. The map has a fixed number of rows.
    """
    loads = current.join(sizes, "slot")
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    sofar = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = loads.withColumn("share", share).withColumn("kept", sofar <= F.col("share"))
    loose = F.collect_list(F.when(~F.col("kept"), F.struct("bytes", "slot")))
    kept = F.collect_list(F.when(F.col("kept"), F.struct("shard", "bytes", "slot")))
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter("kept", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    whole = marked.agg(F.max("version").alias("version"), loose.alias("loose"), kept.alias("kept"))
    edits = _walked(F.col("loose"), held)
    stay = F.transform("kept", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard")))
    rows = whole.select((F.col("version") + 1).alias("version"), F.inline(F.concat(stay, edits)))
    return rows.select("version", "shard", "slot")


def grown_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for one more shard: slots move into the new shard only.

    Every shard gives slots, in the order of a hash, as long as what it has given stays within what
    it has above its new share.
    """
    given = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(23), "slot"), "slot")
    whole = Window.partitionBy("shard")
    loads = current.join(sizes, "slot").withColumn("total", F.sum("bytes").over(whole))
    loads = loads.withColumn("given", F.sum("bytes").over(given.rowsBetween(Window.unboundedPreceding, 0)))
    share = (sizes.agg(F.sum("bytes")).first()[0] or 0) / (shards + 1)
    moved = loads.withColumn("moves", F.col("given") <= F.col("total") - F.lit(share))
    return moved.select((F.col("version") + 1).alias("version"), F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "slot")


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot, virtual_slot, map_version, spread): each record's shard and place in it.

    ``slot`` numbers the rows of a shard from 0 without gaps; ``spread`` marks copies that are dealt to
    several slots. The texts are never shuffled. The versions of the map are stored below ``maps`` (a
    new shared folder if none is named); the shards are those of the last one.
    """
    spark = docs.sparkSession
    records = c.written(
        docs.select(
            F.col(key).alias("key"),
            record_size(text).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
            F.xxhash64(F.lit(19), F.coalesce(F.col(text), F.lit(""))).alias("same"),
        )
    )
    copies = records.groupBy("same").agg(F.sum("size").alias("bytes"))
    bound = F.coalesce(records.agg(F.sum("size")).scalar(), F.lit(0)) / (shards * SPREAD)
    wide = c.written(copies.filter(F.col("bytes") > bound).select("same", F.lit(True).alias("spread")))  # fewer than shards x SPREAD
    records = records.join(F.broadcast(wide), "same", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    records = records.withColumn("slot", F.when(F.col("spread"), slot_of("key", slots)).otherwise(slot_of("same", slots)))
    records = records.withColumn("cell", F.pmod(F.xxhash64(F.lit(29), "key", "same"), F.lit(CELLS)).cast("int"))
    cells = c.written(records.groupBy("slot", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    folder = maps or c.shared_folder(spark)
    current = c.written(even_map(spark, shards, slots), f"{folder}/version=1")
    current = c.written(rebalanced_map(current, slot_bytes(spark, cells, slots), shards), f"{folder}/version=2")
    # where a cell's rows begin: the slots of the shard before it, then the cells of its slot before it
    placed = cells.groupBy("slot").agg(F.sum("n").alias("n")).join(F.broadcast(current), "slot")
    ahead = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("slot", "shard", "version", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("slot_from"))
    within = Window.partitionBy("slot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("slot", "cell", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("cell_from"))
    starts = starts.join(F.broadcast(placed), "slot").select(
        "slot", "cell", "shard", "version", (F.col("slot_from") + F.col("cell_from")).alias("begin")
    )
    rank = F.row_number().over(Window.partitionBy("slot", "cell").orderBy("key", "crc", "size"))
    rows = records.withColumn("rank", rank).join(F.broadcast(starts), ["slot", "cell"])  # at most slots x CELLS rows of 32 bytes
    return rows.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("begin") + F.col("rank") - 1).cast("long").alias("slot"),
        F.col("slot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
        "spread",
    )
