"""Sharding by fixed virtual slots.

Records are hashed into a few thousand fixed slots. Bytes are summed per slot, and a versioned table says which shard
holds which slot; rebalancing edits that table and moves whole slots, so a record's slot never changes.

A slot is a hash of doc_id and text. Rows that repeat whole are counted first, and each copy but the first is hashed with its
number too, so that copies spread over slots like other rows, however many there are; a rerun numbers them alike.

Cases. A null text has zero bytes. A null id is hashed like any value. Rows that repeat whole get slots and positions of
their own. An empty table gives a full map of empty slots and no rows. Columns of the input that bear one
of the output's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklake.llm.common import copies, copy_hash, row_key, settle, table, whole_rows

N_SLOTS = 4096
ROW_OVERHEAD = 8
#: Parts of a virtual slot for which a record's position is found on its own.
LANES = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD).cast("long")


def virtual_slot(*keys: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_stats(records: DataFrame, n_slots: int = N_SLOTS, rows: Column | None = None) -> DataFrame:
    """records(virtual_slot, size) -> one row for every slot: bytes and rows, zero where a slot is empty. rows: how to count them."""
    held = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), (F.count("*") if rows is None else rows).alias("rows"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _deal(slots: Column, loads: Column) -> Column:
    """Fold of (-bytes, slot), largest first: each slot goes to the shard with the least bytes so far, the lower number on ties."""
    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def put(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, k: F.when(k == least, load - slot["weight"]).otherwise(load)).alias("loads"),
            F.concat(state["dealt"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard")))).alias("dealt"),
        )

    return F.aggregate(slots, F.struct(loads.alias("loads"), none.alias("dealt")), put, lambda state: state["dealt"])


def shard_map(stats: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """Version 1 of the map: all slots dealt by bytes. One row per slot; the number of slots is a constant, so one task holds them."""
    slots = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("weight"), "virtual_slot")))
    dealt = stats.agg(_deal(slots, F.array_repeat(F.lit(0).cast("long"), n_shards)).alias("dealt"))
    return dealt.select(F.inline("dealt")).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def rebalance(old: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map. Shards above their share of the bytes (or beyond n_shards) give up slots, which go to the lightest shards; all other slots stay."""
    share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / n_shards
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot"))
    cut = old.join(stats, "virtual_slot").withColumn("moves", (F.col("shard") >= n_shards) | (upto > F.ceil(share)))
    held = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda k: F.aggregate(F.filter("kept", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda total, x: total + x["bytes"]),
    )
    both = cut.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.when(F.col("moves"), F.struct((-F.col("bytes")).alias("weight"), "virtual_slot")))).alias("moved"),
        F.collect_list(F.when(~F.col("moves"), F.struct("virtual_slot", "shard", "bytes"))).alias("kept"),
    )
    stay = F.transform("kept", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard")))
    dealt = both.select((F.col("version") + 1).alias("version"), F.concat(stay, _deal(F.col("moved"), held)).alias("dealt"))
    return dealt.select("version", F.inline("dealt"))


def save_map(shards: DataFrame, path: str) -> None:
    shards.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        newest = maps.agg(F.max("version").alias("newest"))
        return maps.join(newest, F.col("version") == F.col("newest"), "left_semi")
    return maps.filter(F.col("version") == version)


def place(records: DataFrame, lanes: DataFrame, shards: DataFrame, order: list) -> DataFrame:
    """records and lanes(virtual_slot, _lane, rows) -> records with shard and slot, the record's position in its shard, gapless from 0.

    Positions come from a rank within each lane of a virtual slot and the lane's offset within its shard, so no task ever
    sorts a whole slot. The broadcast table has one row per lane, a constant number."""
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("rows").over(before), F.lit(0))
    offsets = lanes.join(shards, "virtual_slot").select("virtual_slot", "_lane", "shard", offset.alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "_lane").orderBy(*order))
    placed = records.withColumn("_rank", rank).join(F.broadcast(offsets), ["virtual_slot", "_lane"])
    return placed.withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_offset", "_rank", "_lane")


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, payload: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> payload columns, size, text_crc32, virtual_slot, shard, slot. payload: the columns to carry (default:
    all). Light rows are placed; whole rows, texts included, meet them by a hash of all columns only when all are asked for."""
    made = ["size", "text_crc32", "virtual_slot", "shard", "slot"]
    kept = [c for c in (docs.columns if payload is None else payload) if c not in made]
    keys = ["_a", "_b"] if payload is None else ["_doc"]
    light = docs.select(
        *(row_key(docs) if payload is None else [F.struct(*kept).alias("_doc")]),
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("_record"),
    )
    counted = light.groupBy(*light.columns).agg(F.count("*").alias("_rows"))
    records = settle(copies(counted).withColumn("_record", copy_hash(F.col("_record"))))
    records = records.withColumn("virtual_slot", F.pmod("_record", F.lit(n_slots)).cast("int"))
    records = records.withColumn("_lane", F.pmod(F.shiftrightunsigned("_record", 48), F.lit(LANES)).cast("int"))
    lanes = settle(records.groupBy("virtual_slot", "_lane").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    shards = shard_map(slot_stats(lanes, n_slots, F.sum("rows")), n_shards)
    placed = place(records, lanes, shards, ["text_crc32", "size", "_record", *keys, "_copy"])
    if payload is None:
        placed = placed.join(whole_rows(docs, kept), ["_a", "_b", "_lot"])
    return placed.select("_doc.*", *made)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=24, payload=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
