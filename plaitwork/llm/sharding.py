"""Sharding with DataFrame functions only: fixed virtual slots and a versioned slot-to-shard map.

Each row is hashed by its text into one of ``SLOTS`` fixed slots, and by its id into one of ``PARTS`` parts of the slot. Bytes and rows are
aggregated by slot and part, a bounded number of rows whatever the input. A slot is one item to place, so equal texts share a shard.

Only a text whose own rows outweigh an even share can't: no shard could hold it and stay even. Such texts, fewer than there are shards, leave
their slot for one with a number below 0, which is placed part by part; the other texts of the slot stay together.

Items go, largest first, to the shard that has the fewest bytes; ties go by slot, then part, the larger first, and to the shard of the least number. The map is
written with a version; ``rebalance`` edits it for a new number of shards or new bytes by moving few items.

A null text counts as empty: its size is 1. Rows that repeat an id or text are placed like any other. A text that outweighs a share in rows of one id,
or without ids, is one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, PARTS = 4_096, 512


def heavy_texts(docs: DataFrame, n_shards: int, text_col: str = "text") -> DataFrame:
    """(print): hashes of the texts whose rows together outweigh an even share of all bytes; fewer than ``n_shards`` rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.xxhash64(text).alias("print"), (F.octet_length(text) + 1).cast("long").alias("size"))
    by_text = sizes.groupBy("print").agg(F.sum("size").alias("bytes"))
    share = sizes.agg((F.sum("size") / n_shards).alias("share"))
    return by_text.join(F.broadcast(share)).where(F.col("bytes") > F.col("share")).select("print")  # one row


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, parts: int = PARTS, heavy: DataFrame | None = None) -> DataFrame:
    """(id, size, text_crc32, vslot, part); size: UTF-8 bytes of the text plus 1. ``heavy``: what ``heavy_texts`` has found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("print"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(parts)).cast("int").alias("part"),
    )
    vslot = F.pmod("print", F.lit(slots)).cast("int")
    if heavy is None:
        return rows.select("id", "size", "text_crc32", vslot.alias("vslot"), "part")
    marked = rows.join(F.broadcast(heavy.select("print", F.lit(True).alias("heavy"))), "print", "left")  # fewer rows than shards
    return marked.select("id", "size", "text_crc32", F.when(F.col("heavy"), -1 - vslot).otherwise(vslot).alias("vslot"), "part")


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _place(items: Column, n: int, loads: Column) -> Column:
    """Folds items, struct(bytes, vslot, part), into struct(loads, placed): each to the lightest shard."""
    zero = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,part:int,shard:int>>").alias("placed"))

    def add(acc: Column, item: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == at - 1, x + item["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["placed"], F.array(F.struct(item["vslot"].alias("vslot"), item["part"].alias("part"), (at - 1).alias("shard")))).alias("placed"),
        )

    return F.aggregate(items, zero, add)["placed"]


def items(sizes: DataFrame) -> DataFrame:
    """(vslot, part, bytes): part is null for a slot, and set for the slots of heavy texts."""
    return sizes.groupBy("vslot", F.when(F.col("vslot") < 0, F.col("part")).alias("part")).agg(F.sum("bytes").alias("bytes"))


def slot_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """(version 1, vslot, part, shard): the first map, by largest item first."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "vslot", "part"))))
    placed = items(sizes).agg(_place(ordered, n_shards, F.array_repeat(F.lit(0).cast("long"), n_shards)).alias("placed"))
    return placed.select(F.explode("placed").alias("p")).select(F.lit(1).alias("version"), "p.*")


def rebalance(old: DataFrame, sizes: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map: items leave only shards over an even share (times 1 + ``slack``).

    New shards start empty. The smallest items of an overfull or removed shard leave it, and are placed
    anew, largest first, on the lightest shards; all other items stay where they are.
    """
    now = items(sizes).join(old.select("version", "vslot", F.col("part").alias("old_part"), "shard"), "vslot", "left")
    now = now.where("old_part is null or part is null or old_part = part").groupBy("vslot", "part").agg(F.first("bytes").alias("bytes"), F.min("shard").alias("shard"), F.max("version").alias("version"))
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot", "part"))
    tagged = now.select("*", share.alias("share"), kept.alias("upto")).withColumn(
        "stays", F.col("shard").isNotNull() & (F.col("shard") < n_shards) & (F.col("upto") <= F.col("share") * (1 + slack))
    )
    version = F.coalesce(F.max("version"), F.lit(0)) + 1
    stay = F.collect_list(F.when(F.col("stays"), F.struct("vslot", "part", "shard")))
    move = F.reverse(F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot", "part")))))
    load = F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long") for k in range(n_shards)])
    done = tagged.agg(version.alias("version"), stay.alias("stay"), move.alias("move"), load.alias("load"))
    both = done.select("version", F.explode(F.concat("stay", _place(F.col("move"), n_shards, F.col("load")))).alias("p"))
    return both.select("version", "p.*")


def write_map(slots: DataFrame, path: str) -> None:
    """Stores a map under its version; a version that is there already is replaced by the same rows."""
    slots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map: the given version, or the newest."""
    maps = spark.read.parquet(path)
    return maps.where(F.col("version") == (version if version is not None else maps.agg(F.max("version")).first()[0]))


def assign(rows: DataFrame, slots: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the row's place in its shard, from 0 without gaps.

    A place is the offset of the row's (vslot, part) in its shard, from the aggregated counts, plus the
    row's number inside that small group; no shard is ever sorted as a whole.
    """
    by_part = sizes.join(F.broadcast(slots.withColumnRenamed("part", "map_part")), "vslot").where("map_part is null or map_part = part")
    order = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    in_group = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("id", "text_crc32", "size"))
    placed = rows.withColumn("nr", in_group).join(offsets, ["vslot", "part"])
    return placed.withColumn("slot", (F.col("offset") + F.col("nr") - 1).cast("long"))
