"""Sharding over fixed virtual slots, with a versioned slot-to-shard map.

A row's slot is the hash of its id, size and checksum, one of ``SLOTS``; the number of slots never
changes. Bytes and rows are added up per slot. Version 0 of the map deals slots
to shards in turn. Rebalancing edits it: every shard keeps its largest slots up
to the mean load and gives up the rest, which go one by one, largest first, to
the shard that has least. The map has a row per slot and version, whatever the
number of rows, so it is broadcast and edited in one expression.

The law that holds is ``bytes``: shard sizes are near equal, a shard differing
from another by no more than the slots that were given up last, unless one slot
alone is larger than the mean.

Defined cases: a null text has no bytes and the CRC of the empty text. Rows that share an id, null included,
lie in slots by their texts, so one id fills no shard; rows that repeat id and text are in the same slot and get
places of their own. An empty table has no rows and an even map.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import stored

SLOTS = 4096
SHARDS = 24
# Bytes that a row takes besides its text.
ROW_BYTES = 8


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, bytes, n_rows)`` for every slot, from ``rows(virtual_slot, size)``."""
    every = rows.sparkSession.range(slots).select(
        F.col("id").cast("int").alias("virtual_slot"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("one")
    )
    both = rows.select("virtual_slot", "size", F.lit(1).cast("long").alias("one")).unionByName(every)
    return both.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.sum("one").alias("n_rows"))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map ``(version, virtual_slot, shard, bytes, n_rows)``: slots dealt in turn."""
    return loads.select(
        F.lit(0).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).cast("int").alias("shard"), "bytes", "n_rows"
    )


def rebalance(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, edited so that shards are near equal in bytes; ``shards`` may be more than before."""
    largest = [F.desc("bytes"), F.col("virtual_slot")]
    running = Window.partitionBy("shard").orderBy(*largest).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy("version")) / shards
    marked = current.withColumn("stays", F.sum("bytes").over(running) <= mean)
    # One row: as many entries as there are slots.
    packed = marked.groupBy("version").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "stays", "n_rows"))).alias("slots")
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(
            F.filter("slots", lambda x: x.stays & (x.shard == s)), F.lit(0).cast("long"), lambda total, x: total - x.less
        ),
    )
    start = F.struct(kept.alias("loads"), F.array().cast("array<int>").alias("targets"))

    def give(state, slot):
        least = (F.array_position(state.loads, F.array_min(state.loads)) - 1).cast("int")
        loads = F.transform(state.loads, lambda load, s: F.when(s == least, load - slot.less).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state.targets, F.array(least)).alias("targets"))

    given = F.filter("slots", lambda x: ~x.stays)
    dealt = F.aggregate(given, start, give).targets
    moved = F.transform(F.arrays_zip(given.alias("slot"), dealt.alias("target")), lambda z: F.struct(
        z.slot.virtual_slot.alias("virtual_slot"), z.target.alias("shard"), (-z.slot.less).alias("bytes"), z.slot.n_rows.alias("n_rows")))
    still = F.transform(F.filter("slots", lambda x: x.stays), lambda x: F.struct(
        x.virtual_slot.alias("virtual_slot"), x.shard.alias("shard"), (-x.less).alias("bytes"), x.n_rows.alias("n_rows")))
    return packed.select((F.col("version") + 1).alias("version"), F.inline(F.concat(still, moved)))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows(virtual_slot, ...)`` with ``shard`` and ``slot``, the place in the shard, 0, 1, 2 ... without gaps.

    Places come from the places within a virtual slot and the rows of the shard's slots before it.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_place", F.row_number().over(within)).join(F.broadcast(starts), "virtual_slot")
    return placed.withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_start", "_place")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``(placed, map)``: every row of ``docs(doc_id, text)`` with size, checksum, shard and place; versions 0 and 1 of the map."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots=slots))
    rows = stored(rows, "slots")
    first = stored(first_map(slot_loads(rows, slots), shards), "slot_map")
    both = stored(first.unionByName(rebalance(first, shards)), "slot_map")
    return assign(rows, both.where("version = 1")), both
