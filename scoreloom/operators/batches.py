"""Fixed-size mini-batches within shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import ranks
from scoreloom.operators.sharding import SPREAD_FACTOR, SPREAD_MODULUS

# What epoch, seed and shard add to the key of a permutation.
EPOCH_KEY, SEED_KEY, SHARD_KEY = 2_654_435_761, 40_503, 2_246_822_519


def batch_order(epoch: int, seed: int) -> Column:
    """Shuffle order of an epoch: a hash of the row number, so a retried task repeats it.

    For a given seed the hash maps 64-bit numbers one to one, so it orders rows
    without ties, and a single long is the cheapest thing to sort by.
    """
    return F.xxhash64(F.lit(seed), F.lit(epoch), F.col("row_id"))


def numbered_minibatches(
    df: DataFrame, batch_size: int, num_shards: int, shuffle: tuple[int, int] | None = None, rows: int | None = None
) -> DataFrame:
    """Add ``batch_id`` per shard to rows with ``shard = spread(row_id, num_shards)``, without moving or sorting them.

    A row's place in its shard follows from its number: every batch is full but the last of a shard, and
    a row that was left out makes its own batch shorter and no other. With ``shuffle=(epoch, seed)`` the places of a shard are permuted,
    for which the number of ``rows`` of the whole table (footers tell) has to be given.
    """
    if shuffle is not None and rows is None:
        raise ValueError("a shuffled order needs the number of rows")

    @F.arrow_udf("bigint")
    def batch_of(row_id: pa.Array, shard: pa.Array) -> pa.Array:
        number, k = row_id.to_numpy(zero_copy_only=False), shard.to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = (-(-(k + step) * SPREAD_MODULUS // num_shards) for step in (0, 1))
        rank = ranks.multiples_within(number, low, high, SPREAD_MODULUS, SPREAD_FACTOR)
        if shuffle is not None:
            size = ranks.multiples_within(np.full(len(k), rows), low, high, SPREAD_MODULUS, SPREAD_FACTOR)
            key = np.array([shuffle[0] * EPOCH_KEY + shuffle[1] * SEED_KEY], dtype=np.int64).astype(np.uint64) + k.astype(np.uint64) * np.uint64(SHARD_KEY)
            rank = ranks.permuted(rank, size, key)
        return pa.array(rank // batch_size)

    return df.withColumn("batch_id", batch_of("row_id", "shard"))


def minibatches(
    df: DataFrame, batch_size: int, shuffle: tuple[int, int] | None = None, slices: int = 1, rows: int | None = None
) -> DataFrame:
    """Add ``batch_id`` per shard by sorting: every batch full but the last, whatever row numbers are missing.

    Rows keep ``row_id`` order, or with ``shuffle=(epoch, seed)`` that epoch's
    random order. ``slices`` cuts each shard into that many ranges of the order,
    numbered by separate tasks and joined up by the count of earlier ranges, so a
    shard of any size needs no single task. ``rows``, more than any row number, saves looking for the greatest.
    """
    if shuffle is None:
        span = rows if slices == 1 or rows is not None else df.agg(F.max("row_id")).first()[0]
        order = F.col("row_id")
        part = F.floor(F.col("row_id") / (((span or 0) + slices) // slices)) if slices > 1 else F.lit(0)
    else:
        order = batch_order(*shuffle)
        # The hash covers all 64-bit values evenly, so equal ranges hold equal shares.
        part = F.floor((F.shiftright(order, 32) + F.lit(1 << 31)) * F.lit(slices) / F.lit(1 << 32))
    ordered = df.withColumns({"_part": part.cast("int"), "_order": order})
    if slices == 1:
        within = Window.partitionBy("shard").orderBy("_order")
        index = F.row_number().over(within) - 1
    else:
        before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            ordered.groupBy("shard", "_part")
            .agg(F.count("*").alias("_n"))
            .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        )
        ordered = ordered.join(starts, ["shard", "_part"])
        within = Window.partitionBy("shard", "_part").orderBy("_order")
        index = F.col("_start") + F.row_number().over(within) - 1
    return ordered.withColumn("batch_id", F.floor(index / batch_size).cast("bigint")).select(*df.columns, "batch_id")


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("shard", "batch_id").agg(F.count("*").alias("n_rows"))


def weighted_batch_loss(batched: DataFrame) -> DataFrame:
    """Mean of ``loss * weight`` per batch: divided by the batch size, not the weight sum."""
    return batched.groupBy("shard", "batch_id").agg(F.avg(F.col("loss") * F.col("weight")).alias("weighted_loss"))
