"""Training steps as distributed gradient sums.

A step is one aggregation over the rows of its batch: tasks add up gradients,
groups of tasks merge them, and the driver applies one update of model size. The
outcome depends on the rows of a batch and not on how they are split.

Rows are stored once, sorted by a random place that follows from the row number.
Blocks are ranges of places. Every epoch puts the blocks in another order and
takes its batches from it, so a batch has other rows in every epoch and a step
reads its blocks only.
"""

from __future__ import annotations

import dataclasses
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import forward, updates
from scoreloom.functions.updates import TrainState
from scoreloom.model import Model, ModelShape, WEIGHT_NAMES
from scoreloom.operators.clean import REASON, RowCounts
from scoreloom.operators.sharding import ROWS_PER_SHARD, SPREAD_MODULUS, place, spread
from scoreloom.sources.shards import CHUNK_ROWS, read_shard, write_shards

# Groups of tasks whose vectors are merged before they are exploded or collected.
FAN_IN = 8
# Rows of the stored table that differ by the seed are apart by this many.
SEED_STRIDE = 7919
# Blocks that a batch is put together from.
BLOCKS_PER_BATCH = 8
# A prime, and shifts of the order of blocks by epoch, by seed and in any case.
ORDER_PRIME = (1 << 31) - 1
ORDER_STRIDES = (1_640_531_527, 1_013_904_223, 362_437)
PART_SCHEMA = (
    "task int, n bigint, loss_sum double, correct bigint, vector array<double>, "
    "shards array<int>, shard_rows array<bigint>, shard_seconds array<double>"
)


@dataclasses.dataclass
class GradientSums:
    """Sums over rows: count, weighted loss, hits, gradient of the weighted loss; rows and seconds by shard."""

    n: int
    loss_sum: float
    correct: int
    vector: np.ndarray | None
    shard_rows: Counter = dataclasses.field(default_factory=Counter)
    shard_seconds: Counter = dataclasses.field(default_factory=Counter)

    def add(self, other: "GradientSums") -> "GradientSums":
        self.n += other.n
        self.loss_sum += other.loss_sum
        self.correct += other.correct
        if other.vector is not None:
            self.vector = other.vector if self.vector is None else self.vector + other.vector
        self.shard_rows.update(other.shard_rows)
        self.shard_seconds.update(other.shard_seconds)
        return self

    def as_batch(self, task: int) -> pa.RecordBatch:
        shards = sorted(self.shard_rows)
        columns = [
            pa.array([task], pa.int32()),
            pa.array([self.n], pa.int64()),
            pa.array([self.loss_sum], pa.float64()),
            pa.array([self.correct], pa.int64()),
            forward.list_column(self.vector[None, :]),
            pa.array([shards], pa.list_(pa.int32())),
            pa.array([[self.shard_rows[s] for s in shards]], pa.list_(pa.int64())),
            pa.array([[self.shard_seconds[s] for s in shards]], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["task", "n", "loss_sum", "correct", "vector", "shards", "shard_rows", "shard_seconds"])

    @staticmethod
    def of(batches) -> "GradientSums":
        total = GradientSums(0, 0.0, 0, None)
        for batch in batches:
            for i in range(batch.num_rows):
                pick = lambda name: batch.column(name)[i].as_py()
                vector = batch.column("vector")[i].values.to_numpy()
                rows, seconds = (Counter(dict(zip(pick("shards"), pick(c)))) for c in ("shard_rows", "shard_seconds"))
                total.add(GradientSums(pick("n"), pick("loss_sum"), pick("correct"), vector, rows, seconds))
        return total


def gradient_parts(samples: DataFrame, model: Model, dropout_key: tuple[int, ...] | None = None) -> DataFrame:
    """At most ``FAN_IN`` rows of ``PART_SCHEMA`` with gradient sums over ``samples(label, weight, features[, row_id, shard])``.

    With a ``dropout_key`` hidden units are dropped by a hash of key and ``row_id``.
    """
    shape = model.shape
    optional = [c if c in samples.columns else F.lit(0).alias(c) for c in ("row_id", "shard")]

    def sums(batches):
        from pyspark import TaskContext

        total = GradientSums(0, 0.0, 0, None)
        for batch in batches:
            began = time.perf_counter()
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            forward.check_labels(y, shape.num_classes)
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            for start, x in forward.feature_chunks(batch.column(2), shape.num_features):
                rows = slice(start, start + len(x))
                mask = None
                if dropout_key is not None:
                    mask = updates.dropout_mask(shape.dropout, ids[rows], shape.hidden_size, dropout_key)
                losses, guess, flat = updates.loss_and_gradient(model, x, y[rows], w[rows], mask)
                total.add(GradientSums(len(x), float((losses * w[rows]).sum()), int((guess == y[rows]).sum()), flat))
            shards, counts = np.unique(batch.column(4).to_numpy(zero_copy_only=False), return_counts=True)
            total.shard_rows.update(dict(zip(shards.tolist(), counts.tolist())))
            seconds = time.perf_counter() - began
            total.shard_seconds.update({s: seconds * c / len(y) for s, c in zip(shards.tolist(), counts.tolist())})
        if total.vector is not None:
            yield total.as_batch(TaskContext.get().partitionId())

    def merge(batches):
        total = GradientSums.of(batches)
        if total.vector is not None:
            yield total.as_batch(0)

    return (
        samples.select("label", "weight", "features", *optional)
        .mapInArrow(sums, PART_SCHEMA)
        .withColumn("_slot", F.pmod("task", F.lit(FAN_IN)))
        .repartitionById(FAN_IN, "_slot")
        .sortWithinPartitions("task")
        .drop("_slot")
        .mapInArrow(merge, PART_SCHEMA)
    )


def gradient_sums(samples: DataFrame, model: Model, dropout_key: tuple[int, ...] | None = None) -> GradientSums:
    """Sums over all rows, on the driver: one job, at most ``FAN_IN`` vectors of model size."""
    return GradientSums.of(gradient_parts(samples, model, dropout_key).toArrow().to_batches())


def batch_gradient(samples: DataFrame, model: Model) -> DataFrame:
    """``(name, row, col, value)``: gradient of the mean weighted loss over all given rows."""
    parts = gradient_parts(samples, model)
    # Every part has every component, so the row counts add up along with each.
    values = parts.select("n", F.posexplode("vector").alias("pos", "value")).groupBy("pos")
    sums = values.agg((F.sum("value") / F.sum("n")).alias("value"))
    return name_components(sums, model.shape)


def name_components(values: DataFrame, shape: ModelShape) -> DataFrame:
    """``(name, row, col, value)`` from ``(pos, value)`` in storage order."""
    name, first, width, start = F.lit(None).cast("string"), F.lit(0), F.lit(1), 0
    for block in WEIGHT_NAMES:
        rows, cols = shape.matrix_shapes()[block]
        inside = (F.col("pos") >= start) & (F.col("pos") < start + rows * cols)
        name = F.when(inside, F.lit(block)).otherwise(name)
        first = F.when(inside, F.lit(start)).otherwise(first)
        width = F.when(inside, F.lit(cols)).otherwise(width)
        start += rows * cols
    placed = values.withColumns({"name": name, "_at": F.col("pos") - first, "_width": width})
    return placed.select(
        "name",
        F.floor(F.col("_at") / F.col("_width")).cast("int").alias("row"),
        (F.col("_at") % F.col("_width")).cast("int").alias("col"),
        "value",
    )


@dataclasses.dataclass(frozen=True)
class StoredBlocks:
    """Training rows on disk, sorted by place, and the blocks of places that batches are put together from.

    A block is a range of places, ``num_blocks`` of them over all shards. An epoch puts the blocks in a
    random order of its own; its batches are slices of ``per_batch`` blocks of that order.
    """

    table: DataFrame
    num_shards: int
    num_blocks: int
    per_batch: int
    rows: int

    @property
    def num_batches(self) -> int:
        return -(-self.num_blocks // self.per_batch)

    def batches(self, epoch: int, seed: int) -> list[list[int]]:
        """The blocks of each batch of an epoch."""
        order = block_order(self.num_blocks, epoch, seed).tolist()
        return [order[at : at + self.per_batch] for at in range(0, self.num_blocks, self.per_batch)]

    def batch(self, blocks: list[int]) -> DataFrame:
        """Rows of the blocks. Shard and place rise together, so a block names its shards; row groups
        and pages of a file are ranges of places, so the scan reads little besides the blocks."""
        shards, inside = set(), F.lit(False)
        for b in blocks:
            shards.update(range(b * self.num_shards // self.num_blocks, ((b + 1) * self.num_shards - 1) // self.num_blocks + 1))
            low, high = (-(-k * SPREAD_MODULUS // self.num_blocks) for k in (b, b + 1))
            inside = inside | ((F.col("place") >= low) & (F.col("place") < high))
        return self.table.where(F.col("shard").isin(sorted(shards)) & inside)


def store_blocks(
    samples: DataFrame,
    path: str,
    num_shards: int,
    batch_size: int | None = None,
    num_batches: int | None = None,
    seed: int = 0,
    source_rows: int | None = None,
    per_batch: int = BLOCKS_PER_BATCH,
) -> StoredBlocks:
    """Store ``samples(row_id, features, label, weight)`` for training, in one pass.

    Samples may still have their rejected rows, marked by :func:`mark_malformed`. Either the size of a batch or the number of batches of an epoch is given. A row's place is its
    spread row number, whatever the shards are; how many rows there are is counted by the tasks
    that write them. ``source_rows``, an upper bound such as the row count of the source's footers,
    says how many tasks should write a shard.
    """
    if source_rows is None:
        source_rows = samples.count()
    number = F.col("row_id") + F.lit(seed * SEED_STRIDE)
    stored = samples.select("row_id", "features", "label", "weight", spread(number, num_shards).alias("shard"), place(number).alias("place"))
    placed = samples.select(*[samples[c] for c in ("row_id", "features", "label", "weight", REASON) if c in samples.columns], number.alias("_number"))
    placed = placed.withColumns({"shard": spread(F.col("_number"), num_shards), "place": place(F.col("_number"))})
    tasks = max(1, -(-source_rows // (num_shards * ROWS_PER_SHARD)))
    block_rows = batch_size // per_batch if batch_size else CHUNK_ROWS
    counted = RowCounts()
    write_shards(placed, path, num_shards, tasks, number="_number", order="place", group_rows=block_rows, counted=counted)
    rows = counted.kept()
    if not rows:
        raise ValueError("no training rows")
    table = read_shard(samples.sparkSession, path, schema=stored.schema)
    return StoredBlocks(table, num_shards, (num_batches or -(-rows // batch_size)) * per_batch, per_batch, rows)


def block_order(num_blocks: int, epoch: int, seed: int) -> np.ndarray:
    """The order of blocks in an epoch: by the fifth power of the shifted block number, modulo a prime.

    Five has no factor in common with the prime less one, so no two blocks have the same power.
    """
    if num_blocks >= ORDER_PRIME:
        raise ValueError(f"at most {ORDER_PRIME - 1} blocks")
    x = (np.arange(num_blocks, dtype=np.int64) + order_shift(epoch, seed)) % ORDER_PRIME
    square = x * x % ORDER_PRIME
    return np.argsort(square * square % ORDER_PRIME * x % ORDER_PRIME, kind="stable")


def order_shift(epoch: int, seed: int) -> int:
    return (epoch * ORDER_STRIDES[0] + seed * ORDER_STRIDES[1] + ORDER_STRIDES[2]) % ORDER_PRIME


def train_epoch(
    stored: StoredBlocks, state: TrainState, shape: ModelShape, learning_rate: float, epoch: int, seed: int = 0
) -> tuple[TrainState, GradientSums]:
    """One update per batch, from the gradient of its mean weighted loss; one job each."""
    state, totals = state.copy(), GradientSums(0, 0.0, 0, None)
    for step, blocks in enumerate(stored.batches(epoch, seed)):
        key = (seed, epoch, step) if shape.dropout > 0 else None
        found = gradient_sums(stored.batch(blocks), state.model(shape), key)
        if not found.n:
            continue  # more batches than rows
        updates.adamw_step(state, found.vector / found.n, learning_rate)
        totals.add(dataclasses.replace(found, vector=None))
    return state, totals
