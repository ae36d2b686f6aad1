"""The training loop: one Spark job per step for the gradient, one per epoch for validation."""

from __future__ import annotations

import dataclasses
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from scoreloom.config import RunConfig
from scoreloom.functions.scoring import tally_scores
from scoreloom.functions.updates import TrainState
from scoreloom.model import Model, ModelShape, init_model
from scoreloom.operators import metrics
from scoreloom.operators.history import HISTORY_SCHEMA, history_report, stored_history
from scoreloom.operators.sharding import shard_manifest
from scoreloom.operators.status import run_status
from scoreloom.operators.training import StoredBlocks, store_blocks, train_epoch
from scoreloom.plans.settle import settle
from scoreloom.sources.models import write_model
from scoreloom.sources.outputs import write_report
from scoreloom.sources.scratch import scratch_path

SNAPSHOT_EVERY = 10


@dataclasses.dataclass(frozen=True)
class TrainResult:
    """``history`` holds the losses and accuracies of every epoch; the training ones are those met
    while training, weighted and with dropout."""

    run_id: str
    history: DataFrame
    stored: StoredBlocks
    shard_rows: Counter
    shard_seconds: Counter
    best_model: Model | None
    best_epoch: int | None
    best_val_acc: float
    last_model: Model
    seconds: float

    def status(self) -> DataFrame:
        """A status row per shard: the stored rows against those that the last epoch has trained on."""
        table = self.stored.table
        manifest = settle(shard_manifest(table, self.stored.num_shards))
        rows = [(s, n, self.shard_seconds[s], self.best_val_acc) for s, n in self.shard_rows.items()]
        trained = table.sparkSession.createDataFrame(rows, "shard int, rows_trained bigint, seconds double, val_acc double")
        return run_status(manifest, trained)


def model_shape(config: RunConfig) -> ModelShape:
    return ModelShape(config.num_features, config.num_classes, config.hidden_size, config.dropout)


def validate(val: DataFrame | None, model: Model) -> tuple[float, float]:
    """``(loss, accuracy)``; 0.0 for both without validation rows."""
    if val is None:
        return 0.0, 0.0
    row = metrics.overall(tally_scores(val, model)).first()
    return row["loss"], row["accuracy"]


def train_model(
    spark: SparkSession,
    train: DataFrame,
    val: DataFrame | None,
    config: RunConfig,
    run_id: str,
    model_path: str | None = None,
    history_path: str | None = None,
    start: Model | None = None,
    source_rows: int | None = None,
) -> TrainResult:
    """Train from ``start`` (seeded random weights by default), keeping the best epoch on ``val``.

    ``train`` holds ``(row_id, features, label, weight)``, rejected rows left out or marked. Its rows are
    stored once as shards of blocks; every epoch puts its batches together from other blocks.
    """
    shape = model_shape(config)
    stored = store_blocks(
        train, scratch_path(spark, "training"), config.num_shards, config.batch_size, seed=config.seed, source_rows=source_rows
    )
    state = TrainState.start(start or init_model(shape, config.seed))
    rows, best_acc, best_model, best_at = [], 0.0, None, None
    began = time.perf_counter()
    for epoch in range(1, config.epochs + 1):
        t0 = time.perf_counter()
        state, part = train_epoch(stored, state, shape, config.learning_rate, epoch, config.seed)
        t1 = time.perf_counter()
        model = state.model(shape)
        val_loss, val_acc = validate(val, model)
        t2 = time.perf_counter()
        rows.append(
            (run_id, epoch, part.loss_sum / part.n, part.correct / part.n, val_loss, val_acc, t1 - t0, t2 - t1)
        )
        if val_acc > best_acc:
            best_acc, best_model, best_at = val_acc, model, epoch
            if model_path:
                write_model(spark, model, model_path, run_id, epoch)
        if history_path and (epoch % SNAPSHOT_EVERY == 0 or epoch == config.epochs):
            write_report(stored_history(history_report(spark.createDataFrame(rows, HISTORY_SCHEMA))), history_path)
    return TrainResult(
        run_id,
        spark.createDataFrame(rows, HISTORY_SCHEMA),
        stored,
        part.shard_rows,
        part.shard_seconds,
        best_model,
        best_at,
        best_acc,
        state.model(shape),
        time.perf_counter() - began,
    )
