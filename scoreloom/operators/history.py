"""Per-epoch run history: ``(run_id, epoch, train_loss, train_acc, val_loss, val_acc, train_s, val_s)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_SCHEMA = (
    "run_id string, epoch int, train_loss double, train_acc double, "
    "val_loss double, val_acc double, train_s double, val_s double"
)
SERIES = ("train_loss", "train_acc", "val_loss", "val_acc")
# The names of the series in a stored history.
STORED_SERIES = ("train_losses", "train_accuracies", "val_losses", "val_accuracies")


def mark_improvements(history: DataFrame) -> DataFrame:
    """Add ``improved``: accuracy above every earlier epoch of the run, and above 0."""
    earlier = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn(
        "improved", F.col("val_acc") > F.greatest(F.coalesce(F.max("val_acc").over(earlier), F.lit(0.0)), F.lit(0.0))
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """``(run_id, epoch, val_acc)`` of the last improvement: the first epoch at the maximum.

    A run that never rises above 0 has no row. An aggregate, so epochs are
    combined before any shuffle.
    """
    rank = F.struct("val_acc", (-F.col("epoch")).alias("_recent"))
    return (
        history.where(F.col("val_acc") > 0)
        .groupBy("run_id")
        .agg(F.max_by("epoch", rank).alias("epoch"), F.max("val_acc").alias("val_acc"))
    )


def history_snapshots(history: DataFrame, every: int = 10) -> DataFrame:
    """Epochs at which a history report is written: every tenth and the last."""
    last = F.max("epoch").over(Window.partitionBy("run_id"))
    return (
        history.withColumn("_last", last)
        .where((F.col("epoch") % every == 0) | (F.col("epoch") == F.col("_last")))
        .drop("_last")
    )


def history_report(history: DataFrame) -> DataFrame:
    """One row per run: a list per series in epoch order, and the number of epochs."""
    rows = F.array_sort(F.collect_list(F.struct("epoch", *SERIES)))  # one entry per epoch
    return (
        history.groupBy("run_id")
        .agg(rows.alias("_rows"))
        .select("run_id", *[F.col(f"_rows.{s}").alias(s) for s in SERIES], F.size("_rows").alias("epochs"))
    )


def stored_history(report: DataFrame) -> DataFrame:
    """A history report under the names it is stored with."""
    return report.withColumnsRenamed(dict(zip(SERIES, STORED_SERIES)))
