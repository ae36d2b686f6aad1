"""Status rows and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_status(manifest: DataFrame, trained: DataFrame) -> DataFrame:
    """``(shard, status, total_training_time, best_val_acc)`` for every shard of the manifest.

    ``trained`` has ``(shard, rows_trained, seconds, val_acc)``. A shard without
    rows is NO_DATA; one whose trained rows differ from the manifest is an ERROR.
    Accuracy is reported by shard 0 only, 0.0 elsewhere.
    """
    done = F.coalesce("rows_trained", F.lit(0))
    status = (
        F.when(F.col("n_rows") == 0, "NO_DATA").when(done == F.col("n_rows"), "SUCCESS").otherwise("ERROR")
    )
    ran = status == "SUCCESS"
    return manifest.join(trained, "shard", "left").select(
        "shard",
        status.alias("status"),
        F.when(ran, F.col("seconds")).alias("total_training_time"),
        F.when(ran & (F.col("shard") == 0), F.col("val_acc")).otherwise(F.lit(0.0)).alias("best_val_acc"),
    )


def experiment_summary(training: DataFrame, evaluation: DataFrame, config: Column) -> DataFrame:
    """One nested row per run. Where both sides name a field, the evaluation's value wins.

    ``training`` has ``(run_id, status, total_training_time, best_val_acc)``,
    ``evaluation`` ``(run_id, status, test_accuracy, test_loss)``; ``config`` is
    a struct column of the training side or a literal.
    """
    joined = training.withColumn("_config", config).alias("t").join(evaluation.alias("e"), "run_id", "left")
    pick = lambda *names: [F.col(f"t._config.{n}").alias(n) for n in names]
    return joined.select(
        "run_id",
        F.struct(F.col("run_id").alias("timestamp"), *pick("mode", "num_shards")).alias("experiment_info"),
        F.struct(
            *pick("num_features", "num_classes", "hidden_size", "dropout", "learning_rate", "batch_size", "epochs")
        ).alias("model_config"),
        F.struct(
            F.coalesce("e.status", "t.status").alias("status"),
            F.col("t.total_training_time").alias("total_training_time"),
            F.col("t.best_val_acc").alias("best_validation_accuracy"),
        ).alias("training_results"),
        F.struct(F.col("e.test_accuracy").alias("test_accuracy"), F.col("e.test_loss").alias("test_loss")).alias(
            "test_results"
        ),
    )
