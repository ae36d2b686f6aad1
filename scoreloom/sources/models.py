"""Model weights as a Parquet table, one row per matrix, and the versions of it that are committed."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.model import Model, ModelShape, WEIGHT_NAMES

MODEL_SCHEMA = "run_id string, epoch int, name string, rows int, cols int, values array<double>"
# Fixed value: name under which reports list the architecture.
MODEL_TYPE = "OptimizedGRUModel"


def model_table(spark: SparkSession, model: Model, run_id: str, epoch: int) -> DataFrame:
    rows = [
        (run_id, epoch, name, *model.weights[name].shape, model.weights[name].ravel().tolist())
        for name in WEIGHT_NAMES
    ]
    return spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1)


COMMIT_SCHEMA = "run_id string, epoch int, version string, committed_at timestamp"
VERSIONED_SCHEMA = f"{MODEL_SCHEMA}, version string"


def write_model(spark: SparkSession, model: Model, path: str, run_id: str, epoch: int) -> None:
    """Store weights under a version of their own, then commit the version with one row.

    Readers see committed versions only, of one run and epoch the last. So a write that was cut off
    leaves nothing to be seen, and one that is done again takes the place of the first.
    """
    version = uuid.uuid4().hex
    staged = model_table(spark, model, run_id, epoch).withColumn("version", F.lit(version))
    staged.write.mode("append").partitionBy("version").parquet(f"{path}/weights")
    commit = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(epoch).cast("int").alias("epoch"), F.lit(version).alias("version"), F.current_timestamp().alias("committed_at")
    )
    commit.write.mode("append").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, epoch, version, committed_at)``: the version of each run and epoch that counts."""
    last = F.struct("committed_at", "version")
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits").groupBy("run_id", "epoch").agg(F.max(last).alias("last"))
    return commits.select("run_id", "epoch", "last.version", "last.committed_at")


def saved_models(spark: SparkSession, path: str) -> DataFrame:
    """The weight table of all committed models."""
    weights = spark.read.schema(VERSIONED_SCHEMA).parquet(f"{path}/weights")
    return weights.join(committed(spark, path).select("version"), "version").drop("version")


def read_model(spark: SparkSession, path: str, shape: ModelShape, run_id: str, epoch: int | None = None) -> Model:
    """Weights of a run (its last saved epoch by default), checked against ``shape``."""
    mine = committed(spark, path).where(F.col("run_id") == run_id)
    if epoch is not None:
        mine = mine.where(F.col("epoch") == epoch)
    found = mine.orderBy(F.desc("epoch")).first()
    if found is None:
        raise ValueError(f"no model saved for run {run_id!r} in {path}")
    epoch = found["epoch"]
    # Four matrices, in the folder of their version.
    rows = spark.read.schema(VERSIONED_SCHEMA).parquet(f"{path}/weights").where(F.col("version") == found["version"]).collect()
    weights = {r["name"]: np.asarray(r["values"], dtype=np.float64).reshape(r["rows"], r["cols"]) for r in rows}
    if len(rows) != len(WEIGHT_NAMES) or set(weights) != set(WEIGHT_NAMES):
        raise ValueError(f"run {run_id!r} epoch {epoch}: expected {WEIGHT_NAMES}, found {sorted(r['name'] for r in rows)}")
    return Model(shape, weights)


def model_info(weights: DataFrame, shape: ModelShape) -> DataFrame:
    """One row per saved model: type, sizes, dropout and parameter counts from the weight table."""
    total = F.sum(F.col("rows").cast("long") * F.col("cols"))
    return weights.groupBy("run_id", "epoch").agg(
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit(shape.num_features).alias("input_size"),
        F.lit(shape.hidden_size).alias("hidden_size"),
        F.lit(shape.num_classes).alias("num_classes"),
        F.lit(shape.dropout).alias("dropout_rate"),
        total.alias("total_parameters"),
        total.alias("trainable_parameters"),
    )
