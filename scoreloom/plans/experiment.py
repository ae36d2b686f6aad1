"""A whole run: metadata, samples, training, evaluation, summary."""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.config import CONFIG_SCHEMA, RunConfig
from scoreloom.operators.clean import mark_malformed
from scoreloom.operators.status import experiment_summary
from scoreloom.plans.evaluate import Evaluation, evaluate_test
from scoreloom.plans.prepare import load_samples
from scoreloom.plans.train import TrainResult, model_shape, train_model
from scoreloom.sources.features import file_offsets, scan_features, split_path
from scoreloom.sources.labels import load_metadata
from scoreloom.sources.models import model_info, model_table
from scoreloom.sources.outputs import write_report


@dataclasses.dataclass(frozen=True)
class Experiment:
    output_dir: str
    training: TrainResult
    evaluation: Evaluation
    summary: DataFrame


def run_experiment(spark: SparkSession, config: RunConfig, started: datetime.datetime | None = None) -> Experiment:
    """Run everything and store models, history, reports, predictions and the summary.

    Any failure is raised; nothing is replaced by a default.
    """
    stamp = (started or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
    out = f"{config.output_dir}_{stamp}"
    width, _, names = load_metadata(spark, config.train_path, config.label_indexer_path)
    config = config.with_metadata(width, names)
    shape = model_shape(config)

    offsets = file_offsets(spark, config.train_path)
    train = mark_malformed(scan_features(spark, config.train_path, offsets=offsets))
    val = load_samples(spark, config.val_path or split_path(config.train_path, "val"), numbered=False)
    trained = train_model(
        spark, train, val, config, stamp, model_path=f"{out}/best_model", history_path=f"{out}/training_history",
        source_rows=offsets.rows,
    )
    if trained.best_model is None:
        raise RuntimeError("no epoch had a validation accuracy above 0, so there is no model to evaluate")
    info = model_info(model_table(spark, trained.best_model, stamp, trained.best_epoch), shape)
    write_report(info, f"{out}/model_info")

    test = load_samples(spark, config.test_path, numbered=False)
    evaluation = evaluate_test(test, f"{out}/best_model", shape, stamp, names, out)
    whole = evaluation.overall.first()
    training_row = spark.createDataFrame(
        [(stamp, "SUCCESS", trained.seconds, trained.best_val_acc)],
        "run_id string, status string, total_training_time double, best_val_acc double",
    )
    evaluation_row = spark.createDataFrame(
        [(stamp, "SUCCESS", whole["accuracy"], whole["loss"])],
        "run_id string, status string, test_accuracy double, test_loss double",
    )
    settings = config.to_dict()
    literal = F.struct(
        *[
            F.lit(settings[f.name]).cast(f.dataType).alias(f.name)
            for f in CONFIG_SCHEMA.fields
        ]
    )
    summary = experiment_summary(training_row, evaluation_row, literal)
    write_report(summary, f"{out}/experiment_summary")
    return Experiment(out, trained, evaluation, summary)
