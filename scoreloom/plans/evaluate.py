"""Scoring a test table and everything derived from the scores."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scoring import score_rows, tally_models, tally_scores
from scoreloom.model import Model, ModelShape
from scoreloom.operators import metrics
from scoreloom.plans.settle import settle
from scoreloom.sources.labels import class_table
from scoreloom.sources.models import read_model
from scoreloom.sources.outputs import write_predictions, write_report, write_rows


@dataclasses.dataclass(frozen=True)
class Evaluation:
    """Metric tables of one scored table; ``predictions`` only when a path was given.

    ``confusion`` holds the pairs of classes that occur, with their names and shares.
    """

    overall: DataFrame
    report: DataFrame
    averages: DataFrame
    full: DataFrame
    confusion: DataFrame
    predictions: DataFrame | None

    def as_rows(self) -> DataFrame:
        """All metrics as ``(section, name, metric, value)``."""
        whole = self.overall.select(
            F.lit("overall").alias("section"),
            F.lit("all").alias("name"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in ("accuracy", "loss", "total_samples")
                    ]
                )
            ),
        )
        rows = self.report.select("class_name", "precision", "recall", "f1", "support").unionByName(self.averages)
        report = rows.select(
            F.lit("report").alias("section"),
            F.col("class_name").alias("name"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in ("precision", "recall", "f1", "support")
                    ]
                )
            ),
        )
        confusion = self.confusion.select(
            F.lit("confusion").alias("section"),
            F.col("label").cast("string").alias("name"),
            F.col("pred").cast("string").alias("metric"),
            F.col("n").cast("double").alias("value"),
        )
        return whole.unionByName(report).unionByName(confusion)


def evaluate_performance(
    samples: DataFrame, model: Model, class_names: list[str], predictions_path: str | None = None
) -> Evaluation:
    """Score once, then derive every metric from the tally.

    With a path all predictions are written first and the tally reads back two
    narrow columns and the loss; without one only tallies leave the scoring tasks.
    """
    spark, classes = samples.sparkSession, len(class_names)
    if classes != model.shape.num_classes:
        raise ValueError(f"{classes} class names for a model of {model.shape.num_classes} classes")
    predictions = None
    if predictions_path:
        write_predictions(score_rows(samples, model).drop("features"), predictions_path)
        predictions = spark.read.parquet(predictions_path)
        tallies = settle(metrics.tally(predictions))
    else:
        tallies = settle(tally_scores(samples, model))
    named = class_table(spark, class_names)
    report = settle(metrics.class_report(tallies, named, classes))
    averages = metrics.report_averages(report, tallies)
    return Evaluation(
        metrics.overall(tallies),
        report,
        averages,
        metrics.report_full(report, averages),
        metrics.confusion_pairs(tallies, named),
        predictions,
    )


def evaluate_test(
    samples: DataFrame,
    model_path: str,
    shape: ModelShape,
    run_id: str,
    class_names: list[str],
    output_dir: str | None = None,
) -> Evaluation:
    """Evaluate the saved best model of a run; with ``output_dir`` also store reports and predictions."""
    model = read_model(samples.sparkSession, model_path, shape, run_id)
    result = evaluate_performance(
        samples, model, class_names, f"{output_dir}/predictions" if output_dir else None
    )
    if output_dir:
        write_rows(metrics.report_rows(result.report, result.averages), f"{output_dir}/classification_report")
        write_rows(result.confusion.orderBy("label", "pred"), f"{output_dir}/confusion_matrix")
    return result


def compare_models(
    samples: DataFrame, models: dict[str, Model], class_names: list[str], output_dir: str | None = None
) -> DataFrame:
    """``(metric, <model>, ...)`` for all given models."""
    return _compared(settle(tally_models(samples, models)), list(models), class_names, output_dir)


def compare_results(
    predictions: dict[str, DataFrame], class_names: list[str] | dict[str, list[str]], output_dir: str | None = None
) -> DataFrame:
    """The same from finished results: tables ``(label, pred, loss)`` by model name.

    The models may differ in features and rows, and with a list of names for each model in classes:
    each is reported over its own.
    """
    tallies = settle(_results_tally(predictions))
    if isinstance(class_names, dict):
        aligned = settle(align_tallies(tallies, class_names))
        return _compared(aligned, list(predictions), aligned_classes(tallies.sparkSession, class_names), output_dir)
    return _compared(tallies, list(predictions), class_names, output_dir)


def compare_classes(predictions: dict[str, DataFrame], class_names: dict[str, list[str]]) -> DataFrame:
    """``(label, class_name, metric, <model>, ...)`` over the classes of all models; null where a model does not know a class."""
    tallies = _results_tally(predictions)
    names, models = aligned_classes(tallies.sparkSession, class_names), list(predictions)
    report = metrics.class_report(settle(align_tallies(tallies, class_names)), names, len(union_of(class_names)), by=("model",), values=models)
    values = [F.struct(F.lit(shown).alias("metric"), F.col(c).cast("double").alias("value")) for c, shown in _CLASS_METRICS]
    stacked = report.select("model", "label", "class_name", F.inline(F.array(*values)))
    return stacked.groupBy("label", "class_name", "metric").pivot("model", models).agg(F.first("value"))


_CLASS_METRICS = (("precision", "precision"), ("recall", "recall"), ("f1", metrics.F1_FIELD), ("support", "support"))


def _results_tally(predictions: dict[str, DataFrame]) -> DataFrame:
    named = [df.select("label", "pred", "loss", F.lit(name).alias("model")) for name, df in predictions.items()]
    return metrics.tally(functools.reduce(DataFrame.unionByName, named), by=("model",))


def union_of(class_names: dict[str, list[str]]) -> list[str]:
    """The names of all models, each once, in order of their first occurrence."""
    return list(dict.fromkeys(name for names in class_names.values() for name in names))


def aligned_classes(spark: SparkSession, class_names: dict[str, list[str]]) -> DataFrame:
    """``(model, own, label, class_name)``: a model's class id and the id of that name among all models' names."""
    place = {name: k for k, name in enumerate(union_of(class_names))}
    for model, names in class_names.items():
        if len(set(names)) != len(names):
            raise ValueError(f"model {model!r} has a class name twice")
    rows = [(model, own, place[name], name) for model, names in class_names.items() for own, name in enumerate(names)]
    return spark.createDataFrame(rows, "model string, own int, label int, class_name string")


def align_tallies(tallies: DataFrame, class_names: dict[str, list[str]]) -> DataFrame:
    """``tallies(model, label, pred, ...)`` with every model's class ids as ids among all names; an id outside its list is an error."""
    ids = aligned_classes(tallies.sparkSession, class_names).select(F.col("model").alias("_model"), "own", F.col("label").alias("_id"))
    out = tallies
    for column in ("label", "pred"):
        unknown = F.raise_error(F.concat(F.lit(f"{column} outside the list of its model: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        found = out.join(ids, (F.col("model") == F.col("_model")) & (F.col(column) == F.col("own")), "left")
        out = found.withColumn(column, F.coalesce("_id", unknown.cast("int"))).drop("_model", "own", "_id")
    return out


def _compared(tallies: DataFrame, names: list[str], classes: list[str] | DataFrame, output_dir: str | None) -> DataFrame:
    table = class_table(tallies.sparkSession, classes) if isinstance(classes, list) else classes
    size = len(classes) if isinstance(classes, list) else classes.agg(F.coalesce(F.max("label") + 1, F.lit(0))).first()[0]
    report = settle(metrics.class_report(tallies, table, size, by=("model",), values=names))
    compared = metrics.comparison(report, tallies, "model", names)
    if output_dir:
        write_report(compared, f"{output_dir}/model_comparison")
    return compared
