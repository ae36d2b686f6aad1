"""Sinks for reports and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(report: DataFrame, path: str) -> str:
    """A report of a few rows as one JSON file."""
    report.repartition(1).write.mode("overwrite").json(path)
    return path


def write_rows(report: DataFrame, path: str) -> str:
    """A report with a row per class, or per pair of classes, as JSON: by as many tasks, in its order, as it has partitions."""
    report.write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Columns of a stored class report.
REPORT_SCHEMA = (
    "kind string, label int, class_name string, precision double, recall double, `f1-score` double, support bigint, "
    "total_samples bigint, num_classes int"
)


def nested_report(spark: SparkSession, path: str) -> dict:
    """A stored class report as one nested dictionary, put together by its reader.

    For reports that the reader wants as a whole; larger ones are read with ``read_report(spark, path, REPORT_SCHEMA)``.
    """
    rows = read_report(spark, path, REPORT_SCHEMA).collect()
    entry = lambda r: {m: r[m] for m in ("precision", "recall", "f1-score", "support")}
    classes = sorted((r for r in rows if r["kind"] == "class"), key=lambda r: r["label"])
    out = {r["class_name"]: entry(r) for r in (*classes, *(r for r in rows if r["kind"] == "average"))}
    if "accuracy" in out:
        out["accuracy"] = out["accuracy"]["recall"]
    out["total_samples"], out["num_classes"] = (rows[0]["total_samples"], rows[0]["num_classes"]) if rows else (0, 0)
    out["class_distribution"] = {r["class_name"]: r["support"] for r in classes}
    return out


def write_predictions(scored: DataFrame, path: str) -> str:
    """Every scored row, written by the tasks that scored it."""
    scored.write.mode("errorifexists").parquet(path)
    return path
