"""Spark session for stand-alone use; under spark-submit the cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(mode: str = "local", app_name: str = "scoreloom", **settings: str) -> SparkSession:
    """``mode`` is ``local`` (all cores of this machine) or ``cluster`` (master from spark-submit)."""
    if mode not in ("local", "cluster"):
        raise ValueError(f"mode must be 'local' or 'cluster', not {mode!r}")
    builder = SparkSession.builder.appName(app_name)
    if mode == "local" and "spark.master" not in settings:
        builder = builder.master("local[*]")
    builder = builder.config("spark.sql.session.timeZone", "UTC")
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
