"""Shared folder for checkpoints and intermediate tables.

The folder named by ``spark.checkpoint.dir``; without that setting, a folder
under ``spark.sql.warehouse.dir``. Both are places every executor can reach, and
the rule is the same for every master.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable without overriding the cluster's setting."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_folder(spark)}/scoreloom/{name}-{uuid.uuid4().hex}"
