"""Cutting lineage at small or reused results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scoreloom.sources.scratch import ensure_checkpoints


def settle(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder, so several uses do not repeat the scan
    and a lost executor costs only a re-read."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
