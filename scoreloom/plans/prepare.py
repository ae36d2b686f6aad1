"""From a stored table to samples and shards."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from scoreloom.operators.clean import REASON, RowCounts, drop_malformed, mark_malformed
from scoreloom.operators.sharding import ROWS_PER_SHARD, assign_shards, shard_totals, stored_manifest
from scoreloom.sources.features import file_offsets, scan_features
from scoreloom.sources.shards import read_shard, shard_files, write_shards


def load_samples(spark: SparkSession, path: str, **columns) -> DataFrame:
    """``(row_id, key, features, label, weight)`` in sample form, malformed rows left out."""
    return drop_malformed(scan_features(spark, path, **columns))


@dataclasses.dataclass(frozen=True)
class PreparedShards:
    """Stored shards, and what was counted while they were written."""

    path: str
    num_shards: int
    samples: DataFrame
    manifest: DataFrame
    rejects: DataFrame
    totals: DataFrame


def prepare_shards(
    spark: SparkSession, data_path: str, num_shards: int, output_path: str, tasks_per_shard: int | None = None, **columns
) -> PreparedShards:
    """Write the table as ``num_shards`` even shards, in one pass over its rows.

    Rejected rows are counted by that pass. The manifest is read from the footers of the files that were
    committed, and has to agree with the pass. How many tasks write a shard follows from the rows unless given.
    """
    offsets = file_offsets(spark, data_path)
    marked = mark_malformed(scan_features(spark, data_path, offsets=offsets, **columns))
    tasks = tasks_per_shard or max(1, -(-offsets.rows // (num_shards * ROWS_PER_SHARD)))
    counted = RowCounts()
    placed = assign_shards(marked, num_shards)
    write_shards(placed, output_path, num_shards, tasks, counted=counted)
    schema = placed.drop(REASON).schema
    manifest = stored_manifest(shard_files(spark, output_path, schema), num_shards, output_path)
    totals = shard_totals(manifest)
    stored = totals.first()["total_rows"]
    if stored != counted.kept():
        raise RuntimeError(f"{output_path}: {counted.kept()} rows were written, its files hold {stored}")
    return PreparedShards(output_path, num_shards, read_shard(spark, output_path, schema=schema), manifest, counted.rejects(spark), totals)
