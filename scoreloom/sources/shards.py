"""Shards as a Parquet table partitioned by shard id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.clean import RowCounts
from scoreloom.operators.sharding import spread


# Rows of a row group, the unit that readers take in.
CHUNK_ROWS = 50_000
# Bounds of the rows of a page, the least unit that a filter on a sorted column can read.
PAGE_ROWS = (128, 20_000)


def write_shards(
    df: DataFrame,
    path: str,
    num_shards: int,
    tasks_per_shard: int = 1,
    number: str = "row_id",
    order: str | None = None,
    group_rows: int = CHUNK_ROWS,
    counted: RowCounts | None = None,
) -> str:
    """Write ``df`` (with ``shard = spread(number, num_shards)``) under ``path/shard=k/``.

    Rows are moved once, straight to the task that writes them, so a task opens
    one directory only. ``tasks_per_shard`` splits shards over several writers,
    which are even slices of ``number`` whatever the keys are. Rows of a file are
    sorted by ``order`` if given; row groups hold at most ``group_rows`` rows, and pages an eighth, so that
    a filter on ``order`` reads little besides what it keeps. ``counted`` counts and removes
    rows on the way, see :class:`RowCounts`.
    """
    writers = num_shards * tasks_per_shard
    placed = df.withColumn("_writer", spread(F.col(number), writers)).repartitionById(writers, "_writer")
    if counted:
        placed = counted.watch(placed)
    if order:
        # The shard first, as the writer would otherwise sort by it alone and lose the order.
        placed = placed.sortWithinPartitions("shard", order)
    placed = placed.drop("_writer", *([number] if number.startswith("_") else []))
    group = min(CHUNK_ROWS, max(group_rows, PAGE_ROWS[0]))
    page = min(max(group // 8, PAGE_ROWS[0]), PAGE_ROWS[1])
    options = {"parquet.block.row.count.limit": str(group), "parquet.page.row.count.limit": str(page)}
    placed.write.mode("errorifexists").options(**options).partitionBy("shard").parquet(path)
    return path


def read_shard(spark: SparkSession, path: str, shard: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All shards, or one of them by partition pruning. With a ``schema`` no file is opened to plan the scan."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if shard is None else df.where(F.col("shard") == shard)


def shard_id_from_path(path: Column) -> Column:
    """Shard id of ``.../name_<id>.ext`` or ``.../shard=<id>/...``; NULL when there is none."""
    digits = F.regexp_extract(path, r"(?:shard=|_(?=\d+\.[^/]*$))(\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def shard_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """``(shard, path, n_rows)`` per stored file, from file names and footers only."""
    location = F.col("_metadata.file_path")
    return (
        read_shard(spark, path, schema=schema)
        .select(location.alias("path"))
        .groupBy("path")
        .agg(F.count("*").alias("n_rows"))
        .select(shard_id_from_path(F.col("path")).alias("shard"), "path", "n_rows")
    )
