"""Deterministic, even shards and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# 2^31 and its golden-ratio fraction. Multiples of the ratio fall
# evenly over the unit interval, also along every n-th row, so that a split or
# filter on the key does not leave shards empty.
SPREAD_MODULUS = 1 << 31
SPREAD_FACTOR = 1_327_217_885


# A shard that one task sorts, writes or reads.
ROWS_PER_SHARD = 1_000_000


def shard_count(rows: int, at_least: int, rows_per_shard: int = ROWS_PER_SHARD) -> int:
    """Shards so that none outgrows a task, however large the table."""
    return max(at_least, -(-rows // rows_per_shard))


def place(row_id: Column) -> Column:
    """Row number to 0..2^31-1, evenly and one to one for any 2^31 numbers in a row."""
    return F.pmod(F.pmod(row_id, F.lit(SPREAD_MODULUS)) * F.lit(SPREAD_FACTOR), F.lit(SPREAD_MODULUS))


def spread(row_id: Column, n: int) -> Column:
    """Row number to 0..n-1, evenly; rises with the place."""
    return F.shiftright(place(row_id) * F.lit(n), 31).cast("int")


def assign_shards(df: DataFrame, num_shards: int) -> DataFrame:
    """Add ``shard`` from ``row_id``: no key takes part, so no hot key can fill a shard."""
    return df.withColumn("shard", spread(F.col("row_id"), num_shards))


def repartition_shards(df: DataFrame, num_shards: int) -> DataFrame:
    """One shuffle; partition k then holds exactly shard k."""
    return assign_shards(df, num_shards).repartitionById(num_shards, "shard")


def shard_manifest(df: DataFrame, num_shards: int, path: str | None = None) -> DataFrame:
    """``(shard, path, n_rows)`` for all shards, the empty ones with no path and 0 rows."""
    return _filled(df.groupBy("shard").agg(F.count("*").alias("n_rows")), num_shards, path)


def _filled(counts: DataFrame, num_shards: int, path: str | None) -> DataFrame:
    every = counts.sparkSession.range(num_shards).select(F.col("id").cast("int").alias("shard"))
    location = F.concat(F.lit(f"{path or ''}/shard="), F.col("shard"))
    # At most one row for each shard.
    return every.join(F.broadcast(counts), "shard", "left").select(
        "shard",
        F.when(F.col("n_rows") > 0, location if path else F.lit(None)).cast("string").alias("path"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
    )


def stored_manifest(files: DataFrame, num_shards: int, path: str) -> DataFrame:
    """The manifest of stored shards from ``files(shard, path, n_rows)``; one row per file comes back to be kept as a list."""
    held = files.groupBy("shard").agg(F.sum("n_rows").alias("n_rows")).toArrow()
    return _filled(files.sparkSession.createDataFrame(held), num_shards, path)


def drop_empty_shards(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("n_rows") > 0)


def shard_totals(manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(total_rows, valid_shards, num_shards)``, per group of ``by``."""
    return manifest.groupBy(*by).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("n_rows") > 0).alias("valid_shards"),
        F.count("*").alias("num_shards"),
    )


def manifest_by(df: DataFrame, num_shards: int, by: str, values: list[str]) -> DataFrame:
    """Manifest per value of ``by`` (a short known list such as the splits), gaps filled."""
    spark: SparkSession = df.sparkSession
    slots = spark.range(num_shards * len(values)).select(
        F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int")).alias(by),
        F.floor(F.col("id") / len(values)).cast("int").alias("shard"),
        F.lit(0).cast("bigint").alias("n_rows"),
    )
    counts = df.groupBy(by, "shard").agg(F.count("*").alias("n_rows"))
    return slots.unionByName(counts).groupBy(by, "shard").agg(F.sum("n_rows").alias("n_rows"))
