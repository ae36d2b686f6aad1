"""Reading labelled feature-vector tables from Parquet."""

from __future__ import annotations

import dataclasses
import os

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclasses.dataclass(frozen=True)
class FileOffsets:
    """Rows before each file of a table, in order of their paths, and rows in all."""

    table: pa.Table
    rows: int


def file_offsets(spark: SparkSession, path: str) -> FileOffsets:
    """From a count per file, which reads Parquet footers and no column data.

    One row per file comes back; the driver holds that list anyway, to plan the scan.
    """
    return _offsets_of(spark.read.parquet(path))


def _offsets_of(df: DataFrame) -> FileOffsets:
    counts = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.xxhash64(F.col("path")).alias("file"))
    files = sorted(counts.collect(), key=lambda r: r["path"])
    # Two paths with one hash would share an offset: still one row each, only numbered less evenly.
    starts, rows = {}, 0
    for f in files:
        starts.setdefault(f["file"], rows)
        rows += f["n"]
    return FileOffsets(pa.table({"_file": pa.array(starts, pa.int64()), "_offset": pa.array(starts.values(), pa.int64())}), rows)


def read_numbered(spark: SparkSession, path: str, offsets: FileOffsets | None = None) -> DataFrame:
    """The table plus ``row_id``: 0..N-1 over all files, by position in the file.

    Unlike a key column, the position is unique even for rows that are copies of
    each other, and a retried task sees the same value; no sort and no
    shuffle of rows is needed.
    """
    df = spark.read.parquet(path)
    # Sixteen bytes a file, of a list that the driver holds: small whatever the files hold, and no reason to move their rows.
    starts = F.broadcast(spark.createDataFrame((offsets or _offsets_of(df)).table))
    return (
        df.select("*", F.col("_metadata.row_index").alias("row_id"), F.xxhash64("_metadata.file_path").alias("_file"))
        .join(starts, "_file")
        .withColumn("row_id", F.col("row_id") + F.col("_offset"))
        .drop("_file", "_offset")
    )


def scan_features(
    spark: SparkSession,
    path: str,
    features: str = "scaled_features",
    label: str = "label",
    weight: str | None = "weight",
    key: str | None = None,
    numbered: bool = True,
    offsets: FileOffsets | None = None,
) -> DataFrame:
    """``(row_id, key, features, label, weight)`` as stored, only these columns read.

    ``features`` may be a vector or an array of floats. Without a weight column
    every row weighs 1. ``row_id`` is needed for shards and batches only;
    ``numbered=False`` leaves it out, and ``key`` is there if named.
    """
    df = read_numbered(spark, path, offsets) if numbered else spark.read.parquet(path)
    kind = df.schema[features].dataType
    is_array = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    if not (is_array or isinstance(kind, VectorUDT)):
        raise TypeError(f"column {features!r} is {kind.simpleString()}, expected a vector or array of floats")
    return df.select(
        *(["row_id"] if numbered else []),
        *([F.col(key).alias("key")] if key else []),
        F.col(features).alias("features"),
        F.col(label).alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).alias("weight"),
    )


def split_path(train_path: str, split: str) -> str:
    """Where a split lies: ``<split>_df.parquet`` beside the training table."""
    return os.path.join(os.path.dirname(train_path.rstrip("/")), f"{split}_df.parquet")


def scan_split(spark: SparkSession, train_path: str, split: str, **columns) -> DataFrame:
    return scan_features(spark, split_path(train_path, split), **columns)


def _width(df: DataFrame, features: str):
    if isinstance(df.schema[features].dataType, VectorUDT):
        from pyspark.ml.functions import vector_to_array

        return F.size(vector_to_array(features, "float32"))
    return F.size(features)


def feature_width(df: DataFrame, features: str = "features") -> int:
    """Width of the first vector. Scoring and training reject any other width they meet."""
    row = df.where(F.col(features).isNotNull()).select(_width(df, features).alias("width")).first()
    if row is None:
        raise ValueError("no feature vector found")
    return int(row["width"])


def feature_width_range(df: DataFrame, features: str = "features") -> DataFrame:
    """``(min_width, max_width)`` over the whole table; reads every vector."""
    width = _width(df, features)
    return df.where(F.col(features).isNotNull()).agg(
        F.min(width).alias("min_width"), F.max(width).alias("max_width")
    )
