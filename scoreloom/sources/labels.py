"""The label dictionary: a table ``(label, class_name, n)``, position by frequency is the class id."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.sources.scratch import scratch_path


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so its size is known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_classes(counts: DataFrame) -> DataFrame:
    """``counts(class_name, n, ...)`` stored once, with ``label``: most frequent first, ties by name; a null is not a name and has none.

    Names are sorted by ranges; a name's number is its place in its range plus the
    sizes of the ranges before, so any number of names can be numbered. One size per range comes back.
    """
    order = [F.col("class_name").isNull(), F.desc("n"), F.col("class_name")]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id() % (1 << 33)
    placed = stored_table(ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}), "classes")
    sizes = dict(placed.groupBy("_range").agg(F.count("*")).collect())
    ranges = max(sizes, default=-1) + 1
    starts = F.array(*[F.lit(n) for n in accumulate((sizes.get(r, 0) for r in range(ranges)), initial=0)])
    label = F.when(F.col("class_name").isNotNull(), (starts[F.col("_range")] + F.col("_place")).cast("int"))
    return placed.select(label.alias("label"), *counts.columns)


def dictionary_of(numbered: DataFrame) -> DataFrame:
    return numbered.where(F.col("class_name").isNotNull()).select("label", "class_name", "n")


def fit_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(label, class_name, n)`` of a column of names, from a plain aggregation."""
    return dictionary_of(number_classes(df.groupBy(F.col(column).alias("class_name")).agg(F.count("*").alias("n"))))


def class_names(dictionary: DataFrame) -> list[str]:
    """Names in order of their ids, for a model, which has a row of weights per class."""
    return [r["class_name"] for r in sorted(dictionary.collect(), key=lambda r: r["label"])]


def load_class_names(path: str) -> list[str]:
    """Names of a saved indexer."""
    return list(StringIndexerModel.load(path).labels)


def class_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(label, class_name)``, one row per class of the dictionary."""
    return spark.createDataFrame(list(enumerate(names)), "label int, class_name string")


def label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return class_table(spark, load_class_names(path))


def load_metadata(spark: SparkSession, train_path: str, label_indexer_path: str, features: str = "scaled_features"):
    """``(num_features, num_classes, class_names)``; unreadable metadata is an error."""
    from scoreloom.sources.features import feature_width

    names = load_class_names(label_indexer_path)
    width = feature_width(spark.read.parquet(train_path), features)
    return width, len(names), names
