"""The given tables in the form the operators read.

``embeddings`` is a ready feature table. ``lineitem`` gives volume: its four
numeric columns, scaled, are the features and ``l_returnflag`` names the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.samples import to_sample
from scoreloom.model import ModelShape
from scoreloom.operators.contract import fit_contract, index_labels, with_class_weights
from scoreloom.plans.prepare import load_samples
from scoreloom.registry.patterns import pattern_model
from scoreloom.sources.features import FileOffsets, read_numbered

EMBEDDING_SHAPE = ModelShape(num_features=64, num_classes=10, hidden_size=4)
EMBEDDING_MODEL = pattern_model(EMBEDDING_SHAPE)
EMBEDDING_CLASSES = [f"class_{k}" for k in range(10)]

LINEITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_SHAPE = ModelShape(num_features=4, num_classes=3, hidden_size=8)
LINEITEM_MODEL = pattern_model(LINEITEM_SHAPE)
LINEITEM_SHIFTS = {"model_a": 0, "model_b": 4, "model_c": 9}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embedding_samples(spark: SparkSession, sf: str, weighted: bool = False, numbered: bool = False) -> DataFrame:
    path = f"{sf}/embeddings.parquet"
    df = load_samples(spark, path, features="embedding", weight=None, key="vec_id", numbered=numbered)
    return with_class_weights(df, EMBEDDING_SHAPE.num_classes) if weighted else df


def lineitem_contract(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """``(scaled_features vector, label double)`` and the class names."""
    df = table(spark, sf, "lineitem")
    fitted = fit_contract(df, LINEITEM_COLUMNS, "l_returnflag")
    labelled = index_labels(df, "l_returnflag", fitted.dictionary)
    return labelled.select(fitted.scaler.as_vector().alias("scaled_features"), "label"), fitted.names


def lineitem_samples(
    spark: SparkSession, sf: str, weighted: bool = False, numbered: bool = False, offsets: FileOffsets | None = None
) -> tuple[DataFrame, list[str]]:
    """``([row_id,] features array<float>, label int, weight double)`` without going through vectors."""
    df = read_numbered(spark, f"{sf}/lineitem.parquet", offsets) if numbered else table(spark, sf, "lineitem")
    fitted = fit_contract(df, LINEITEM_COLUMNS, "l_returnflag")
    labelled = index_labels(df, "l_returnflag", fitted.dictionary)
    samples = to_sample(
        labelled.select(*(["row_id"] if numbered else []), fitted.scaler.as_array().alias("features"), "label", F.lit(1.0).alias("weight"))
    )
    return (with_class_weights(samples, len(fitted.names), fitted.counts) if weighted else samples), fitted.names


def flag_history(spark: SparkSession, sf: str) -> DataFrame:
    """A run history taken from ``lineitem``: runs are return flags, epochs are ship months."""
    df = table(spark, sf, "lineitem")
    epoch = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    n = F.count("*")
    return df.groupBy(F.col("l_returnflag").alias("run_id"), epoch.cast("int").alias("epoch")).agg(
        F.avg("l_tax").alias("train_loss"),
        F.avg("l_discount").alias("train_acc"),
        F.avg(F.col("l_extendedprice") / 1e5).alias("val_loss"),
        (F.floor(quantity * 2 / n) / 100).alias("val_acc"),
        n.cast("double").alias("train_s"),
        quantity.cast("double").alias("val_s"),
    )
