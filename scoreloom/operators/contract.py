"""Producing the input contract: scaled features, class ids, class weights, splits."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scoreloom.functions import forward
from scoreloom.functions.samples import vector_to_array


@dataclasses.dataclass(frozen=True)
class Scaler:
    """Mean and sample standard deviation per column."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stddevs: tuple[float, ...]

    def scaled(self) -> list[Column]:
        return [
            (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
            for c, m, s in zip(self.columns, self.means, self.stddevs)
        ]

    def as_array(self) -> Column:
        return F.array(*self.scaled())

    def as_vector(self) -> Column:
        return array_to_vector(self.as_array())


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregation over the table; two numbers per column come back."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    k = range(len(columns))
    return Scaler(
        tuple(columns),
        tuple(float(row[f"m{i}"]) for i in k),
        tuple(float(row[f"s{i}"] or 0.0) for i in k),
    )


@dataclasses.dataclass(frozen=True)
class VectorScaler:
    """Mean and sample standard deviation of each element of a vector column."""

    means: np.ndarray
    stddevs: np.ndarray

    def scaled(self, vectors: Column) -> Column:
        """The vectors, arrays of floats, scaled as ``array<double>``; null stays null, another width is an error, an element that never changes becomes 0."""
        means, factors = self.means, np.divide(1.0, self.stddevs, out=np.zeros_like(self.stddevs), where=self.stddevs > 0)

        @F.arrow_udf("array<double>")
        def scale(x: pa.Array) -> pa.Array:
            valid = x.drop_null() if x.null_count else x
            parts = [(part - means) * factors for _, part in forward.feature_chunks(valid, len(means))] if len(valid) else []
            rows = forward.list_column(np.concatenate(parts)) if parts else pa.array([], pa.list_(pa.float64()))
            if not x.null_count:
                return rows
            place = np.cumsum(np.asarray(x.is_valid())) - 1
            return rows.take(pa.array(place, pa.int64(), mask=np.asarray(x.is_null())))

        return scale(vectors)


def fit_vector_scaler(df: DataFrame, column: str = "features") -> VectorScaler:
    """One aggregation whose partial results, two vectors each, are merged in a tree; null vectors are left out, vectors of unequal widths are an error.

    ``column`` is a vector or an array of floats.
    """
    kind = df.schema[column].dataType
    vector = F.col(column) if isinstance(kind, VectorUDT) else array_to_vector(F.col(column).cast("array<double>"))
    found = df.where(F.col(column).isNotNull()).select(vector.alias("x"))
    # Grouped by a constant, so that no vectors give no row.
    row = found.groupBy(F.lit(True).alias("all")).agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s")).select("s.mean", "s.std").first()
    if row is None:
        raise ValueError("no vector to fit a scaler to")
    return VectorScaler(row["mean"].toArray(), row["std"].toArray())


def scale_vectors(df: DataFrame, column: str = "features", scaler: VectorScaler | None = None) -> DataFrame:
    """``df`` with its vector column, any width, scaled to ``array<double>``: one plan whatever the width."""
    scaler = scaler or fit_vector_scaler(df, column)
    return vector_to_array(df, column).withColumn(column, scaler.scaled(F.col(column)))


@dataclasses.dataclass(frozen=True)
class Contract:
    """What one aggregation by class gives: the scaler, and the names and row counts of the classes by class id.

    Both lists are as long as a model of these classes has rows of weights, which the driver holds.
    """

    scaler: Scaler
    names: list[str]
    counts: list[int]
    dictionary: DataFrame


def fit_contract(df: DataFrame, columns: list[str], label_column: str) -> Contract:
    """Scaler, dictionary ``(label, class_name, n)`` and class counts from one scan, for a model of these classes.

    Means and sums of squared deviations are taken per class; a row per class comes back, and they are put together for
    the scaler. A null name counts for the scaler only. Classes are numbered as in :func:`fit_dictionary`, which
    serves where there is no model to hold them.
    """
    kind = to_arrow_type(df.schema[label_column].dataType)
    rows = df.groupBy(F.col(label_column).alias("class_name")).agg(
        F.count("*").alias("n"),
        *[part(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, part in (("c", F.count), ("m", F.avg), ("v", F.var_pop))],
    ).collect()
    part = lambda name: np.array([[r[f"{name}{i}"] or 0.0 for i in range(len(columns))] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    count, mean, variance = part("c"), part("m"), part("v")
    total = count.sum(axis=0)
    means = np.divide((count * mean).sum(axis=0), total, out=np.zeros(len(columns)), where=total > 0)
    squares = (count * (variance + (mean - means) ** 2)).sum(axis=0)
    stddevs = np.sqrt(np.divide(squares, total - 1, out=np.zeros(len(columns)), where=total > 1))
    named = sorted((-r["n"], r["class_name"]) for r in rows if r["class_name"] is not None)
    names, counts = [name for _, name in named], [-n for n, _ in named]
    table = pa.table({"label": pa.array(range(len(names)), pa.int32()), "class_name": pa.array(names, kind), "n": pa.array(counts, pa.int64())})
    return Contract(Scaler(tuple(columns), tuple(means.tolist()), tuple(stddevs.tolist())), names, counts, df.sparkSession.createDataFrame(table))


def _unknown(what: str, column: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(column.cast("string"), F.lit("null"))))


def index_labels(df: DataFrame, column: str, dictionary: DataFrame, output: str = "label") -> DataFrame:
    """Class id of each name as double; a name outside the dictionary, or none, is an error."""
    known = dictionary.select(F.col("class_name").alias("_name"), F.col("label").cast("double").alias("_id"))
    found = F.coalesce("_id", _unknown("label outside the dictionary", F.col(column)).cast("double"))
    return df.join(known, F.col(column) == F.col("_name"), "left").withColumn(output, found).drop("_name", "_id")


def class_weights(df: DataFrame, num_classes: int) -> DataFrame:
    """``(label, n, weight)`` with weight ``N / (C * n)``; rare classes weigh more."""
    return weights_of(df.groupBy("label").agg(F.count("*").alias("n")), num_classes)


def weights_of(counts: DataFrame, num_classes: int) -> DataFrame:
    """The same from ``counts(label, n)``, one row per class."""
    total = counts.agg(F.sum("n").alias("_total"))
    weight = F.col("_total") / (F.lit(num_classes) * F.col("n"))
    return counts.join(total, how="cross").select("label", "n", weight.alias("weight"))


def with_class_weights(df: DataFrame, num_classes: int, counts: list[int] | None = None) -> DataFrame:
    """Add ``weight`` by class, from the counts by class id if at hand, else counted here.

    A label outside the dictionary, or none, is an error, at any number of classes.
    """
    # At most a row for each class of the model; the planner knows the size of such a list.
    if counts is None:
        found = df.where(F.col("label").between(0, num_classes - 1)).groupBy("label").agg(F.count("*").alias("n"))
        inside = {r["label"]: r["n"] for r in found.collect()}
    else:
        inside = dict(enumerate(counts))
    total = sum(inside.values())
    weights = pa.table({"_label": pa.array(inside, pa.int64()), "_weight": pa.array([total / (num_classes * n) for n in inside.values()], pa.float64())})
    known = df.sparkSession.createDataFrame(weights)
    found = F.coalesce("_weight", _unknown(f"label outside 0..{num_classes - 1}", F.col("label")).cast("double"))
    return df.join(known, F.col("label") == F.col("_label"), "left").withColumn("weight", found).drop("_label", "_weight")


def split_of(key: Column) -> Column:
    """Seven tenths train, one tenth val, two tenths test; copies of a key stay together."""
    bucket = F.pmod(key, F.lit(10))
    return F.when(bucket < 7, "train").when(bucket == 7, "val").otherwise("test")
