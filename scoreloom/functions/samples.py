"""Feature vectors and rows in the form scoring and training read."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array as ml_vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_to_array(df: DataFrame, features: str = "features") -> DataFrame:
    """Replace a vector column by array<float>; float arrays pass unchanged.

    Null vectors become null arrays. The conversion raises on null, hence the guard.
    """
    kind = df.schema[features].dataType
    if isinstance(kind, VectorUDT):
        array = F.when(F.col(features).isNotNull(), ml_vector_to_array(features, "float32"))
    elif kind == T.ArrayType(T.FloatType(), kind.containsNull):
        return df
    else:
        array = F.col(features).cast("array<float>")
    return df.withColumn(features, array)


def sample_label(label: Column) -> Column:
    """Whole-number class id, truncated; NULL when not finite or not a number."""
    return label.try_cast("int")


def to_sample(df: DataFrame) -> DataFrame:
    """``features`` array<float>, ``label`` int, ``weight`` double; other columns unchanged."""
    out = vector_to_array(df)
    return out.withColumns({"label": sample_label(F.col("label")), "weight": F.col("weight").try_cast("double")})
