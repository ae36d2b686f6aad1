"""Rejecting rows that cannot become samples, with a reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.samples import sample_label, to_sample


# Why a row cannot become a sample, in the order in which the reasons are tried.
REASONS = ("null_features", "null_element", "null_label", "bad_label", "null_weight", "bad_weight")
# Column with the reason of a row that is on its way to a sink only to be counted there.
REASON = "_reason"


def reject_reason(df: DataFrame) -> Column:
    """Why a row cannot become a sample; NULL when it can."""
    label, weight = F.col("label"), F.col("weight")
    return (
        F.when(F.col("features").isNull(), "null_features")
        .when(_has_null(df), "null_element")
        .when(label.isNull(), "null_label")
        .when(sample_label(label).isNull(), "bad_label")
        .when(weight.isNull(), "null_weight")
        .when(weight.try_cast("double").isNull(), "bad_weight")
    )


def _has_null(df: DataFrame) -> Column:
    """Does an array of features hold a null; vectors cannot."""
    is_array = isinstance(df.schema["features"].dataType, T.ArrayType)
    return F.exists("features", lambda x: x.isNull()) if is_array else F.lit(False)


def usable(df: DataFrame) -> Column:
    """True where ``reject_reason`` is NULL, as a conjunction whose null checks reach the scan."""
    return (
        F.col("features").isNotNull()
        & F.col("label").isNotNull()
        & F.col("weight").isNotNull()
        & sample_label(F.col("label")).isNotNull()
        & F.col("weight").try_cast("double").isNotNull()
        & ~_has_null(df)
    )


def drop_malformed(df: DataFrame) -> DataFrame:
    """The usable rows in sample form. A projection and a filter: no extra pass over the data."""
    return to_sample(df.where(usable(df)))


def mark_malformed(df: DataFrame) -> DataFrame:
    """All rows in sample form; the rejected ones carry their reason and no values."""
    marked = df.withColumn(REASON, reject_reason(df))
    blank = {c: F.when(F.col(REASON).isNull(), F.col(c)).alias(c) for c in ("features", "label", "weight")}
    return to_sample(marked.select(*[blank.get(c, F.col(c)) for c in marked.columns]))


class RowCounts:
    """Rows kept and rejected, counted by the pass that writes them.

    Rejected rows travel, without values, to the tasks that write, are counted and
    removed there. So all counts come from the last stage of the write, of which Spark
    takes every partition's metrics once, however often its task or the tasks before it
    are repeated.
    """

    def __init__(self):
        self._seen = Observation()
        self._reasons = ()

    def watch(self, df: DataFrame) -> DataFrame:
        """``df`` without its rejected rows, counted once it is written."""
        kept = F.col(REASON).isNull() if REASON in df.columns else F.lit(True)
        self._reasons = REASONS if REASON in df.columns else ()
        seen = df.observe(self._seen, F.count_if(kept).alias("ok"), *[F.count_if(F.col(REASON) == r).alias(r) for r in self._reasons])
        return seen.where(kept).drop(REASON)

    def kept(self) -> int:
        return self._seen.get["ok"]

    def rejects(self, spark: SparkSession) -> DataFrame:
        """``(reason, n)`` as :func:`reject_counts` gives it."""
        found = self._seen.get
        return spark.createDataFrame([(r, found[r]) for r in ("ok", *self._reasons) if found[r]], "reason string, n bigint")


def reject_counts(df: DataFrame) -> DataFrame:
    """``(reason, n)`` with reason ``ok`` for the rows kept."""
    return (
        df.select(F.coalesce(reject_reason(df), F.lit("ok")).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )
