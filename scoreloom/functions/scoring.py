"""Row-wise scoring as Spark columns.

``score_logits`` crosses to Python once per Arrow batch, because a matrix product
written as literal expressions grows with hidden x features and leaves codegen.
Everything after the logits has a native column form here, and a fused form that
returns class, loss and probabilities from the same Arrow round trip.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import forward
from scoreloom.model import Model

# Layout of one scored row.
SCORE_TYPE = "struct<pred:int,loss:double,probabilities:array<double>>"
TALLY_SCHEMA = "model string, label int, pred int, n bigint, loss_sum double"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def score_logits(model: Model, features: str | Column) -> Column:
    """One logit per class, as array<double>."""
    width = model.shape.num_features

    @F.arrow_udf("array<double>")
    def logits(x: pa.Array) -> pa.Array:
        return forward.list_column(forward.logits_of_column([model], x, width)[0])

    return logits(features)


def predict_class(logits: Column) -> Column:
    """Position of the largest logit; the lowest class wins a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax_probs(logits: Column) -> Column:
    shifted = _let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return _let(
        shifted,
        lambda e: _let(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
            lambda total: F.transform(e, lambda v: v / total),
        ),
    )


def cross_entropy(logits: Column, label: Column) -> Column:
    """``logsumexp(logits) - logits[label]``, finite for large logits."""
    return _let(
        F.array_max(logits),
        lambda top: F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
        + top
        - F.element_at(logits, label + 1),
    )


def score_rows(df: DataFrame, model: Model, features: str = "features", label: str = "label") -> DataFrame:
    """Append ``pred``, ``loss`` and ``probabilities``; other columns stay in the JVM."""
    width, classes = model.shape.num_features, model.shape.num_classes

    @F.arrow_udf(SCORE_TYPE)
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        logits = forward.logits_of_column([model], x, width)[0]
        truth = y.to_numpy(zero_copy_only=False).astype(np.int64)
        forward.check_labels(truth, classes)
        loss, probabilities = forward.loss_and_softmax(logits, truth)
        return pa.StructArray.from_arrays(
            [pa.array(logits.argmax(axis=1).astype(np.int32)), pa.array(loss), forward.list_column(probabilities)],
            names=["pred", "loss", "probabilities"],
        )

    scored = df.withColumn("_score", score(F.col(features), F.col(label)))
    return scored.select(*df.columns, "_score.pred", "_score.loss", "_score.probabilities")


def tally_models(
    df: DataFrame, models: dict[str, Model], features: str = "features", label: str = "label"
) -> DataFrame:
    """``(model, label, pred, n, loss_sum)`` of several models from one scan: all the metrics
    need, at most classes^2 rows per model.

    Each Arrow batch is tallied where it was scored, so only a few counts per
    batch return to the JVM and only counts are shuffled; a class holding most
    rows costs nothing extra.
    """
    widths = {m.shape.num_features for m in models.values()}
    if len(widths) != 1:
        raise ValueError("models scored together must read the same features")
    width, named = widths.pop(), list(models.items())

    def tally(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scored = forward.logits_of_column([m for _, m in named], batch.column(0), width)
            truth = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for (name, model), logits in zip(named, scored):
                classes = model.shape.num_classes
                forward.check_labels(truth, classes)
                loss, _ = forward.loss_and_softmax(logits, truth)
                labels, preds, n, sums = forward.tally_pairs(truth, logits.argmax(axis=1), loss, classes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(n)),
                        pa.array(labels.astype(np.int32)),
                        pa.array(preds.astype(np.int32)),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums),
                    ],
                    names=["model", "label", "pred", "n", "loss_sum"],
                )

    partial = df.select(features, label).mapInArrow(tally, TALLY_SCHEMA)
    return partial.groupBy("model", "label", "pred").agg(F.sum("n").alias("n"), F.sum("loss_sum").alias("loss_sum"))


def tally_scores(df: DataFrame, model: Model, features: str = "features", label: str = "label") -> DataFrame:
    """``(label, pred, n, loss_sum)`` of one model."""
    return tally_models(df, {"model": model}, features, label).drop("model")
