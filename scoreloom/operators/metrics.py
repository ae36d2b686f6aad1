"""Classification metrics, all derived from one small tally of the scored rows.

A tally is ``(label, pred, n, loss_sum)``, a row for each pair that occurs however large
the table, optionally repeated per value of ``by`` columns (such as the model).
Absent classes are kept by adding rows of zeros before the final sum, so no
dictionary join is needed to fill gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the name under which reports list the harmonic mean of precision and recall.
F1_FIELD = "f1-score"


def tally(scored: DataFrame, by: tuple[str, ...] = (), loss: str | None = "loss") -> DataFrame:
    """Count rows per (label, pred). The map side combines, so hot classes stay cheap."""
    loss_sum = F.sum(loss) if loss else F.sum(F.lit(None).cast("double"))
    return scored.groupBy(*by, F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")).agg(
        F.count("*").alias("n"), loss_sum.alias("loss_sum")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _known(column: str, num_classes: int) -> Column:
    """The class id itself; one outside the dictionary is an error, not a silently lost row."""
    outside = F.raise_error(F.concat(F.lit(f"{column} outside 0..{num_classes - 1}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return F.when(F.col(column).between(0, num_classes - 1), F.col(column)).otherwise(outside.cast("int")).alias(column)


def _group_rows(spark: SparkSession, cells: int, by: tuple[str, ...], values: list[str] | None) -> DataFrame:
    """``cells`` numbered slots per value of the single ``by`` column (or one set without it)."""
    if not by:
        return spark.range(cells).select(F.col("id").alias("_cell"))
    if len(by) != 1 or values is None:
        raise ValueError("give one grouping column and its values")
    names = F.array(*[F.lit(v) for v in values])
    return spark.range(cells * len(values)).select(
        (F.col("id") % cells).alias("_cell"),
        F.element_at(names, (F.floor(F.col("id") / cells) + 1).cast("int")).alias(by[0]),
    )


def overall(tallies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(total_samples, accuracy, loss)``; an empty table has accuracy and loss 0."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    correct = F.coalesce(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))), F.lit(0))
    return tallies.groupBy(*by).agg(
        total.alias("total_samples"),
        _ratio(correct.cast("double"), total).alias("accuracy"),
        _ratio(F.coalesce(F.sum("loss_sum"), F.lit(0.0)), total).alias("loss"),
    )


def mean_loss(tallies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return overall(tallies, by).select(*by, "loss")


def accuracy(tallies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return overall(tallies, by).select(*by, "accuracy")


def confusion_counts(
    tallies: DataFrame, num_classes: int, by: tuple[str, ...] = (), values: list[str] | None = None
) -> DataFrame:
    """``(label, pred, n)`` for every pair of classes, rows = truth."""
    grid = _group_rows(tallies.sparkSession, num_classes * num_classes, by, values).select(
        *by,
        F.floor(F.col("_cell") / num_classes).cast("int").alias("label"),
        (F.col("_cell") % num_classes).cast("int").alias("pred"),
        F.lit(0).cast("bigint").alias("n"),
    )
    seen = tallies.select(*by, _known("label", num_classes), _known("pred", num_classes), "n")
    cells = grid.unionByName(seen)
    return cells.groupBy(*by, "label", "pred").agg(F.sum("n").alias("n"))


def confusion_pairs(tallies: DataFrame, classes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The confusion matrix as the pairs that occur: ``(label, pred, n, label_total, pred_total, pct)``.

    The totals are the margins of the matrix, ``pct`` the share of the true class. With ``classes(label,
    class_name)`` the names of both are added; a class outside it is an error. There are no more rows than
    the table has different pairs, however many classes there are.
    """
    seen = tallies.groupBy(*by, "label", "pred").agg(F.sum("n").alias("n"))
    margin = lambda column: F.sum("n").over(Window.partitionBy(*by, column))
    pairs = seen.withColumns({"label_total": margin("label"), "pred_total": margin("pred")})
    pairs = pairs.withColumn("pct", F.lit(100.0) * F.col("n") / F.col("label_total"))
    if classes is None:
        return pairs
    for column in ("label", "pred"):
        names = classes.select(F.col("label").alias("_class"), F.col("class_name").alias(f"{column}_name"))
        unknown = F.raise_error(F.concat(F.lit(f"{column} outside the dictionary: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        pairs = pairs.join(names, F.col(column) == F.col("_class"), "left").drop("_class")
        pairs = pairs.withColumn(f"{column}_name", F.coalesce(F.col(f"{column}_name"), unknown.cast("string")))
    return pairs.select(*by, "label", "label_name", "pred", "pred_name", "n", "label_total", "pred_total", "pct")


def confusion_wide(confusion: DataFrame, num_classes: int) -> DataFrame:
    """One row per true class, one column per predicted class."""
    wide = confusion.groupBy("label").pivot("pred", list(range(num_classes))).agg(F.first("n"))
    return wide.select("label", *[F.col(str(k)).alias(f"pred_{k}") for k in range(num_classes)])


def confusion_percent(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``pct``, the share of the true class; NULL for a class without rows."""
    row_total = F.sum("n").over(Window.partitionBy(*by, "label"))
    return confusion.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), row_total))


def class_report(
    tallies: DataFrame,
    classes: DataFrame,
    num_classes: int,
    by: tuple[str, ...] = (),
    values: list[str] | None = None,
) -> DataFrame:
    """``(label, class_name, precision, recall, f1, support)`` for every class of the dictionary.

    A dictionary that has the ``by`` column itself has the classes of each group.
    """
    own = bool(by) and by[0] in classes.columns
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(zero)
    as_truth = F.struct(
        F.col("label"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")
    )
    as_guess = F.struct(
        F.col("pred").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")
    )
    seen = tallies.select(*by, _known("label", num_classes), _known("pred", num_classes), "n")
    pieces = seen.select(*by, F.inline(F.array(as_truth, as_guess)))
    slots = classes.select(*by, F.col("label").alias("_cell")) if own else _group_rows(tallies.sparkSession, num_classes, by, values)
    blank = slots.select(
        *by,
        F.col("_cell").cast("int").alias("label"),
        zero.alias("support"),
        zero.alias("predicted"),
        zero.alias("tp"),
    )
    sums = (
        blank.unionByName(pieces)
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )
    return sums.join(classes, [*by, "label"] if own else "label").select(
        *by,
        "label",
        "class_name",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(F.lit(2.0) * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame, tallies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``accuracy``, ``macro avg`` and ``weighted avg`` in the layout of the class report."""
    support = F.sum("support")
    wide = report.groupBy(*by).agg(
        support.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            _ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
        _ratio(F.sum(F.col("recall") * F.col("support")), support).alias("accuracy"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("class_name"),
            F.col(p).alias("precision"),
            F.col(r).alias("recall"),
            F.col(f).alias("f1"),
            F.col("support"),
        )
        for name, p, r, f in (
            ("accuracy", "accuracy", "accuracy", "accuracy"),
            ("macro avg", "macro_precision", "macro_recall", "macro_f1"),
            ("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
        )
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def report_full(report: DataFrame, averages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Class rows and average rows in one table, with the totals on every row."""
    columns = [*by, "class_name", "precision", "recall", "f1", "support"]
    totals = report.groupBy(*by).agg(F.sum("support").alias("total_samples"), F.count("*").cast("int").alias("num_classes"))
    rows = report.select(*columns).unionByName(averages.select(*columns))
    # One row per group.
    return (rows.join(F.broadcast(totals), list(by)) if by else rows.join(F.broadcast(totals), how="cross")).select(
        *columns, "total_samples", "num_classes"
    )


def report_rows(report: DataFrame, averages: DataFrame) -> DataFrame:
    """The full report in the form in which it is stored: a row per class and per average, in order, names as reports list them."""
    totals = report.agg(F.sum("support").alias("total_samples"), F.count("*").cast("int").alias("num_classes"))
    shown = lambda kind, at: [F.lit(kind).alias("kind"), at.alias("label"), F.col("class_name"), F.col("precision"), F.col("recall"), F.col("f1").alias(F1_FIELD), F.col("support")]
    rows = report.select(*shown("class", F.col("label"))).unionByName(averages.select(*shown("average", F.lit(None).cast("int"))))
    return rows.join(F.broadcast(totals), how="cross").orderBy(F.desc("kind"), "label", "class_name")


def data_statistics(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(label, n, total_samples, num_classes)``: a row per observed class, with the totals on every row."""
    counts = samples.groupBy(*by, "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total_samples"), F.count("*").alias("num_classes"))
    # One row per group.
    return (counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals), how="cross")).select(*by, "label", "n", "total_samples", "num_classes")


def class_distribution(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """``(class_name, n)`` with 0 for a class of the dictionary without rows; a label outside it is an error."""
    counts = samples.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    known = classes.select("class_name", F.col("label").alias("_label"))
    outside = F.raise_error(F.concat(F.lit("label outside the dictionary: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    return counts.join(known, F.col("label") == F.col("_label"), "full").select(
        F.when(F.col("_label").isNull(), outside).otherwise(F.col("class_name")).alias("class_name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def comparison(report: DataFrame, tallies: DataFrame, model_column: str, models: list[str]) -> DataFrame:
    """``(metric, <model>, ...)``: accuracy, loss and both averages of each metric, a column per model."""
    by = (model_column,)
    whole = overall(tallies, by).select(
        model_column,
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                F.struct(F.lit("loss").alias("metric"), F.col("loss").alias("value")),
            )
        ),
    )
    names = (("precision", "precision"), ("recall", "recall"), (F1_FIELD, "f1"))
    averaged = report_averages(report, tallies, by).where(F.col("class_name") != "accuracy").select(
        model_column,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(F.col("class_name"), F.lit(f"_{shown}")).alias("metric"), F.col(c).alias("value")
                    )
                    for shown, c in names
                ]
            )
        ),
    )
    stacked = whole.unionByName(averaged)
    return stacked.groupBy("metric").pivot(model_column, models).agg(F.first("value"))
