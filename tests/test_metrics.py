"""Metrics and history on golden cases, and properties that must hold on any data."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions.text import format_metric, run_stamp
from scoreloom.operators import history, metrics, status
from scoreloom.plans.evaluate import compare_classes, compare_results
from scoreloom.sources.labels import class_table
from scoreloom.sources.outputs import REPORT_SCHEMA, nested_report, read_report, write_rows
from scoreloom.sources.scratch import scratch_path

PAIRS = "label int, pred int, loss double"


def tallies_of(spark, pairs):
    return metrics.tally(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], PAIRS))


def report_of(spark, pairs, names):
    tallies = tallies_of(spark, pairs)
    return tallies, metrics.class_report(tallies, class_table(spark, names), len(names))


def test_class_absent_from_truth(spark):
    tallies, report = report_of(spark, [(0, 0), (1, 1), (1, 2)], ["a", "b", "c"])
    rows = {r["class_name"]: r for r in report.collect()}
    assert (rows["c"]["support"], rows["c"]["recall"], rows["c"]["f1"]) == (0, 0.0, 0.0)
    assert rows["b"]["precision"] == 1.0 and rows["b"]["recall"] == 0.5
    grid = metrics.confusion_percent(metrics.confusion_counts(tallies, 3)).collect()
    assert len(grid) == 9
    assert all((r["pct"] is None) == (r["label"] == 2) for r in grid)


def test_class_outside_the_dictionary_is_an_error(spark):
    tallies, report = report_of(spark, [(0, 0), (1, 3)], ["a", "b", "c"])
    for df in (report, metrics.confusion_counts(tallies, 3)):
        with pytest.raises(Exception, match="outside"):
            df.collect()


def test_class_absent_everywhere_keeps_its_row(spark):
    _, report = report_of(spark, [(0, 0), (1, 0)], ["a", "b", "c"])
    assert {r["class_name"]: r["support"] for r in report.collect()} == {"a": 1, "b": 1, "c": 0}


def test_empty_table_has_zero_loss_and_accuracy(spark):
    row = metrics.overall(tallies_of(spark, [])).first()
    assert tuple(row) == (0, 0.0, 0.0)


def test_stored_report_is_nested_by_its_reader(spark):
    tallies, report = report_of(spark, [(0, 0), (1, 1), (1, 0)], ["b", "a"])
    rows = metrics.report_rows(report, metrics.report_averages(report, tallies))
    assert [r["class_name"] for r in rows.collect()] == ["b", "a", "accuracy", "macro avg", "weighted avg"]
    nested = nested_report(spark, write_rows(rows, scratch_path(spark, "r")))
    assert nested["total_samples"] == 3 and nested["num_classes"] == 2
    assert nested["class_distribution"] == {"b": 1, "a": 2}
    assert nested["accuracy"] == pytest.approx(2 / 3)
    assert nested["b"] == {"precision": 0.5, "recall": 1.0, "f1-score": pytest.approx(2 / 3), "support": 1}
    assert set(nested) == {"a", "b", "accuracy", "macro avg", "weighted avg", "total_samples", "num_classes", "class_distribution"}


def test_statistics_and_distribution(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "label int")
    assert sorted(map(tuple, metrics.data_statistics(df).collect())) == [(0, 2, 3, 2), (2, 1, 3, 2)]
    assert metrics.data_statistics(df.where("false")).count() == 0
    by = df.withColumn("split", F.when(F.col("label") == 0, "a").otherwise("b"))
    assert sorted(map(tuple, metrics.data_statistics(by, ("split",)).collect())) == [("a", 0, 2, 2, 1), ("b", 2, 1, 1, 1)]
    shares = dict(metrics.class_distribution(df, class_table(spark, ["a", "b", "c"])).collect())
    assert shares == {"a": 2, "b": 0, "c": 1}


def test_confusion_pairs_have_names_and_margins(spark):
    tallies = tallies_of(spark, [(0, 0), (1, 1), (1, 0), (1, 0)])
    pairs = metrics.confusion_pairs(tallies, class_table(spark, ["a", "b", "c"]))
    assert sorted(map(tuple, pairs.collect())) == [
        (0, "a", 0, "a", 1, 1, 3, 100.0), (1, "b", 0, "a", 2, 3, 3, pytest.approx(200 / 3)), (1, "b", 1, "b", 1, 3, 1, pytest.approx(100 / 3)),
    ]
    with pytest.raises(Exception, match="outside the dictionary"):
        metrics.confusion_pairs(tallies, class_table(spark, ["a"])).collect()


def test_twenty_thousand_classes(spark):
    """Pairs, statistics and reports hold rows for what occurs, written by several tasks; no grid and no row of all classes is made."""
    count = 20_000
    names = spark.range(count).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("class "), F.col("id")).alias("class_name"))
    rows = spark.range(60_000).select((F.col("id") % count).cast("int").alias("label"), ((F.col("id") * 7) % count).cast("int").alias("pred"), F.lit(0.5).alias("loss"))
    tallies = metrics.tally(rows)
    pairs = write_rows(metrics.confusion_pairs(tallies, names).orderBy("label", "pred"), scratch_path(spark, "pairs"))
    back = spark.read.json(pairs)
    assert back.count() == count and back.where("label_name = concat('class ', label) AND n = 3 AND pct = 100").count() == count
    report = metrics.class_report(tallies, names, count)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = write_rows(metrics.report_rows(report, metrics.report_averages(report, tallies)), scratch_path(spark, "report"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = read_report(spark, path, REPORT_SCHEMA)
    assert len(stored.inputFiles()) > 4 and stored.where("kind = 'class' AND total_samples = 60000 AND num_classes = 20000").count() == count
    stats = metrics.data_statistics(rows)
    assert stats.where("total_samples = 60000 AND num_classes = 20000 AND n = 3").count() == count
    for df in (stats, metrics.confusion_pairs(tallies, names), metrics.report_rows(report, metrics.report_averages(report, tallies))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "SinglePartition" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_properties(spark, pairs):
    tallies, report = report_of(spark, pairs, list("abcd"))
    grid = np.zeros((4, 4))
    for r in metrics.confusion_percent(metrics.confusion_counts(tallies, 4)).collect():
        grid[r["label"], r["pred"]] = r["n"]
    assert grid.sum() == len(pairs)
    for truth, guess in pairs:
        assert grid[truth, guess] > 0
    averages = {r["class_name"]: r for r in metrics.report_averages(report, tallies).collect()}
    acc = metrics.overall(tallies).first()["accuracy"]
    assert averages["weighted avg"]["recall"] == pytest.approx(acc)
    assert averages["accuracy"]["f1"] == pytest.approx(acc)
    for r in report.collect():
        tp, row, col = grid[r["label"], r["label"]], grid[r["label"]].sum(), grid[:, r["label"]].sum()
        assert r["recall"] == pytest.approx(tp / row if row else 0.0)
        assert r["precision"] == pytest.approx(tp / col if col else 0.0)
        p, q = r["precision"], r["recall"]
        assert r["f1"] == pytest.approx(2 * p * q / (p + q) if p + q else 0.0)
        assert r["support"] == row


def make_history(spark, accuracies, run_id="r"):
    rows = [(run_id, i + 1, 0.0, 0.0, 0.0, a, 0.0, 0.0) for i, a in enumerate(accuracies)]
    return spark.createDataFrame(rows, history.HISTORY_SCHEMA)


def test_first_epoch_at_the_maximum_wins(spark):
    df = make_history(spark, [0.5, 0.7, 0.7, 0.6])
    assert history.best_epoch(df).first()["epoch"] == 2
    assert [r["improved"] for r in history.mark_improvements(df).orderBy("epoch").collect()] == [True, True, False, False]


def test_no_best_epoch_at_zero_accuracy(spark):
    df = make_history(spark, [0.0, 0.0])
    assert history.best_epoch(df).count() == 0
    assert history.mark_improvements(df).where("improved").count() == 0


def test_snapshots_every_tenth_and_last(spark):
    df = make_history(spark, [0.1] * 23)
    assert [r["epoch"] for r in history.history_snapshots(df).orderBy("epoch").collect()] == [10, 20, 23]


def test_history_report_is_in_epoch_order(spark):
    df = make_history(spark, [0.3, 0.1, 0.2]).orderBy(F.desc("epoch"))
    row = history.history_report(df).first()
    assert row["val_acc"] == [0.3, 0.1, 0.2] and row["epochs"] == 3
    stored = history.stored_history(history.history_report(df))
    assert stored.columns == ["run_id", "train_losses", "train_accuracies", "val_losses", "val_accuracies", "epochs"]


def results(spark, *lists):
    """Finished results: rows of (true name, guessed name) under the ids of each model's own list."""
    out = {}
    for k, (names, pairs) in enumerate(lists):
        rows = [(names.index(a), names.index(b), 0.1 * (i + 1)) for i, (a, b) in enumerate(pairs)]
        out[f"m{k}"] = spark.createDataFrame(rows, PAIRS)
    return out, {f"m{k}": names for k, (names, _) in enumerate(lists)}


def test_models_of_different_class_lists(spark):
    """Every model is reported over its own names, whatever ids they have in the other's list."""
    three, five = ["a", "b", "c"], ["e", "c", "a", "d", "b"]
    first = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    second = [("e", "e"), ("d", "a"), ("c", "c"), ("a", "a"), ("a", "d")]
    found, lists = results(spark, (three, first), (five, second))
    got = {r["metric"]: (r["m0"], r["m1"]) for r in compare_results(found, lists).collect()}
    alone = [{r["metric"]: r["m"] for r in compare_results({"m": found[m]}, lists[m]).collect()} for m in ("m0", "m1")]
    assert {k: pytest.approx(v) for k, v in got.items()} == {k: (alone[0][k], alone[1][k]) for k in alone[0]}
    assert len(got) == 8
    classes = {(r["class_name"], r["metric"]): (r["m0"], r["m1"]) for r in compare_classes(found, lists).collect()}
    assert classes["a", "recall"] == (0.5, 0.5) and classes["a", "precision"] == (0.5, 0.5)
    assert classes["e", "support"] == (None, 1.0) and classes["b", "support"] == (1.0, 0.0)
    ids = {r["class_name"]: r["label"] for r in compare_classes(found, lists).collect()}
    assert ids == {"a": 0, "b": 1, "c": 2, "e": 3, "d": 4}


def test_a_class_outside_its_models_list_is_an_error(spark):
    found, lists = results(spark, (["a", "b"], [("a", "b")]), (["b", "c", "a"], [("c", "a")]))
    with pytest.raises(Exception, match="outside the list"):
        compare_results(found, lists | {"m1": ["b", "c"]}).collect()
    with pytest.raises(ValueError):
        compare_results(found, lists | {"m1": ["b", "c", "c"]})


def test_status_of_every_shard(spark):
    manifest = spark.createDataFrame([(0, 5), (1, 0), (2, 5)], "shard int, n_rows bigint")
    trained = spark.createDataFrame(
        [(0, 5, 1.5, 0.9), (2, 4, 1.5, 0.9)], "shard int, rows_trained bigint, seconds double, val_acc double"
    )
    rows = [tuple(r) for r in status.run_status(manifest, trained).orderBy("shard").collect()]
    assert rows == [(0, "SUCCESS", 1.5, 0.9), (1, "NO_DATA", None, 0.0), (2, "ERROR", None, 0.0)]


@pytest.mark.parametrize("value", [0.00015, 0.12345, 0.125, 1234567.00005, 0.5, 1e-9, 0.99995])
@pytest.mark.parametrize("decimals", [2, 4])
def test_metric_text_rounds_the_binary_value(spark, value, decimals):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(format_metric(F.col("v"), decimals)).first()[0] == f"{value:.{decimals}f}"


def test_run_stamp(spark):
    df = spark.sql("select timestamp'2024-02-03 04:05:06' as ts")
    assert df.select(run_stamp(F.col("ts"))).first()[0] == "20240203_040506"
