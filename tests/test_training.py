"""Scoring, gradients, training and whole runs."""

import dataclasses
import datetime
import pathlib
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from scoreloom.config import RunConfig
from scoreloom.functions import forward, scoring, updates
from scoreloom.functions.updates import TrainState
from scoreloom.model import Model, ModelShape, init_model
from scoreloom.operators import clean, sharding, training
from scoreloom.plans.evaluate import evaluate_performance
from scoreloom.plans.experiment import run_experiment
from scoreloom.plans.train import train_model
from scoreloom.registry.patterns import pattern_model
from scoreloom.sources import models
from scoreloom.sources.outputs import nested_report
from scoreloom.sources.scratch import scratch_path

SHAPE = ModelShape(num_features=3, num_classes=3, hidden_size=5, dropout=0.2)


def toy(spark, n=240, seed=3, num_classes=3):
    """Classes that follow the features, with uneven weights."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).astype(np.float32)
    y = x.argmax(axis=1)
    rows = [(i, x[i].tolist(), int(y[i]), 1.0 + (i % 3) / 2) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, features array<float>, label int, weight double")


def config(**changes):
    base = RunConfig(
        "", "", "", "", num_features=3, num_classes=3, hidden_size=5, batch_size=16, epochs=2, learning_rate=0.01, seed=4
    )
    return dataclasses.replace(base, **changes)


def gru_step(model: Model, x: np.ndarray) -> np.ndarray:
    """A full GRU step from a zero state, gates and all, as a check of the closed form."""
    h = model.shape.hidden_size
    p = x @ model.weights["input_projection"].T
    state = np.zeros((len(x), h))
    gi, gh = p @ model.weights["gru_input"].T, state @ model.weights["gru_hidden"].T
    sig = lambda a: 1 / (1 + np.exp(-a))
    r = sig(gi[:, :h] + gh[:, :h])
    z = sig(gi[:, h : 2 * h] + gh[:, h : 2 * h])
    n = np.tanh(gi[:, 2 * h :] + r * gh[:, 2 * h :])
    return ((1 - z) * n + z * state) @ model.weights["classifier"].T


def test_closed_form_equals_full_step():
    x = np.random.default_rng(0).normal(size=(50, 3))
    model = init_model(SHAPE, 1)
    assert np.allclose(forward.logits_of(model, x), gru_step(model, x), atol=1e-14)


def test_native_columns_on_edge_logits(spark):
    rows = [([0.1, 0.9, 0.9], 1), ([1000.0, 0.0, 0.0], 0), ([-1000.0, 0.0, 5.0], 2)]
    df = spark.createDataFrame(rows, "l array<double>, label int")
    out = df.select(
        scoring.predict_class(F.col("l")).alias("pred"),
        scoring.softmax_probs(F.col("l")).alias("p"),
        scoring.cross_entropy(F.col("l"), F.col("label")).alias("loss"),
    ).collect()
    assert [r["pred"] for r in out] == [1, 0, 2]
    assert out[1]["loss"] == pytest.approx(0.0) and np.isfinite([r["loss"] for r in out]).all()
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in out)


def test_fused_and_native_scores_agree(spark):
    df, model = toy(spark), init_model(SHAPE, 2)
    fused = scoring.score_rows(df, model).orderBy("row_id").collect()
    native = (
        df.withColumn("l", scoring.score_logits(model, "features"))
        .select(
            "row_id",
            scoring.predict_class(F.col("l")).alias("pred"),
            scoring.cross_entropy(F.col("l"), F.col("label")).alias("loss"),
            scoring.softmax_probs(F.col("l")).alias("p"),
        )
        .orderBy("row_id")
        .collect()
    )
    for a, b in zip(fused, native):
        assert a["pred"] == b["pred"] and a["loss"] == pytest.approx(b["loss"])
        assert a["probabilities"] == pytest.approx(b["p"])


def test_tally_equals_grouped_rows_under_any_partitioning(spark):
    df, model = toy(spark), init_model(SHAPE, 2)
    rows = scoring.score_rows(df, model).groupBy("label", "pred").agg(F.count("*"), F.sum("loss")).collect()
    want = {(r[0], r[1]): (r[2], pytest.approx(r[3])) for r in rows}
    for parts in (1, 7):
        got = scoring.tally_scores(df.repartition(parts), model).collect()
        assert {(r["label"], r["pred"]): (r["n"], r["loss_sum"]) for r in got} == want


def test_wide_vectors_are_scored_in_pieces(monkeypatch):
    x = np.random.default_rng(2).normal(size=(25, 3))
    column, model = forward.list_column(x), init_model(SHAPE)
    monkeypatch.setattr(forward, "CHUNK_VALUES", 12)
    assert [m.shape[0] for _, m in forward.feature_chunks(column, 3)] == [4] * 6 + [1]
    assert np.allclose(forward.logits_of_column([model], column, 3)[0], forward.logits_of(model, x))


@pytest.mark.parametrize("rows", [[([1.0, 2.0], 0)], [([1.0, 2.0, 3.0], 3)], [([1.0, 2.0, 3.0], -1)]])
def test_wrong_width_or_label_is_an_error(spark, rows):
    df = spark.createDataFrame(rows, "features array<float>, label int")
    with pytest.raises(Exception, match="width|outside"):
        scoring.tally_scores(df, init_model(SHAPE)).collect()


def test_model_round_trip_and_shape_check(spark):
    path, model = scratch_path(spark, "m"), init_model(SHAPE, 3)
    models.write_model(spark, init_model(SHAPE, 9), path, "a", 1)
    models.write_model(spark, model, path, "a", 4)
    models.write_model(spark, init_model(SHAPE, 8), path, "b", 5)
    back = models.read_model(spark, path, SHAPE, "a")
    assert (back.flatten() == model.flatten()).all()
    with pytest.raises(ValueError):
        models.read_model(spark, path, dataclasses.replace(SHAPE, hidden_size=6), "a")
    with pytest.raises(ValueError):
        models.read_model(spark, path, SHAPE, "missing")


def test_a_model_written_twice_or_cut_off_leaves_the_run_readable(spark, monkeypatch):
    path, first, second = scratch_path(spark, "m"), init_model(SHAPE, 1), init_model(SHAPE, 2)
    models.write_model(spark, first, path, "a", 3)
    models.write_model(spark, second, path, "a", 3)
    assert (models.read_model(spark, path, SHAPE, "a").flatten() == second.flatten()).all()
    assert models.saved_models(spark, path).count() == 4
    # A later epoch, of which some matrices are stored and none is committed.
    half = models.model_table(spark, init_model(SHAPE, 5), "a", 7).limit(2).withColumn("version", F.lit("cut"))
    half.write.mode("append").partitionBy("version").parquet(f"{path}/weights")
    assert (models.read_model(spark, path, SHAPE, "a").flatten() == second.flatten()).all()
    assert models.committed(spark, path).collect()[0]["epoch"] == 3
    # All matrices stored, and the writer lost before the commit.
    monkeypatch.setattr(models.F, "current_timestamp", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.write_model(spark, init_model(SHAPE, 6), path, "a", 8)
    monkeypatch.undo()
    assert (models.read_model(spark, path, SHAPE, "a").flatten() == second.flatten()).all()
    with pytest.raises(ValueError):
        models.read_model(spark, path, SHAPE, "a", 8)
    models.write_model(spark, first, path, "a", 8)
    assert (models.read_model(spark, path, SHAPE, "a").flatten() == first.flatten()).all()


def test_gradient_matches_differences():
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.uniform(0.5, 2, 20)
    model = init_model(SHAPE, 6)
    mask = updates.dropout_mask(0.3, np.arange(20), 5, (1, 2))
    flat = model.flatten()
    _, _, gradient = updates.loss_and_gradient(model, x, y, w / 20, mask)

    def loss_at(v):
        return float((w / 20 * updates.loss_and_gradient(Model.unflatten(SHAPE, v), x, y, w, mask)[0]).sum())

    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((loss_at(flat + step) - loss_at(flat - step)) / 2e-6, abs=1e-7)


def test_distributed_gradient_equals_local(spark):
    df, model = toy(spark), init_model(SHAPE, 6)
    rows = df.collect()
    x = np.array([r["features"] for r in rows], dtype=np.float64)
    y, w = np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
    _, _, want = updates.loss_and_gradient(model, x, y, w / len(y))
    got = training.batch_gradient(df.repartition(6), model).collect()
    flat = Model(SHAPE, {n: np.zeros(s) for n, s in SHAPE.matrix_shapes().items()})
    for r in got:
        flat.weights[r["name"]][r["row"], r["col"]] = r["value"]
    assert len(got) == SHAPE.num_parameters()
    assert np.allclose(flat.flatten(), want, atol=1e-14)


def test_step_decays_and_clips():
    state = TrainState.start(init_model(SHAPE, 1))
    before = state.params.copy()
    updates.adamw_step(state, np.zeros_like(before), 0.1)
    assert np.allclose(state.params, before * (1 - 0.1 * 0.01))
    big, small = TrainState.start(init_model(SHAPE, 1)), TrainState.start(init_model(SHAPE, 1))
    g = np.random.default_rng(1).normal(size=before.shape)
    updates.adamw_step(big, g * 1e6, 0.1)
    updates.adamw_step(small, g / np.linalg.norm(g), 0.1)
    assert np.allclose(big.mean, small.mean, rtol=1e-5)


def test_dropout_keeps_the_mean_and_follows_the_row():
    ids = np.arange(4000)
    mask = updates.dropout_mask(0.2, ids, 8, (1, 2, 3))
    assert mask.mean() == pytest.approx(1.0, abs=0.02)
    assert (mask[::-7] == updates.dropout_mask(0.2, ids[::-7], 8, (1, 2, 3))).all()
    assert (mask != updates.dropout_mask(0.2, ids, 8, (1, 2, 4))).any()
    assert updates.dropout_mask(0.0, ids, 4, (1,)) is None


def test_epoch_equals_plain_loop(spark):
    """Steps over stored blocks give what a loop over the same rows gives."""
    df, state = toy(spark, 100), TrainState.start(init_model(SHAPE, 1))
    stored = training.store_blocks(df, scratch_path(spark, "t"), 3, batch_size=16, seed=9)
    got, totals = training.train_epoch(stored, state, SHAPE, 0.01, epoch=2, seed=9)
    want, seen = state.copy(), 0
    for step, blocks in enumerate(stored.batches(2, 9)):
        inside = sharding.spread(F.col("row_id") + 9 * training.SEED_STRIDE, stored.num_blocks).isin(blocks)
        rows = df.where(inside).orderBy("row_id").collect()
        x, ids = np.array([r["features"] for r in rows], dtype=np.float64), np.array([r["row_id"] for r in rows])
        y, w = np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
        mask = updates.dropout_mask(0.2, ids, 5, (9, 2, step))
        _, _, g = updates.loss_and_gradient(want.model(SHAPE), x, y, w / len(y), mask)
        updates.adamw_step(want, g, 0.01)
        seen += len(rows)
        assert abs(len(rows) - 100 / 7) <= 8
    assert np.allclose(got.params, want.params, atol=1e-13) and got.steps == want.steps == 7
    assert totals.n == seen == stored.rows == 100 and sum(totals.shard_rows.values()) == 100


@pytest.mark.parametrize("num_shards, tasks", [(1, 1), (3, 2), (8, 1)])
def test_batches_differ_by_epoch_and_not_by_shards(spark, num_shards, tasks, monkeypatch):
    """Every epoch has each row once, in other company; a batch follows from seed, epoch and row alone."""
    monkeypatch.setattr(training, "ROWS_PER_SHARD", -(-4000 // (num_shards * tasks)))
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), F.array(F.col("id").cast("float")).alias("features"), F.lit(0).alias("label"), F.lit(1.0).alias("weight")
    )
    stored = training.store_blocks(df, scratch_path(spark, "t"), num_shards, batch_size=250, seed=3)
    assert len(stored.table.inputFiles()) == num_shards * tasks and stored.num_batches == 16
    batch_of, beside = {}, {}
    for epoch in (1, 2):
        for k, blocks in enumerate(stored.batches(epoch, 3)):
            ids = [r["row_id"] for r in stored.batch(blocks).select("row_id").collect()]
            assert abs(len(ids) - 250) <= 16
            batch_of.update({(epoch, i): k for i in ids})
    assert len(batch_of) == 8000
    for epoch in (1, 2):
        order = training.block_order(stored.num_blocks, epoch, 3).tolist()
        mixed = (np.arange(4000) + 3 * training.SEED_STRIDE) * sharding.SPREAD_FACTOR % sharding.SPREAD_MODULUS
        block = mixed * stored.num_blocks >> 31
        assert all(batch_of[epoch, i] == order.index(block[i]) // stored.per_batch for i in range(4000))
        beside[epoch] = [{i for i in range(4000) if batch_of[epoch, i] == k} for k in range(16)]
    shared = max(len(a & b) for a in beside[1] for b in beside[2])
    assert shared <= 4 * 250 // stored.per_batch


def test_block_order_is_a_permutation():
    for blocks, epoch, seed in ((1, 1, 0), (8, 2, 0), (1000, 3, 5), (100_000, 7, 1)):
        order = training.block_order(blocks, epoch, seed)
        assert sorted(order.tolist()) == list(range(blocks))
    one, two = training.block_order(1000, 1, 0), training.block_order(1000, 2, 0)
    # No trace of the first order is left in the second.
    assert abs(np.corrcoef(np.argsort(one), np.argsort(two))[0, 1]) < 0.15
    assert abs(np.corrcoef(np.argsort(one), np.arange(1000))[0, 1]) < 0.15


def test_result_does_not_depend_on_shards_or_partitions(spark):
    df = toy(spark, 200)
    runs = [
        train_model(spark, df.repartition(parts), None, config(num_shards=shards), "r")
        for parts, shards in ((1, 1), (5, 3), (2, 8))
    ]
    first, *others = (run.last_model.flatten() for run in runs)
    assert all(np.allclose(first, other, atol=1e-12) for other in others)
    pick = lambda r: [tuple(x)[2:6] for x in r.history.orderBy("epoch").collect()]
    assert np.allclose(pick(runs[0]), pick(runs[2]))


def test_merging_in_groups_changes_nothing(spark, monkeypatch):
    df, model = toy(spark, 200).repartition(9), init_model(SHAPE, 1)
    sums = []
    for fan_in in (64, 2, 1):
        monkeypatch.setattr(training, "FAN_IN", fan_in)
        sums.append(training.gradient_sums(df, model))
    assert all(s.n == 200 and np.allclose(s.vector, sums[0].vector, atol=1e-12) for s in sums)


def test_a_step_reads_the_shards_of_its_blocks(spark):
    stored = training.store_blocks(toy(spark, 400), scratch_path(spark, "t"), 10, num_batches=10, per_batch=2)
    rows = stored.batch([8, 13])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "shard#" in plan and "IN (4,6)" in plan.replace("shard", "") and "GreaterThanOrEqual(place," in plan
    assert {r["shard"] for r in rows.select("shard").distinct().collect()} == {4, 6} and abs(rows.count() - 40) <= 2


def test_marked_rows_are_left_out_of_training(spark):
    df = toy(spark, 200).withColumn("weight", F.when(F.col("row_id") % 10 != 3, F.col("weight")))
    marked = training.store_blocks(clean.mark_malformed(df), scratch_path(spark, "t"), 2, batch_size=50)
    dropped = training.store_blocks(clean.drop_malformed(df), scratch_path(spark, "t"), 2, batch_size=50)
    pick = lambda stored: sorted((r["row_id"], r["weight"], r["features"]) for r in stored.table.collect())
    assert marked.rows == dropped.rows == 180 and pick(marked) == pick(dropped)


STEP_SCRIPT = """
import json, pathlib, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from scoreloom.operators import training
from scoreloom.session import build_session
from scoreloom.sources.scratch import scratch_path
events = sys.argv[2]
spark = build_session(**{
    "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}",
    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": f"{events}/shared", "spark.driver.memory": "3g",
    # Bytes of vectored reads are missing from the metrics.
    "spark.hadoop.parquet.hadoop.vectored.io.enabled": "false"})
spark.sparkContext.setLogLevel("ERROR")
rows, batch = 1_000_000, 65_536
features = F.array(*[(F.xxhash64(F.lit(k), "id") / 2.0**63).cast("float") for k in range(16)])
df = spark.range(rows, numPartitions=4).select(F.col("id").alias("row_id"), features.alias("features"), (F.col("id") % 3).cast("int").alias("label"), F.rand(1).alias("weight"))
stored = training.store_blocks(df, scratch_path(spark, "t"), 1, batch_size=batch, source_rows=rows)
files = sum(p.stat().st_size for p in pathlib.Path(events).rglob("*.parquet"))
for blocks in stored.batches(1, 0)[:3]:
    spark.sparkContext.setJobGroup("step", "step")
    n = stored.batch(blocks).select("row_id", "features", "label", "weight").mapInArrow(lambda batches: batches, "row_id long, features array<float>, label int, weight double").count()
    assert abs(n - rows / stored.num_batches) < 100 and n <= batch, n
spark.stop()
stages, read, taken = set(), 0, 0
for line in next(p for p in pathlib.Path(events).iterdir() if p.name.startswith("local-")).open():
    e = json.loads(line)
    if e["Event"] == "SparkListenerJobStart" and e["Properties"].get("spark.jobGroup.id") == "step":
        stages.update(e["Stage IDs"])
    if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages:
        read += e["Task Metrics"]["Input Metrics"]["Bytes Read"]
        taken += e["Task Metrics"]["Input Metrics"]["Records Read"]
assert taken <= 3 * 1.2 * rows / stored.num_batches, taken
print("ratio", read / 3 / (files / stored.num_batches))
"""


def test_a_step_reads_at_most_twice_its_batch(tmp_path):
    """Bytes read by a step over a shard of 1,000,000 rows, from the event log."""
    root = pathlib.Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", STEP_SCRIPT, str(root), str(tmp_path)], capture_output=True, text=True, timeout=300, cwd="/")
    ratio = [line for line in done.stdout.splitlines() if line.startswith("ratio")]
    assert ratio, done.stderr[-2000:]
    assert 0.5 < float(ratio[0].split()[1]) <= 2.0, ratio


def test_same_seed_same_weights(spark):
    df, once = toy(spark), config(num_shards=3)
    a, b = (train_model(spark, df, None, once, "r").last_model.flatten() for _ in range(2))
    c = train_model(spark, df, None, dataclasses.replace(once, seed=5), "r").last_model.flatten()
    assert np.allclose(a, b, atol=1e-12) and not np.allclose(a, c)


def test_training_learns_and_keeps_the_best(spark):
    train, val = toy(spark, 600), toy(spark, 200, seed=8)
    path, seen = scratch_path(spark, "best"), scratch_path(spark, "history")
    result = train_model(
        spark, train, val, config(epochs=12, num_shards=2, learning_rate=0.03), "run", path, seen
    )
    rows = result.history.orderBy("epoch").collect()
    assert rows[-1]["train_loss"] < rows[0]["train_loss"]
    assert result.best_val_acc > 0.7
    assert result.best_epoch == min(r["epoch"] for r in rows if r["val_acc"] == result.best_val_acc)
    saved = models.read_model(spark, path, result.best_model.shape, "run")
    assert (saved.flatten() == result.best_model.flatten()).all()
    assert spark.read.json(seen).first()["epochs"] == 12
    assert {r["status"] for r in result.status().collect()} == {"SUCCESS"}


def test_training_beats_the_majority_class_of_the_given_table(spark, sf):
    from scoreloom.registry.datasets import embedding_samples

    df = embedding_samples(spark, sf, numbered=True)
    wide = config(num_features=64, num_classes=10, hidden_size=32, batch_size=32, epochs=15, learning_rate=0.01)
    result = train_model(spark, df, df, wide, "r")
    majority = df.groupBy("label").count().agg(F.max("count")).first()[0] / df.count()
    assert result.best_val_acc > 2 * majority


def test_no_validation_rows_means_no_best_model(spark):
    result = train_model(spark, toy(spark, 50), None, config(epochs=1), "r")
    assert result.best_model is None and result.best_val_acc == 0.0


def test_more_shards_than_rows(spark):
    result = train_model(spark, toy(spark, 5), None, config(epochs=1, num_shards=40), "r")
    counts = dict(result.status().groupBy("status").count().collect())
    assert counts["NO_DATA"] >= 35 and sum(counts.values()) == 40


def test_a_shard_that_loses_rows_is_an_error(spark):
    result = train_model(spark, toy(spark, 60), None, config(epochs=1, num_shards=4), "r")
    assert {r["status"] for r in result.status().collect()} == {"SUCCESS"}
    result.shard_rows[2] -= 1
    del result.shard_rows[3]
    assert [r["status"] for r in result.status().orderBy("shard").collect()] == ["SUCCESS", "SUCCESS", "ERROR", "ERROR"]


def test_no_training_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        train_model(spark, toy(spark, 5).where("false"), None, config(), "r")


def test_evaluation_with_and_without_stored_predictions(spark):
    df, model = toy(spark), pattern_model(SHAPE)
    names = ["x", "y", "z"]
    plain = evaluate_performance(df, model, names)
    stored = evaluate_performance(df, model, names, scratch_path(spark, "pred"))
    rounded = lambda e: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in e.as_rows().collect())
    assert rounded(plain) == rounded(stored)
    assert stored.predictions.count() == 240
    with pytest.raises(ValueError):
        evaluate_performance(df, model, ["x", "y"])


def test_whole_run(spark):
    folder = scratch_path(spark, "run")
    for name, seed in (("train", 1), ("val", 2), ("test", 3)):
        toy(spark, 300, seed).select(
            F.col("features").alias("scaled_features"), F.col("label").cast("double").alias("label"), "weight"
        ).write.parquet(f"{folder}/{name}_df.parquet")
    indexer = f"{folder}/indexer"
    names = spark.createDataFrame([("ddos",)] * 3 + [("scan",)] * 2 + [("web",)], "name string")
    StringIndexer(inputCol="name", outputCol="label").fit(names).write().save(indexer)
    run = RunConfig(
        f"{folder}/train_df.parquet", f"{folder}/test_df.parquet", indexer, f"{folder}/out",
        num_shards=2, epochs=5, batch_size=16, hidden_size=8, learning_rate=0.02,
    )
    done = run_experiment(spark, run, datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert done.output_dir == f"{folder}/out_20240102_030405"
    summary = spark.read.json(f"{done.output_dir}/experiment_summary").first()
    assert summary["training_results"]["status"] == "SUCCESS"
    assert summary["model_config"]["num_features"] == 3 and summary["model_config"]["num_classes"] == 3
    assert summary["test_results"]["test_accuracy"] == done.evaluation.overall.first()["accuracy"] > 0.5
    assert spark.read.parquet(f"{done.output_dir}/predictions").count() == 300
    report = nested_report(spark, f"{done.output_dir}/classification_report")
    assert report["total_samples"] == 300 and set(report["class_distribution"]) == {"ddos", "scan", "web"}
    info = spark.read.json(f"{done.output_dir}/model_info").first()
    assert info["total_parameters"] == 3 * 8 + 6 * 64 + 8 * 3
    assert models.saved_models(spark, f"{done.output_dir}/best_model").count() % 4 == 0
    confusion = spark.read.json(f"{done.output_dir}/confusion_matrix")
    assert {"label_name", "pred_name", "pct"} <= set(confusion.columns) and confusion.agg(F.sum("n")).first()[0] == 300
    history = spark.read.json(f"{done.output_dir}/training_history").first()
    assert len(history["train_losses"]) == len(history["val_accuracies"]) == history["epochs"] == 5


def test_command_line_fills_the_config():
    from scoreloom.__main__ import parse

    given = ["--train_path", "a", "--test_path", "b", "--label_indexer_path", "c", "--output_dir", "d"]
    default = parse(given)
    assert (default.epochs, default.batch_size, default.learning_rate) == (3, 512, 0.002)
    assert (default.hidden_size, default.dropout, default.num_shards, default.mode) == (64, 0.2, 1, "local")
    assert parse([*given, "--num_processes", "7"]).num_shards == 7
