"""One query per operator over the given tables; names and columns match ``oracle``."""

from __future__ import annotations

import dataclasses

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.config import RunConfig
from scoreloom.functions import samples, scoring
from scoreloom.functions.text import format_metric, run_stamp, stamped_output
from scoreloom.functions.updates import TrainState
from scoreloom.model import ModelShape, init_model
from scoreloom.operators import batches, clean, contract, history, metrics, sharding, status, training
from scoreloom.plans.evaluate import compare_classes, compare_models, compare_results, evaluate_performance, evaluate_test
from scoreloom.plans.prepare import load_samples, prepare_shards
from scoreloom.plans.settle import settle
from scoreloom.plans.train import train_model
from scoreloom.registry import datasets as D
from scoreloom.registry.patterns import pattern_model
from scoreloom.sources import features, labels, models, outputs, shards
from scoreloom.sources.scratch import scratch_path

# Least shard counts; larger tables get more, see ``_shards``.
SHARDS = 5
BATCH_SHARDS = 3
EPOCH_SHARDS = 8
BATCH = 32
MANY_SHARDS = 600
EPOCH_STEPS = 2
SHUFFLED_EPOCHS = 2
EPOCHS = 3
RATE = 0.002
# A batch that no table outgrows: every epoch is one step.
WHOLE_TABLE = 1 << 62


def _r6(column: Column) -> Column:
    return F.round(column, 6)


def _spell(array: str, size: int, prefix: str) -> list[Column]:
    """Array elements as rounded double columns."""
    return [_r6(F.col(array)[i].cast("double")).alias(f"{prefix}{i}") for i in range(size)]


def _shards(spark, sf, name: str, at_least: int, rows_per_shard: int = sharding.ROWS_PER_SHARD) -> int:
    """Shard count for a table, from its row count (Parquet footers only)."""
    return sharding.shard_count(D.table(spark, sf, name).count(), at_least, rows_per_shard)


def _logits(spark, sf):
    df = D.embedding_samples(spark, sf)
    return df.withColumn("logits", scoring.score_logits(D.EMBEDDING_MODEL, "features"))


def _embedding_tallies(spark, sf):
    return scoring.tally_scores(D.embedding_samples(spark, sf), D.EMBEDDING_MODEL)


def _label_tallies(spark, sf):
    pairs = D.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    return metrics.tally(pairs, loss=None)


# --- sources and sinks -------------------------------------------------------


def scan_features(spark: SparkSession, sf: str) -> DataFrame:
    df = features.scan_features(
        spark, f"{sf}/embeddings.parquet", features="embedding", weight=None, key="vec_id", numbered=False
    )
    return df.select(F.col("key").alias("vec_id"), "label", "weight", *_spell("features", 64, "f"))


def label_dictionary(spark, sf):
    return labels.fit_dictionary(D.table(spark, sf, "events"), "event_type").select("label", "class_name")


def feature_width(spark, sf):
    df = features.scan_features(
        spark, f"{sf}/embeddings.parquet", features="embedding", weight=None, key="vec_id", numbered=False
    )
    width = features.feature_width(df)
    return features.feature_width_range(df).withColumn("first_width", F.lit(width))


def scan_split(spark, sf):
    folder = scratch_path(spark, "splits")
    df = D.embedding_samples(spark, sf).withColumn("split", contract.split_of(F.col("key")))
    for split in ("train", "val", "test"):
        df.where(F.col("split") == split).drop("split").write.parquet(f"{folder}/{split}_df.parquet")
    train_path = f"{folder}/train_df.parquet"
    parts = [
        features.scan_split(spark, train_path, split, features="features", key="key", numbered=False).withColumn(
            "split", F.lit(split)
        )
        for split in ("train", "val", "test")
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("split", "label").agg(
        F.count("*").alias("n_rows"),
        F.sum("key").alias("key_sum"),
        _r6(F.sum(F.col("features")[0].cast("double"))).alias("f0_sum"),
    )


def _embedding_shards(spark, sf, tasks_per_shard=1):
    n = _shards(spark, sf, "embeddings", SHARDS)
    samples = sharding.assign_shards(D.embedding_samples(spark, sf, numbered=True), n)
    return shards.write_shards(samples, scratch_path(spark, "shards"), n, tasks_per_shard)


def write_shards(spark, sf):
    stored = shards.read_shard(spark, _embedding_shards(spark, sf, tasks_per_shard=2))
    return stored.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.sum("key").alias("key_sum"),
        F.sum("label").alias("label_sum"),
        _r6(F.sum(F.col("features")[63].cast("double"))).alias("f63_sum"),
    )


def read_shard(spark, sf):
    """One shard and the rest, each read by partition pruning."""
    path = _embedding_shards(spark, sf)
    others = shards.read_shard(spark, path).where(F.col("shard") > 0)
    whole = shards.read_shard(spark, path, 0).unionByName(others)
    return whole.select("shard", F.col("key").alias("vec_id"), "label", *_spell("features", 4, "f"))


def report_sink(spark, sf):
    """The class rows of a stored report, a row per class, written in order."""
    tallies, classes = settle(_embedding_tallies(spark, sf)), labels.class_table(spark, D.EMBEDDING_CLASSES)
    report = metrics.class_report(tallies, classes, 10)
    rows = metrics.report_rows(report, metrics.report_averages(report, tallies))
    stored = outputs.read_report(spark, outputs.write_rows(rows, scratch_path(spark, "report")), outputs.REPORT_SCHEMA)
    return _rounded_report(stored.where("kind = 'class'").withColumnRenamed(metrics.F1_FIELD, "f1"), "label", "class_name")


def _embedding_classes(spark, sf) -> DataFrame:
    return labels.fit_dictionary(D.table(spark, sf, "embeddings"), "label")


def _data_shape(spark, sf) -> ModelShape:
    """Model shape read off the table: width of its vectors, number of names in its dictionary."""
    width = features.feature_width(D.embedding_samples(spark, sf))
    return ModelShape(width, _embedding_classes(spark, sf).count(), hidden_size=16)


def _weights(spark, model, shape) -> DataFrame:
    """``(name, row, col, value)`` of a model's weights."""
    flat = spark.createDataFrame(list(enumerate(model.flatten().tolist())), "pos int, value double")
    return training.name_components(flat, shape).select("name", "row", "col", _r6(F.col("value")).alias("value"))


def _trained(spark, sf, model_path=None, num_shards=SHARDS):
    """Steps over all training rows from the pattern weights, without dropout, as SQL can repeat them."""
    samples = D.embedding_samples(spark, sf, weighted=True, numbered=True)
    split, shape = contract.split_of(F.col("key")), D.EMBEDDING_SHAPE
    train, val = samples.where(split == "train"), samples.where(split == "val")
    config = RunConfig(
        "", "", "", "", num_shards=num_shards, epochs=EPOCHS, batch_size=WHOLE_TABLE, learning_rate=RATE,
        hidden_size=shape.hidden_size, dropout=0.0, num_features=shape.num_features, num_classes=shape.num_classes,
    )
    return train_model(spark, train, val, config, "run", model_path, start=D.EMBEDDING_MODEL)


def model_sink(spark, sf):
    """Weights of the best epoch of a training run, stored and read back, value by value."""
    path = scratch_path(spark, "model")
    _trained(spark, sf, path)
    model = models.read_model(spark, path, D.EMBEDDING_SHAPE, "run")
    return _weights(spark, model, D.EMBEDDING_SHAPE)


def model_source(spark, sf):
    """Stored weights read back and used to score the table."""
    path = scratch_path(spark, "model")
    models.write_model(spark, D.EMBEDDING_MODEL, path, "run", 1)
    model = models.read_model(spark, path, D.EMBEDDING_SHAPE, "run")
    scored = scoring.score_rows(D.embedding_samples(spark, sf), model)
    return scored.select(F.col("key").alias("vec_id"), "pred", _r6(F.col("loss")).alias("loss"))


def prediction_sink(spark, sf):
    path = scratch_path(spark, "predictions")
    scored = scoring.score_rows(D.embedding_samples(spark, sf), D.EMBEDDING_MODEL).drop("features")
    stored = spark.read.parquet(outputs.write_predictions(scored, path))
    return stored.select(
        F.col("key").alias("vec_id"), "label", "pred", _r6(F.col("loss")).alias("loss"), *_spell("probabilities", 10, "p")
    )


def prepare(spark, sf):
    """Vectors stored under the input contract, then sharded; counted from the stored files."""
    df, _ = D.lineitem_contract(spark, sf)
    source = scratch_path(spark, "train_df.parquet")
    df.select("scaled_features", "label", F.lit(1.0).alias("weight")).write.parquet(source)
    prepared = prepare_shards(spark, source, _shards(spark, sf, "lineitem", SHARDS), scratch_path(spark, "prepared"))
    return prepared.manifest.select("shard", "n_rows")


# --- projections, filters, scalars -------------------------------------------


def vector_to_array_query(spark, sf):
    df = D.table(spark, sf, "embeddings").withColumn("embedding", array_to_vector(F.col("embedding").cast("array<double>")))
    return samples.vector_to_array(df, "embedding").select("vec_id", *_spell("embedding", 64, "f"))


def to_sample(spark, sf):
    raw = D.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.array(*D.LINEITEM_COLUMNS).alias("features"),
        (F.col("l_quantity") / 7).alias("label"),
        F.col("l_discount").alias("weight"),
    )
    values = [F.col("features")[i].cast("double").alias(f"f{i}") for i in range(4)]
    return samples.to_sample(raw).select("l_orderkey", "l_linenumber", "label", "weight", *values)


def _with_damage(spark, sf):
    """``lineitem`` as labelled rows, some made unusable by the value of other columns."""
    quantity = F.col("l_quantity")
    return D.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 6, F.array(*D.LINEITEM_COLUMNS)).alias("features"),
        F.when(quantity == 13, F.lit(float("nan")))
        .when(quantity == 17, F.lit(float("inf")))
        .when(quantity == 19, F.lit(None))
        .otherwise(quantity / 10)
        .alias("label"),
        F.when(F.col("l_tax") != 0.05, F.col("l_tax")).alias("weight"),
    )


def drop_malformed(spark, sf):
    kept = clean.drop_malformed(_with_damage(spark, sf))
    return kept.groupBy("label").agg(F.count("*").alias("n_rows"), _r6(F.sum("weight")).alias("weight_sum"))


def reject_counts(spark, sf):
    return clean.reject_counts(_with_damage(spark, sf))


def drop_empty_shards(spark, sf):
    df = sharding.assign_shards(D.embedding_samples(spark, sf, numbered=True), MANY_SHARDS)
    manifest = sharding.shard_manifest(df, MANY_SHARDS)
    return sharding.drop_empty_shards(manifest).select("shard", "n_rows")


def shard_id_from_path(spark, sf):
    files = shards.shard_files(spark, _embedding_shards(spark, sf))
    return files.groupBy("shard").agg(F.sum("n_rows").alias("n_rows"))


def run_stamp_query(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", run_stamp(F.col("ts")).alias("stamp"), stamped_output(F.col("event_type"), F.col("ts")).alias("output_dir")
    )


def format_metric_query(spark, sf):
    rate = F.col("l_discount") * F.col("l_tax")
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        format_metric(rate).alias("rate_4"),
        format_metric(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price_2"),
    )


# --- partitioning, manifest, batching ----------------------------------------


def repartition_shards(spark, sf):
    placed = sharding.repartition_shards(D.embedding_samples(spark, sf, numbered=True), _shards(spark, sf, "embeddings", SHARDS))
    return placed.select(F.col("key").alias("vec_id"), "shard", F.spark_partition_id().alias("partition"))


def shard_manifest(spark, sf):
    numbered = features.read_numbered(spark, f"{sf}/lineitem.parquet").select("row_id")
    manifest = sharding.shard_manifest(sharding.assign_shards(numbered, MANY_SHARDS), MANY_SHARDS)
    return manifest.select("shard", "n_rows")


def _numbered_embeddings(spark, sf) -> tuple[DataFrame, int, int]:
    """Weighted rows with their shards, how many shards, and how many rows."""
    path = f"{sf}/embeddings.parquet"
    offsets = features.file_offsets(spark, path)
    n = sharding.shard_count(offsets.rows, BATCH_SHARDS)
    samples = load_samples(spark, path, features="embedding", weight=None, key="vec_id", offsets=offsets)
    weighted = contract.with_class_weights(samples, D.EMBEDDING_SHAPE.num_classes)
    return sharding.assign_shards(weighted, n), n, offsets.rows


_BATCH_ENDS = (F.count, "*", "n_rows"), (F.min, "key", "first_key"), (F.max, "key", "last_key")


def minibatches(spark, sf):
    df, n, _ = _numbered_embeddings(spark, sf)
    batched = batches.numbered_minibatches(df, BATCH, n)
    return batched.groupBy("shard", "batch_id").agg(*[f(c).alias(name) for f, c, name in _BATCH_ENDS])


def minibatches_sliced(spark, sf):
    """The same by sorting, as tables with missing row numbers need it."""
    df, _, rows = _numbered_embeddings(spark, sf)
    batched = batches.minibatches(df, BATCH, slices=4, rows=rows)
    return batched.groupBy("shard", "batch_id").agg(*[f(c).alias(name) for f, c, name in _BATCH_ENDS])


def minibatches_shuffled(spark, sf):
    df, n, rows = _numbered_embeddings(spark, sf)
    return batches.batch_sizes(batches.numbered_minibatches(df, BATCH, n, shuffle=(1, 7), rows=rows))


# --- aggregations ------------------------------------------------------------


def shard_totals(spark, sf):
    numbered = features.read_numbered(spark, f"{sf}/embeddings.parquet").select("row_id", "vec_id")
    split = sharding.assign_shards(numbered, MANY_SHARDS).withColumn("split", contract.split_of(F.col("vec_id")))
    manifest = sharding.manifest_by(split, MANY_SHARDS, "split", ["train", "val", "test"])
    return sharding.shard_totals(manifest, ("split",))


def data_statistics(spark, sf):
    events = D.table(spark, sf, "events")
    indexed = contract.index_labels(events, "event_type", labels.fit_dictionary(events, "event_type"))
    return metrics.data_statistics(indexed.select(F.col("label").cast("int").alias("label")))


def class_distribution(spark, sf):
    classes = labels.class_table(spark, [f"class_{k}" for k in range(12)])  # two without rows
    return metrics.class_distribution(D.embedding_samples(spark, sf), classes)


def mean_loss(spark, sf):
    samples, _ = D.lineitem_samples(spark, sf)
    out = metrics.mean_loss(scoring.tally_scores(samples, D.LINEITEM_MODEL))
    return out.select(_r6(F.col("loss")).alias("loss"))


def weighted_loss(spark, sf):
    """Rows are scored and batched where they lie; only a sum for each batch moves."""
    df, n, _ = _numbered_embeddings(spark, sf)
    scored = scoring.score_rows(df, D.EMBEDDING_MODEL).select("shard", "row_id", "loss", "weight")
    out = batches.weighted_batch_loss(batches.numbered_minibatches(scored, BATCH, n))
    return out.select("shard", "batch_id", _r6(F.col("weighted_loss")).alias("weighted_loss"))


def accuracy(spark, sf):
    samples, _ = D.lineitem_samples(spark, sf)
    out = metrics.accuracy(scoring.tally_scores(samples, D.LINEITEM_MODEL))
    return out.select(_r6(F.col("accuracy")).alias("accuracy"))


def confusion_counts(spark, sf):
    return metrics.confusion_counts(_embedding_tallies(spark, sf), 10)


def confusion_wide(spark, sf):
    samples, _ = D.lineitem_samples(spark, sf)
    counts = metrics.confusion_counts(scoring.tally_scores(samples, D.LINEITEM_MODEL), 3)
    return metrics.confusion_wide(counts, 3)


def confusion_percent(spark, sf):
    """Quality against toxicity, in a grid of three classes of which one never occurs."""
    shares = metrics.confusion_percent(metrics.confusion_counts(_label_tallies(spark, sf), 3))
    return shares.select("label", "pred", "n", _r6(F.col("pct")).alias("pct"))


def confusion_pairs(spark, sf):
    """The pairs of classes that occur, with names, margins and shares, stored and read back."""
    classes = labels.class_table(spark, D.EMBEDDING_CLASSES)
    pairs = metrics.confusion_pairs(_embedding_tallies(spark, sf), classes).orderBy("label", "pred")
    stored = outputs.read_report(spark, outputs.write_rows(pairs, scratch_path(spark, "confusion")), CONFUSION_SCHEMA)
    return stored.withColumn("pct", _r6(F.col("pct")))


CONFUSION_SCHEMA = (
    "label int, label_name string, pred int, pred_name string, n bigint, label_total bigint, pred_total bigint, pct double"
)


def _rounded_report(report: DataFrame, *keep: str) -> DataFrame:
    return report.select(*keep, *[_r6(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], "support")


def class_report(spark, sf):
    classes = labels.class_table(spark, D.EMBEDDING_CLASSES)
    return _rounded_report(metrics.class_report(_embedding_tallies(spark, sf), classes, 10), "label", "class_name")


def report_averages(spark, sf):
    tallies = _label_tallies(spark, sf)
    report = metrics.class_report(tallies, labels.class_table(spark, ["low", "high", "never"]), 3)
    return _rounded_report(metrics.report_averages(report, tallies), "class_name")


def report_full(spark, sf):
    samples, names = D.lineitem_samples(spark, sf)
    full = evaluate_performance(samples, D.LINEITEM_MODEL, names).full
    return _rounded_report(full, "class_name", "total_samples", "num_classes")


def evaluate_performance_query(spark, sf):
    samples, names = D.lineitem_samples(spark, sf)
    rows = evaluate_performance(samples, D.LINEITEM_MODEL, names, scratch_path(spark, "predictions")).as_rows()
    return rows.select("section", "name", "metric", _r6(F.col("value")).alias("value"))


def compare_models_query(spark, sf):
    samples, names = D.lineitem_samples(spark, sf)
    many = {name: pattern_model(D.LINEITEM_SHAPE, shift) for name, shift in D.LINEITEM_SHIFTS.items()}
    out = compare_models(samples, many, names)
    return out.select("metric", *[_r6(F.col(name)).alias(name) for name in many])


def compare_results_query(spark, sf):
    """The comparison from stored predictions, a table for each model."""
    samples, names = D.lineitem_samples(spark, sf)
    stored = {}
    for name, shift in D.LINEITEM_SHIFTS.items():
        scored = scoring.score_rows(samples, pattern_model(D.LINEITEM_SHAPE, shift)).drop("features")
        stored[name] = spark.read.parquet(outputs.write_predictions(scored, scratch_path(spark, "predictions")))
    out = compare_results(stored, names)
    return out.select("metric", *[_r6(F.col(name)).alias(name) for name in stored])


# Class lists of two results over ``lineitem`` that share some names, under other ids.
CLASS_LISTS = {"flags": ["A", "N", "R"], "mixed": ["O", "R", "F", "N", "A"]}


def _listed_results(spark, sf) -> dict[str, DataFrame]:
    """Two results with class lists of their own: guesses taken from other columns of a line."""
    line = D.table(spark, sf, "lineitem")
    ids = {model: F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))]) for model, names in CLASS_LISTS.items()}
    flag, status_, three = F.col("l_returnflag"), F.col("l_linestatus"), F.element_at(F.array(*map(F.lit, CLASS_LISTS["flags"])), F.col("l_linenumber") % 3 + 1)
    mixed = F.when(F.col("l_linenumber") % 2 == 0, flag).otherwise(status_)
    guess = F.when(F.col("l_quantity") < 25, status_).otherwise(flag)
    return {
        "flags": line.select(ids["flags"][flag].alias("label"), ids["flags"][three].alias("pred"), F.col("l_tax").alias("loss")),
        "mixed": line.where("l_linenumber < 6").select(ids["mixed"][mixed].alias("label"), ids["mixed"][guess].alias("pred"), F.col("l_discount").alias("loss")),
    }


def compare_class_lists(spark, sf):
    """The comparison of a result of three classes and one of five."""
    out = compare_results(_listed_results(spark, sf), CLASS_LISTS)
    return out.select("metric", *[_r6(F.col(name)).alias(name) for name in CLASS_LISTS])


def compare_classes_query(spark, sf):
    """Class by class, over the names of both."""
    out = compare_classes(_listed_results(spark, sf), CLASS_LISTS)
    return out.select("label", "class_name", "metric", *[_r6(F.col(name)).alias(name) for name in CLASS_LISTS])


def experiment_summary(spark, sf):
    """Runs named by order status; only those that also occur as line status were evaluated."""
    trained = D.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("run_id")).agg(
        F.lit("TRAINED").alias("status"),
        F.count("*").cast("double").alias("total_training_time"),
        F.max("o_totalprice").alias("best_val_acc"),
    )
    evaluated = D.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("run_id")).agg(
        F.lit("SUCCESS").alias("status"),
        F.max("l_discount").alias("test_accuracy"),
        F.max("l_extendedprice").alias("test_loss"),
    )
    settings = RunConfig("", "", "", "", num_features=4, num_classes=3)
    literal = F.struct(*[F.lit(v).alias(k) for k, v in settings.to_dict().items() if k not in ("val_path", "class_names")])
    out = status.experiment_summary(trained, evaluated, literal)
    return out.select(
        F.col("experiment_info.timestamp").alias("run_timestamp"),
        F.col("experiment_info.mode").alias("mode"),
        F.col("experiment_info.num_shards").alias("num_shards"),
        *[F.col(f"model_config.{n}").alias(n) for n in ("num_features", "num_classes", "hidden_size", "batch_size", "epochs")],
        *[F.col(f"model_config.{n}").alias(n) for n in ("dropout", "learning_rate")],
        *[F.col(f"training_results.{n}").alias(n) for n in ("status", "total_training_time", "best_validation_accuracy")],
        *[F.col(f"test_results.{n}").alias(n) for n in ("test_accuracy", "test_loss")],
    )


# --- run history -------------------------------------------------------------


def epoch_history(spark, sf):
    report = history.history_report(D.flag_history(spark, sf))
    zipped = F.arrays_zip(*history.SERIES)
    rows = report.select("run_id", "epochs", F.posexplode(zipped).alias("pos", "row"))
    return rows.select(
        "run_id", "epochs", "pos", *[_r6(F.col(f"row.{s}")).alias(s) for s in history.SERIES]
    )


def best_epoch(spark, sf):
    return history.best_epoch(D.flag_history(spark, sf))


def improved_epochs(spark, sf):
    marked = history.mark_improvements(D.flag_history(spark, sf))
    return marked.select("run_id", "epoch", "val_acc", "improved")


def history_snapshots(spark, sf):
    kept = history.history_snapshots(D.flag_history(spark, sf))
    return kept.select("run_id", "epoch", "val_acc", "train_s")


# --- row-wise scoring --------------------------------------------------------


def score_logits(spark, sf):
    return _logits(spark, sf).select(F.col("key").alias("vec_id"), *_spell("logits", 10, "l"))


def predict_class(spark, sf):
    return _logits(spark, sf).select(F.col("key").alias("vec_id"), scoring.predict_class(F.col("logits")).alias("pred"))


def softmax_probs(spark, sf):
    scored = _logits(spark, sf).withColumn("p", scoring.softmax_probs(F.col("logits")))
    return scored.select(F.col("key").alias("vec_id"), *_spell("p", 10, "p"))


def cross_entropy(spark, sf):
    loss = scoring.cross_entropy(F.col("logits"), F.col("label"))
    return _logits(spark, sf).select(F.col("key").alias("vec_id"), _r6(loss).alias("loss"))


def evaluate_test_query(spark, sf):
    path = scratch_path(spark, "model")
    models.write_model(spark, D.EMBEDDING_MODEL, path, "run", 1)
    result = evaluate_test(D.embedding_samples(spark, sf), path, D.EMBEDDING_SHAPE, "run", D.EMBEDDING_CLASSES)
    return _rounded_report(result.report, "label", "class_name")


# --- training ----------------------------------------------------------------


def train_epoch(spark, sf):
    """Two epochs over all of ``lineitem``, each in two steps of its own batches: the weights after them."""
    offsets = features.file_offsets(spark, f"{sf}/lineitem.parquet")
    samples, _ = D.lineitem_samples(spark, sf, weighted=True, numbered=True, offsets=offsets)
    n = sharding.shard_count(offsets.rows, EPOCH_SHARDS)
    stored = training.store_blocks(samples, scratch_path(spark, "training"), n, num_batches=EPOCH_STEPS, source_rows=offsets.rows)
    shape = dataclasses.replace(D.LINEITEM_SHAPE, dropout=0.0)
    state = TrainState.start(D.LINEITEM_MODEL)
    for epoch in range(1, SHUFFLED_EPOCHS + 1):
        state, _ = training.train_epoch(stored, state, shape, RATE, epoch)
    return _weights(spark, state.model(shape), shape)


def batch_gradient(spark, sf):
    out = training.batch_gradient(D.embedding_samples(spark, sf, weighted=True), D.EMBEDDING_MODEL)
    return out.select("name", "row", "col", F.round("value", 7).alias("value"))


def train_model_query(spark, sf):
    history_ = _trained(spark, sf).history
    return history_.select("run_id", "epoch", *[_r6(F.col(c)).alias(c) for c in ("train_loss", "train_acc", "val_loss", "val_acc")])


def run_status(spark, sf):
    """Status of the shards of a training run, of which there are more than rows."""
    result = _trained(spark, sf, num_shards=MANY_SHARDS)
    return result.status().select("shard", "status", _r6(F.col("best_val_acc")).alias("best_val_acc"))


def model_info(spark, sf):
    """A model for the table's width and classes, stored, and described from the stored weights."""
    shape, path = _data_shape(spark, sf), scratch_path(spark, "model")
    models.write_model(spark, init_model(shape), path, "run", 1)
    return models.model_info(models.saved_models(spark, path), shape).drop("epoch")


# --- input contract ----------------------------------------------------------


def scale_features(spark, sf):
    df = D.table(spark, sf, "lineitem")
    scaler = contract.fit_scaler(df, D.LINEITEM_COLUMNS)
    scaled = df.select("l_orderkey", "l_linenumber", scaler.as_array().alias("z"))
    return scaled.select("l_orderkey", "l_linenumber", *_spell("z", 4, "z"))


def scale_vectors(spark, sf):
    """A stored vector column, scaled by the moments of its elements."""
    scaled = contract.scale_vectors(D.table(spark, sf, "embeddings"), "embedding")
    return scaled.select("vec_id", *_spell("embedding", 64, "z"))


def index_labels(spark, sf):
    events = D.table(spark, sf, "events")
    out = contract.index_labels(events, "event_type", labels.fit_dictionary(events, "event_type"))
    return out.select("event_id", F.col("label").cast("int").alias("label"))


def class_weights(spark, sf):
    fitted = contract.fit_contract(D.table(spark, sf, "lineitem"), D.LINEITEM_COLUMNS, "l_returnflag")
    out = contract.weights_of(fitted.dictionary.select("label", "n"), 3)
    return out.select("label", "n", _r6(F.col("weight")).alias("weight"))


def split_rows(spark, sf):
    return D.table(spark, sf, "events").select("event_id", contract.split_of(F.col("event_id")).alias("split"))


QUERIES = {
    "scan_features": scan_features,
    "label_dictionary": label_dictionary,
    "feature_width": feature_width,
    "scan_split": scan_split,
    "write_shards": write_shards,
    "read_shard": read_shard,
    "report_sink": report_sink,
    "model_sink": model_sink,
    "model_source": model_source,
    "prediction_sink": prediction_sink,
    "prepare_shards": prepare,
    "vector_to_array": vector_to_array_query,
    "to_sample": to_sample,
    "drop_malformed": drop_malformed,
    "reject_counts": reject_counts,
    "drop_empty_shards": drop_empty_shards,
    "shard_id_from_path": shard_id_from_path,
    "run_stamp": run_stamp_query,
    "format_metric": format_metric_query,
    "repartition_shards": repartition_shards,
    "shard_manifest": shard_manifest,
    "minibatches": minibatches,
    "minibatches_sliced": minibatches_sliced,
    "minibatches_shuffled": minibatches_shuffled,
    "shard_totals": shard_totals,
    "data_statistics": data_statistics,
    "class_distribution": class_distribution,
    "mean_loss": mean_loss,
    "weighted_loss": weighted_loss,
    "accuracy": accuracy,
    "confusion_counts": confusion_counts,
    "confusion_wide": confusion_wide,
    "confusion_pairs": confusion_pairs,
    "confusion_percent": confusion_percent,
    "class_report": class_report,
    "report_averages": report_averages,
    "report_full": report_full,
    "evaluate_performance": evaluate_performance_query,
    "compare_models": compare_models_query,
    "compare_results": compare_results_query,
    "compare_class_lists": compare_class_lists,
    "compare_classes": compare_classes_query,
    "experiment_summary": experiment_summary,
    "epoch_history": epoch_history,
    "best_epoch": best_epoch,
    "improved_epochs": improved_epochs,
    "history_snapshots": history_snapshots,
    "score_logits": score_logits,
    "predict_class": predict_class,
    "softmax_probs": softmax_probs,
    "cross_entropy": cross_entropy,
    "evaluate_test": evaluate_test_query,
    "train_epoch": train_epoch,
    "batch_gradient": batch_gradient,
    "train_model": train_model_query,
    "run_status": run_status,
    "model_info": model_info,
    "scale_features": scale_features,
    "scale_vectors": scale_vectors,
    "index_labels": index_labels,
    "class_weights": class_weights,
    "split_rows": split_rows,
}
