"""Scans, sample form and rejects on hand-made edge rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.samples import vector_to_array
from scoreloom.operators import clean, contract
from scoreloom.plans.prepare import load_samples
from scoreloom.sources import features, labels
from scoreloom.sources.scratch import scratch_path, shared_folder

VECTOR_ROWS = T.StructType(
    [
        T.StructField("scaled_features", VectorUDT()),
        T.StructField("label", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


@pytest.fixture(scope="module")
def damaged(spark):
    path = scratch_path(spark, "damaged")
    rows = [
        (Vectors.dense([1.0, 2.0]), 1.9, 0.5),
        (Vectors.sparse(2, [1], [3.0]), 0.0, 1.0),
        (None, 1.0, 1.0),
        (Vectors.dense([1.0, 2.0]), None, 1.0),
        (Vectors.dense([1.0, 2.0]), float("nan"), 1.0),
        (Vectors.dense([1.0, 2.0]), float("inf"), 1.0),
        (Vectors.dense([1.0, 2.0]), 1.0, None),
        (Vectors.dense([1.0, 2.0]), 1.0, float("nan")),
    ]
    spark.createDataFrame(rows, VECTOR_ROWS).coalesce(1).write.parquet(path)
    return path


def test_rejects_have_reasons(spark, damaged):
    counts = dict(clean.reject_counts(features.scan_features(spark, damaged)).collect())
    assert counts == {"ok": 3, "null_features": 1, "null_label": 1, "bad_label": 2, "null_weight": 1}


def test_kept_rows_are_those_without_reason(spark, damaged):
    df = features.scan_features(spark, damaged)
    kept = df.where(clean.usable(df)).count()
    assert kept == df.where(clean.reject_reason(df).isNull()).count() == 3


def test_samples_are_truncated_and_float32(spark, damaged):
    df = load_samples(spark, damaged)
    assert dict(df.dtypes)["features"] == "array<float>"
    rows = df.orderBy("row_id").collect()
    assert [r["label"] for r in rows] == [1, 0, 1]
    assert rows[0]["features"] == [1.0, 2.0] and rows[1]["features"] == [0.0, 3.0]
    assert rows[0]["weight"] == 0.5


def test_text_labels_and_weights_are_judged_by_value(spark):
    rows = [([1.0], "1", "0.5"), ([1.0], "one", "0.5"), ([1.0], "1", "half")]
    df = spark.createDataFrame(rows, "features array<double>, label string, weight string")
    assert dict(clean.reject_counts(df).collect()) == {"ok": 1, "bad_label": 1, "bad_weight": 1}


def test_null_vector_becomes_null_array(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]),), (None,)], T.StructType([T.StructField("features", VectorUDT())]))
    assert [r["features"] for r in vector_to_array(df).collect()] == [[1.0], None]


def test_width_of_first_row_and_range(spark):
    df = spark.createDataFrame([(None,), ([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "features array<double>").coalesce(1)
    assert features.feature_width(df) == 2
    assert tuple(features.feature_width_range(df).first()) == (2, 3)
    with pytest.raises(ValueError):
        features.feature_width(df.where("false"))


def test_wrong_feature_type_is_an_error(spark):
    path = scratch_path(spark, "text")
    spark.createDataFrame([("x", 1.0, 1.0)], "scaled_features string, label double, weight double").write.parquet(path)
    with pytest.raises(TypeError):
        features.scan_features(spark, path)


@pytest.mark.parametrize("bound", ["10m", "-1"])
def test_row_ids_are_dense_over_many_files(spark, bound):
    """Whichever join the planner takes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    path = scratch_path(spark, "many")
    spark.range(1000).repartition(13).write.parquet(path)
    ids = features.read_numbered(spark, path).agg(
        F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")
    ).first()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(ids) == (0, 999, 1000)


def test_row_ids_do_not_change_between_runs(spark):
    path = scratch_path(spark, "again")
    spark.range(200).repartition(5).write.parquet(path)
    first = {tuple(r) for r in features.read_numbered(spark, path).collect()}
    assert first == {tuple(r) for r in features.read_numbered(spark, path).repartition(3).collect()}


def test_scan_reads_only_named_columns(spark, sf):
    df = features.scan_features(
        spark, f"{sf}/embeddings.parquet", features="embedding", weight=None, key="vec_id", numbered=False
    )
    plan = clean.drop_malformed(df).select("label")._jdf.queryExecution().toString()
    assert "IsNotNull(label)" in plan and "vec_id:" not in plan.split("ReadSchema")[-1]


def test_dictionary_order_is_frequency_then_name(spark):
    df = spark.createDataFrame([(x,) for x in [*"b b a a c c c d".split(), None]], "name string")
    assert labels.class_names(labels.fit_dictionary(df, "name")) == ["c", "a", "b", "d"]


def test_dictionary_agrees_with_the_library_indexer(spark, sf):
    from pyspark.ml.feature import StringIndexer

    events = spark.read.parquet(f"{sf}/events.parquet")
    fitted = StringIndexer(inputCol="event_type", outputCol="label").fit(events)
    assert labels.class_names(labels.fit_dictionary(events, "event_type")) == list(fitted.labels)
    path = scratch_path(spark, "indexer")
    fitted.write().save(path)
    assert labels.load_class_names(path) == list(fitted.labels)


@pytest.mark.parametrize("classes", [3, 20_000])
def test_any_number_of_classes_is_handled_alike(spark, classes):
    df = spark.range(classes * 3 - 2).select(F.format_string("c%05d", F.col("id") % classes).alias("name"))
    fitted = labels.fit_dictionary(df, "name")
    got = fitted.orderBy("label").collect()
    want = sorted((-3 if i < classes - 2 else -2, f"c{i:05d}") for i in range(classes))
    assert [(r["label"], r["class_name"], r["n"]) for r in got] == [(k, name, -n) for k, (n, name) in enumerate(want)]
    indexed = contract.index_labels(df, "name", fitted).select(F.col("label").cast("int").alias("label"))
    weighted = contract.with_class_weights(indexed, classes)
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(df.count())
    for bad in (None, "other"):
        odd = df.unionByName(spark.createDataFrame([(bad,)], "name string"))
        with pytest.raises(Exception, match=f"label outside the dictionary: {bad or 'null'}"):
            contract.index_labels(odd, "name", fitted).collect()
    for bad in (None, classes):
        odd = indexed.unionByName(spark.createDataFrame([(bad,)], "label int"))
        with pytest.raises(Exception, match=f"label outside 0..{classes - 1}: {'null' if bad is None else bad}"):
            contract.with_class_weights(odd, classes).collect()


def test_contract_statistics_equal_separate_scans(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_tax", F.when(F.col("l_tax") != 0.05, F.col("l_tax")))
    columns = ["l_quantity", "l_tax"]
    one, other = contract.fit_contract(df, columns, "l_returnflag"), contract.fit_scaler(df, columns)
    assert one.scaler.means == pytest.approx(other.means) and one.scaler.stddevs == pytest.approx(other.stddevs)
    assert [tuple(r) for r in one.dictionary.orderBy("label").collect()] == [
        tuple(r) for r in labels.fit_dictionary(df, "l_returnflag").orderBy("label").collect()
    ]


def test_null_elements_are_rejected(spark):
    rows = [([1.0, None], 1.0, 1.0), ([1.0, 2.0], 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "features array<float>, label double, weight double")
    assert dict(map(tuple, clean.reject_counts(df).collect())) == {"null_element": 1, "ok": 1, "null_features": 1}
    assert clean.drop_malformed(df).count() == 1


def test_scaled_vectors_equal_scaled_arrays(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    scaler = contract.fit_scaler(df, ["l_quantity", "l_tax"])
    both = df.select(scaler.as_vector().alias("features"), scaler.as_array().cast("array<float>").alias("a"))
    assert vector_to_array(both).where("features <> a").count() == 0


def test_metadata_failure_is_raised(spark):
    with pytest.raises(Exception):
        labels.load_metadata(spark, scratch_path(spark, "none"), scratch_path(spark, "none"))


def test_scaler_uses_sample_deviation_and_zero_for_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = contract.fit_scaler(df, ["a", "b"])
    rows = df.select(scaler.as_array().alias("z")).collect()
    assert rows[0]["z"] == pytest.approx([-(0.5**0.5), 0.0])


def test_class_weights(spark):
    df = spark.createDataFrame([(k,) for k in (0, 0, 0, 1)], "label int")
    got = sorted(tuple(r) for r in contract.with_class_weights(df, 2).collect())
    assert got == [(0, pytest.approx(2 / 3))] * 3 + [(1, 2.0)]


def test_split_shares(spark):
    df = spark.range(-50, 50).select(contract.split_of(F.col("id")).alias("s"))
    assert dict(df.groupBy("s").count().collect()) == {"train": 70, "val": 10, "test": 20}


def test_scratch_folder_comes_from_the_settings_alone(spark):
    class Plain:
        class conf:
            known = {"spark.sql.warehouse.dir": "hdfs://x/warehouse"}
            get = staticmethod(lambda name, default=None: Plain.conf.known.get(name, default))

    assert shared_folder(Plain) == "hdfs://x/warehouse/_scratch"
    Plain.conf.known["spark.checkpoint.dir"] = "hdfs://x/shared/"
    assert shared_folder(Plain) == "hdfs://x/shared"


@pytest.mark.parametrize("width", [3, 4096])
def test_vectors_are_scaled_whatever_their_width(spark, width):
    """By mean and sample deviation of each element; one plan for any width."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(40, width)) * 3 + 10
    x[:, 1] = 2.5  # never changes
    rows = [(i, v.tolist() if i != 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    known = np.delete(x.astype(np.float32).astype(float), 7, axis=0)
    want = (known - known.mean(axis=0)) / np.where(known.std(axis=0, ddof=1) > 0, known.std(axis=0, ddof=1), 1)
    scaled = contract.scale_vectors(df.withColumn("features", F.col("features").cast("array<float>")))
    got = {r["id"]: r["features"] for r in scaled.collect()}
    assert got.pop(7) is None and len(got) == 39
    assert np.allclose(np.array([got[i] for i in sorted(got)]), want, atol=1e-5)
    assert all(v[1] == 0 for v in got.values())
    assert len(scaled._jdf.queryExecution().optimizedPlan().toString()) < 3000


def test_stored_vector_columns_are_scaled(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 5.0]),), (Vectors.sparse(2, [0], [3.0]),), (None,)], ["features"])
    got = [r["features"] for r in contract.scale_vectors(df).collect()]
    assert got[2] is None and np.allclose(got[:2], [[-(0.5**0.5), 0.5**0.5], [0.5**0.5, -(0.5**0.5)]])


def test_unequal_widths_and_no_vectors_are_errors(spark):
    with pytest.raises(Exception):
        contract.scale_vectors(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>")).collect()
    with pytest.raises(ValueError):
        contract.fit_vector_scaler(spark.createDataFrame([(None,)], "features array<double>"))
