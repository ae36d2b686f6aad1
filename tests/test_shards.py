"""Shards, manifests and mini-batches."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import batches, clean, sharding
from scoreloom.plans.prepare import prepare_shards
from scoreloom.sources import shards
from scoreloom.sources.scratch import scratch_path


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"))


@pytest.mark.parametrize("n", [1, 3, 7, 64])
def test_shards_are_even(spark, n):
    counts = [r["count"] for r in sharding.assign_shards(numbered(spark, 10_000), n).groupBy("shard").count().collect()]
    assert len(counts) == n and max(counts) - min(counts) <= 3


def test_shards_stay_even_after_a_filter_by_modulus(spark):
    kept = numbered(spark, 100_000).where("row_id % 10 < 7")
    counts = [r["count"] for r in sharding.assign_shards(kept, 10).groupBy("shard").count().collect()]
    assert len(counts) == 10 and max(counts) < 1.05 * min(counts)


def test_row_numbers_beyond_the_modulus(spark):
    df = spark.range(10**12, 10**12 + 9000).select(F.col("id").alias("row_id"))
    counts = [r["count"] for r in sharding.assign_shards(df, 9).groupBy("shard").count().collect()]
    assert len(counts) == 9 and max(counts) - min(counts) <= 3


def test_partition_k_holds_shard_k(spark):
    df = sharding.repartition_shards(numbered(spark, 1000), 6)
    assert df.rdd.getNumPartitions() == 6
    assert df.where(F.spark_partition_id() != F.col("shard")).count() == 0


def test_shard_count_grows_with_rows():
    assert sharding.shard_count(10, 5) == 5
    assert sharding.shard_count(10**10, 5) == 10_000


def test_manifest_keeps_empty_shards(spark):
    df = sharding.assign_shards(numbered(spark, 2), 3)
    rows = sharding.shard_manifest(df, 3, "/data").orderBy("shard").collect()
    assert [r["n_rows"] for r in rows].count(0) == 1 and len(rows) == 3
    assert all((r["path"] is None) == (r["n_rows"] == 0) for r in rows)
    manifest = sharding.shard_manifest(df, 3)
    assert sharding.drop_empty_shards(manifest).count() == 2
    assert tuple(sharding.shard_totals(manifest).first()) == (2, 2, 3)


def test_written_shards_round_trip(spark):
    df = sharding.assign_shards(numbered(spark, 5000), 4)
    path = shards.write_shards(df, scratch_path(spark, "s"), 4, tasks_per_shard=3)
    back = shards.read_shard(spark, path)
    assert back.count() == 5000 and back.select("row_id").distinct().count() == 5000
    files = shards.shard_files(spark, path)
    assert files.where("shard is null").count() == 0
    assert files.count() <= 4 * 3
    assert files.agg(F.sum("n_rows")).first()[0] == 5000


@pytest.mark.parametrize("num_shards, tasks", [(16, 8), (400, 4)])
def test_writers_are_even(spark, num_shards, tasks):
    df = sharding.assign_shards(numbered(spark, 100_000), num_shards)
    path = shards.write_shards(df, scratch_path(spark, "even"), num_shards, tasks)
    files = shards.shard_files(spark, path)
    sizes = [r["n_rows"] for r in files.collect()]
    assert len(sizes) == num_shards * tasks and max(sizes) <= 1.1 * 100_000 / len(sizes)
    assert spark.read.parquet(path).where(F.col("shard") != sharding.spread(F.col("row_id"), num_shards)).count() == 0


def test_reading_a_shard_prunes_partitions(spark):
    df = sharding.assign_shards(numbered(spark, 100), 4)
    path = shards.write_shards(df, scratch_path(spark, "p"), 4)
    one = shards.read_shard(spark, path, 2)
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().toString()
    assert one.count() == df.where("shard = 2").count()


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/a/partition_12.pkl", 12),
        ("/a/my_part_7.parquet", 7),
        ("/a_3/shard=5/part-0000-c000.snappy.parquet", 5),
        ("/a/none.parquet", None),
        ("/a_9/x.parquet", None),
    ],
)
def test_shard_id_from_path(spark, path, expected):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(shards.shard_id_from_path(F.col("path"))).first()[0] == expected


def test_last_batch_is_short(spark):
    df = numbered(spark, 10).withColumn("shard", F.lit(0))
    sizes = batches.batch_sizes(batches.minibatches(df, 4)).orderBy("batch_id").collect()
    assert [r["n_rows"] for r in sizes] == [4, 4, 2]


@pytest.mark.parametrize("shuffle", [None, (1, 3)])
def test_slices_do_not_change_batches(spark, shuffle):
    df = sharding.assign_shards(numbered(spark, 1003), 3)
    whole = batches.minibatches(df, 16, shuffle)
    sliced = batches.minibatches(df, 16, shuffle, slices=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_shuffle_repeats_by_seed_and_changes_by_epoch(spark):
    df = numbered(spark, 300).withColumn("shard", F.lit(0))
    take = lambda *key: sorted(map(tuple, batches.minibatches(df, 10, key).collect()))
    assert take(1, 5) == take(1, 5)
    assert take(1, 5) != take(2, 5) and take(1, 5) != take(1, 6)


def test_weighted_loss_divides_by_batch_size(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 0, 3.0, 1.0)], "shard int, batch_id int, loss double, weight double")
    assert batches.weighted_batch_loss(df).first()["weighted_loss"] == 2.5


def test_prepared_manifest_counts_usable_rows(spark):
    source = scratch_path(spark, "source")
    label = F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit(1.0)).alias("label")
    spark.range(1000).select(
        F.array(F.col("id").cast("double")).alias("scaled_features"), label, F.lit(1.0).alias("weight")
    ).write.parquet(source)
    prepared = prepare_shards(spark, source, 4, scratch_path(spark, "out"))
    assert prepared.manifest.agg(F.sum("n_rows")).first()[0] == 900
    assert prepared.samples.count() == 900
    assert tuple(prepared.totals.first()) == (900, 4, 4)
    assert sorted(map(tuple, prepared.rejects.collect())) == [("null_label", 100), ("ok", 900)]


def test_preparing_reads_the_source_once(spark):
    """One scan of the columns; besides it, footers only. The counts equal those of the scans of their own."""
    source = scratch_path(spark, "source")
    label = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(2.0))
    vector = F.when(F.col("id") % 5 > 0, F.array(F.col("id").cast("double"), F.when(F.col("id") % 7 > 0, F.lit(1.0))))
    spark.range(700).repartition(3).select(vector.alias("scaled_features"), label.alias("label"), F.lit(1.0).alias("weight")).write.parquet(source)
    prepared = prepare_shards(spark, source, 4, scratch_path(spark, "out"), tasks_per_shard=2)
    raw = spark.read.parquet(source).withColumnRenamed("scaled_features", "features")
    assert sorted(map(tuple, prepared.rejects.collect())) == sorted(map(tuple, clean.reject_counts(raw).collect()))
    kept = clean.drop_malformed(raw).count()
    assert prepared.totals.first()["total_rows"] == kept == prepared.samples.count()
    assert sorted(map(tuple, prepared.manifest.collect())) == sorted(map(tuple, sharding.shard_manifest(prepared.samples, 4, prepared.path).collect()))
    assert "_reason" not in prepared.samples.columns


def test_preparing_a_table_without_usable_rows(spark):
    source = scratch_path(spark, "source")
    spark.range(5).select(F.array(F.lit(1.0)).alias("scaled_features"), F.lit(None).cast("double").alias("label"), F.lit(1.0).alias("weight")).write.parquet(source)
    prepared = prepare_shards(spark, source, 3, scratch_path(spark, "out"))
    assert prepared.samples.count() == 0 and tuple(prepared.totals.first()) == (0, 0, 3)
    assert list(map(tuple, prepared.rejects.collect())) == [("null_label", 5)]


@pytest.mark.parametrize("num_shards", [1, 3, 7])
def test_batches_by_arithmetic_equal_those_by_sorting(spark, num_shards):
    """Also beyond 2^31 rows, where the places of rows repeat."""
    df = sharding.assign_shards(numbered(spark, 3001), num_shards)
    want = sorted(map(tuple, batches.minibatches(df, 16).collect()))
    batched = batches.numbered_minibatches(df.repartition(5), 16, num_shards)
    assert sorted(map(tuple, batched.collect())) == want
    plan = batched._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    far = 2 * sharding.SPREAD_MODULUS
    moved = sharding.assign_shards(df.select((F.col("row_id") + far).alias("row_id")), num_shards)
    size = [-(-(k + 1) * far // num_shards) - -(-k * far // num_shards) for k in range(num_shards)]
    first = batches.numbered_minibatches(moved, 1, num_shards).groupBy("shard").agg(F.min("batch_id")).collect()
    assert all(abs(at - size[k]) <= 2 for k, at in first)


def test_a_missing_row_shortens_its_own_batch_only(spark):
    df = sharding.assign_shards(numbered(spark, 1000), 3)
    whole = {r["row_id"]: r["batch_id"] for r in batches.numbered_minibatches(df, 10, 3).collect()}
    part = {r["row_id"]: r["batch_id"] for r in batches.numbered_minibatches(df.where("row_id % 7 != 2"), 10, 3).collect()}
    assert all(whole[i] == b for i, b in part.items()) and len(part) < len(whole)


def test_shuffled_batches_by_arithmetic(spark):
    df = sharding.assign_shards(numbered(spark, 5000), 4)
    take = lambda *key: {r["row_id"]: (r["shard"], r["batch_id"]) for r in batches.numbered_minibatches(df.repartition(3), 32, 4, key, rows=5000).collect()}
    one, again, other, seed = take(1, 5), take(1, 5), take(2, 5), take(1, 6)
    assert one == again and sum(one[i] == other[i] for i in one) < 500 and one != seed
    sizes = batches.batch_sizes(batches.numbered_minibatches(df, 32, 4, (1, 5), rows=5000)).collect()
    last = {r["shard"]: max(x["batch_id"] for x in sizes if x["shard"] == r["shard"]) for r in sizes}
    assert all(r["n_rows"] == 32 for r in sizes if r["batch_id"] < last[r["shard"]])
    with pytest.raises(ValueError):
        batches.numbered_minibatches(df, 32, 4, (1, 5))
