"""Tables of several files in which a third of the rows are copies of one row."""

import pathlib
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from compare_oracle import compare, connect  # noqa: E402

from scoreloom.operators import sharding  # noqa: E402
from scoreloom.registry.datasets import embedding_samples  # noqa: E402


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    import duckdb

    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table in ("embeddings", "lineitem", "events", "orders", "labels"):
        source = f"'{sf}/{table}.parquet'"
        (out / f"{table}.parquet").mkdir()
        total = con.execute(f"SELECT count(*) FROM {source}").fetchall()[0][0]
        con.execute(
            f"CREATE OR REPLACE TABLE t AS SELECT * FROM {source} UNION ALL "
            f"SELECT f.* FROM (SELECT * FROM {source} LIMIT 1) f, range({total // 2}) r"
        )
        step = (total + total // 2) // 3 + 1
        for i in range(3):
            con.execute(
                f"COPY (SELECT * FROM t LIMIT {step} OFFSET {i * step}) TO '{out}/{table}.parquet/part-{i}.parquet' (FORMAT parquet)"
            )
    return str(out)


@pytest.mark.parametrize(
    "name",
    [
        "scan_features",
        "write_shards",
        "repartition_shards",
        "shard_manifest",
        "minibatches",
        "minibatches_sliced",
        "weighted_loss",
        "class_report",
        "evaluate_performance",
        "compare_models",
        "prepare_shards",
        "train_epoch",
        "batch_gradient",
        "class_weights",
        "label_dictionary",
        "best_epoch",
    ],
)
def test_matches_sql_on_skewed_tables(spark, skewed, name):
    assert compare(spark, connect(skewed), name, skewed).startswith("ok")


def test_copies_do_not_fill_a_shard(spark, skewed):
    df = embedding_samples(spark, skewed, numbered=True)
    assert df.groupBy("key").count().agg(F.max("count")).first()[0] > 0.3 * df.count()
    sizes = [r["n_rows"] for r in sharding.shard_manifest(sharding.assign_shards(df, 8), 8).collect()]
    assert max(sizes) - min(sizes) <= 3
