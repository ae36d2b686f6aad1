"""Tasks that die half-way and run again must change nothing."""

import pathlib
import subprocess
import sys

SCRIPT = '''
import sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F
from scoreloom.functions import scoring
from scoreloom.functions.updates import TrainState
from scoreloom.model import init_model
from scoreloom.operators import clean, training
from scoreloom.plans import prepare
from scoreloom.plans.prepare import prepare_shards
from scoreloom.sources.scratch import scratch_path
from scoreloom.registry import datasets as D
from scoreloom.session import build_session

spark = build_session(**{"spark.master": "local[4,3]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})
spark.sparkContext.setLogLevel("OFF")
sf = sys.argv[2]
df = D.embedding_samples(spark, sf, numbered=True)
shape, state = D.EMBEDDING_SHAPE, TrainState.start(init_model(D.EMBEDDING_SHAPE))
stored = training.store_blocks(df, scratch_path(spark, "t"), 3, num_batches=3)

def epoch():
    return training.train_epoch(stored, state, shape, 0.01, 1)[0].params

def tally():
    return sorted((r["label"], r["pred"], r["n"]) for r in scoring.tally_scores(df, D.EMBEDDING_MODEL).collect())

def prepared():
    found = prepare_shards(spark, source, 5, scratch_path(spark, "prepared"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    counts = rows(found.manifest.select("shard", "n_rows")), rows(found.rejects), rows(found.totals)
    return *counts, sorted((r["row_id"], r["label"]) for r in found.samples.collect())

source = scratch_path(spark, "source")
label = F.when(F.col("key") % 7 == 0, F.lit(None)).when(F.col("key") % 7 == 1, float("nan")).otherwise(F.col("label").cast("double"))
df.repartition(6).select(F.col("features").alias("scaled_features"), label.alias("label"), F.lit(1.0).alias("weight")).write.parquet(source)
calm = epoch(), tally(), prepared()
step, logits = training.updates.loss_and_gradient, scoring.forward.logits_of_column

def dying(result):
    first = TaskContext.get().attemptNumber() == 0
    if first:
        raise OSError("lost")
    return result

training.updates.loss_and_gradient = lambda *a: dying(step(*a)) if TaskContext.get().partitionId() % 2 == 0 else step(*a)
scoring.forward.logits_of_column = lambda *a: dying(logits(*a))

def dies_at_its_end(batches):
    for batch in batches:
        yield batch
    dying(None)

# Tasks that have read, moved and counted all their rows die, before the shuffle and after it.
watch, scan = clean.RowCounts.watch, prepare.scan_features
again = lambda df: df.mapInArrow(dies_at_its_end, df.schema)
clean.RowCounts.watch = lambda self, df: again(watch(self, df))
prepare.scan_features = lambda *a, **k: again(scan(*a, **k))
stormy = epoch(), tally(), prepared()
assert np.allclose(calm[0], stormy[0], atol=1e-13) and calm[1:] == stormy[1:]
assert calm[2][2][0][0] + sum(n for r, n in calm[2][1] if r != "ok") == df.count() and len(calm[2][1]) == 3, calm[2]
failed = sum(
    spark.sparkContext.statusTracker().getStageInfo(s).numFailedTasks
    for j in range(200)
    if (info := spark.sparkContext.statusTracker().getJobInfo(j))
    for s in info.stageIds
    if spark.sparkContext.statusTracker().getStageInfo(s)
)
assert failed >= 12, failed
print("same", failed)
'''


def test_retried_tasks_give_the_same_results(sf):
    root = pathlib.Path(__file__).resolve().parents[1]
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(root), sf], capture_output=True, text=True, timeout=300, cwd="/"
    )
    assert "same" in done.stdout, done.stderr[-2000:]
