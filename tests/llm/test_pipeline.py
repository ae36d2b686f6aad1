"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib

import pyarrow as pa
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import bpe, common, language
from test_decontaminate import by_hand
from test_dedup import exact_by_hand, near_by_hand

SF = "/root/testdata/sf0.001"


def test_batches_are_bounded(spark):
    """Ten thousand texts of 4 kB are one batch of 40 MB by Spark's default."""
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"), F.lit("en").alias("lang"))
    schema = "rows long, bytes long"
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(1), SF)
        spark.catalog.clearCache()
        seen = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), schema).collect()
        assert sum(r.rows for r in seen) == 10_000
        assert max(r["bytes"] for r in seen) <= 1.5 * common.BATCH_BYTES
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = corpus_pipeline.stored(stage(spark, docs, SF), name)
        kept = {r.doc_id for r in after.collect()}
        if number < 4:
            assert after.columns == columns
        if number == 0:
            coder = language.Classifier(language.learn(docs))
            found = {i: coder.classify((t or "").encode()) for i, t in before}
            want = {i for i, (lang, margin) in found.items() if lang != "und" and margin >= language.MIN_MARGIN}
            assert len(want) > 0.95 * len(before)
        elif number == 1:
            want = {r[0] for r in exact_by_hand(before) if r[3]}
        elif number == 2:
            want = {i for i, (_, component) in near_by_hand(before, 5).items() if i == component}
        elif number == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {r[0] for r in by_hand(before, items) if not r[5]}
        else:
            want = {i for i, _ in before}
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            tokens = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in after.collect()}
            assert tokens == {i: (len(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in before}
        assert kept == want, name
        docs = after
