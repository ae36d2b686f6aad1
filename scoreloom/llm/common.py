"""What several operators share: scratch tables, Arrow columns, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.sources.scratch import scratch_path

# Bytes of a batch of rows on the way to Python; a row of more is a batch of its own.
BATCH_BYTES = 4_000_000
# Fixed value: odd multipliers of the polynomial over word hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever executor is lost later."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most about ``BATCH_BYTES`` from now on, unless the session has a bound of its own.

    Spark's default is 64 MB, which a task holds several times over, in the executor and in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def release() -> None:
    """Give back what Arrow keeps of batches that are done; else a worker holds it as long as it lives."""
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a string column, without a detour over Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_rows(function: Callable, schema: pa.Schema, rows: int = 1000) -> Callable[[Iterable], Iterator]:
    """A ``mapInArrow`` body that hands ``function`` slices of at most ``rows`` rows, as column dictionaries in and out."""

    def body(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                columns = function(batch.slice(start, rows))
                if columns is not None:
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)
            release()

    return body


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (xor-shift and multiply)."""
    values = values ^ (values >> np.uint64(32))
    values = values * MIX[1]
    values = values ^ (values >> np.uint64(29))
    values = values * MIX[2]
    return values ^ (values >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total *= MIX[0]
        total += words[k : n + k]
    return mix(total)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def with_running(df: DataFrame, totals: dict[str, Column], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with the running totals of arrays, by an associative ``step`` with the neutral element ``start``.

    An array is cut into about as many blocks as a block has values. Totals are taken within blocks, then over
    blocks, so that no array grows by one value at a time beyond a block: n values cost n to the power of 1.5 copies.
    One projection for each of these, as lambda functions within each other are slow to resolve.
    """

    def within(block):
        return F.aggregate(block, F.array(start), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))

    def cut(values):
        size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        firsts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda b: F.slice(values, b * size + 1, size))

    def moved(name):
        after = lambda part, offset: F.transform(F.slice(part, 2, F.size(part)), lambda x: step(offset, x))
        return F.flatten(F.zip_with(F.col(f"{name} parts"), F.slice(F.col(f"{name} before"), 1, F.size(F.col(f"{name} parts"))), after))

    columns = df.columns
    df = df.withColumns({f"{name} values": values for name, values in totals.items()})
    df = df.withColumns({f"{name} cut": cut(F.col(f"{name} values")) for name in totals})
    df = df.withColumns({f"{name} parts": F.transform(F.col(f"{name} cut"), within) for name in totals})
    df = df.withColumns({f"{name} before": within(F.transform(F.col(f"{name} parts"), lambda part: F.element_at(part, -1))) for name in totals})
    return df.select(*[F.col(f"`{c}`") for c in columns], *[moved(name).alias(name) for name in totals])


def same_id(left, right):
    """Join condition on ids that also pairs nulls."""
    return left.eqNullSafe(right)


def only_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose ``key`` is among ``ids[key]``; a null id matches a null id.

    The join is a sort-merge join at every size, as the number of ids grows with the documents.
    """
    wanted = ids.select(F.col(key).alias("_wanted")).hint("merge")
    return docs.join(wanted, same_id(docs[key], wanted["_wanted"]), "left_semi")


def first_of_key(rows: DataFrame, key: str, best: Column) -> DataFrame:
    """Of rows that lie sorted by ``key``, as a sort-merge join leaves them, the one with the least ``best`` of each key, without moving or sorting them again."""
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_best", F.struct(best.alias("best"), F.col("_number").alias("number")))
    least = F.min("_best").over(Window.partitionBy(key)).alias("_least")
    return numbered.select("*", least).where("_best = _least").drop("_number", "_best", "_least")


def one_row(docs: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of ``docs`` whose ``key`` is among the distinct ``ids[key]`` one each, the one with the least text, and all rows whose key is null.

    Rows move once, to be joined by the key.
    """
    wanted = ids.where(F.col(key).isNotNull()).select(F.col(key).alias("_wanted")).hint("merge")
    named = docs.select(docs[key].alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    found = named.join(wanted, named["_key"] == wanted["_wanted"], "left_semi")
    return first_of_key(found, "_key", F.col(f"_row.{text}")).select("_row.*").unionByName(docs.where(docs[key].isNull()))


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], most: int | None = None, always: Callable[[pa.RecordBatch, int], bool] = lambda rows, start: False
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of rows sorted by ``keys``, cut so that groups are whole: ``(batch, [(start, end, whole)])``.

    The last group of a batch is held back until its end is seen. With ``most``, a group of more rows
    is given out in pieces as it comes, and ``whole`` is false for all of them, unless ``always`` says of its first row that it is kept whole.
    """
    held, begun = None, None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is None:
            if held is None:
                return
            rows, last = held, True
        else:
            rows, last = batch if held is None else pa.concat_batches([held, batch]), False
        columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(rows.num_rows, dtype=bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change).tolist()
        # The key of a group of which a piece has been given out.
        first = tuple(column[0] for column in columns)
        goes_on = begun is not None and begun == first
        ends = [*starts[1:], rows.num_rows]
        bounds = [[s, e, most is None or e - s <= most or always(rows, s)] for s, e in zip(starts, ends)]
        if goes_on:
            bounds[0][2] = False
        held = None
        begun = None
        if not last:
            start, end, whole = bounds[-1]
            if whole:
                held = rows.slice(start)
                bounds.pop()
            else:
                begun = tuple(column[start] for column in columns)
        if bounds:
            yield rows.slice(0, bounds[-1][1]), [tuple(b) for b in bounds]
