"""Exact dedup by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after deleting ASCII white space. A sending task
cuts its rows into runs, sorts the distinct fingerprints of a run, and sends
every owner of a fingerprint range the Golomb-Rice code of its slice. Owners
find the fingerprints that several runs have sent and answer each message with a
bitmap. Only rows marked there (or doubled within their run) are suspects; their
texts are shuffled and compared byte by byte.

A text that a third of all rows share is one fingerprint per run, so no owner
gets more than its range, and its bytes meet in map-side partial aggregates.

Defined cases: a null text counts as empty, and empty texts are equal to each
other. A null ``doc_id`` is an id like any other, the last to be kept. Rows that
repeat a ``doc_id`` count as rows of the group and share the mark of their id; only one of them stays in a table that drops the others.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import first_of_key, only_rows, release, same_id, stored, text_bytes

# Fixed value: ASCII white space, ignored by the comparison.
SPACE = " \t\n\x0b\x0c\r"
FINGERPRINT_BITS = 56
# Rows per run: a sender holds that many fingerprints at most.
RUN_ROWS = 1_000_000

_SENT = (
    "run long, owner int, pos int, doc_id long, sha256 string, n_chars long, twin boolean, "
    "n int, low_bits int, payload binary"
)


def golomb_encode(values: np.ndarray, low_bits: int) -> bytes:
    """Golomb-Rice code of ascending values: all unary parts, then all remainders of ``low_bits`` bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(low_bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, remainders.ravel()])).tobytes()


def golomb_decode(payload: bytes, n: int, low_bits: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    remainders = bits[start : start + n * low_bits].reshape(n, low_bits).astype(np.uint64)
    low = (remainders << np.arange(low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(low_bits)) + low, dtype=np.uint64)


def rice_bits(n: int, span: int) -> int:
    """Remainder bits that suit ``n`` values spread evenly over ``span``."""
    return max(0, (span // n).bit_length() - 1)


def _sender(owners: int, run_rows: int):
    span = -(-(1 << FINGERPRINT_BITS) // owners)
    schema = pa.schema(
        [
            ("run", pa.int64()), ("owner", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()),
            ("sha256", pa.string()), ("n_chars", pa.int64()), ("twin", pa.bool_()),
            ("n", pa.int32()), ("low_bits", pa.int32()), ("payload", pa.binary()),
        ]
    )

    def batch(**columns):
        size = len(columns["run"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema],
            schema=schema,
        )

    def flush(run, prints, ids, digests, lengths):
        prints = np.array(prints, dtype=np.uint64)
        values, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (values // np.uint64(span)).astype(np.int32)
        starts = np.searchsorted(owner, np.arange(owners + 1))
        pos = np.arange(len(values)) - starts[owner]
        for at in range(0, len(prints), 10_000):
            part = slice(at, at + 10_000)
            p = place[part]
            yield batch(
                run=np.full(len(p), run), owner=owner[p], pos=pos[p].astype(np.int32), doc_id=ids[part],
                sha256=digests[part], n_chars=lengths[part], twin=times[p] > 1,
            )
        sent = np.unique(owner)
        codes = []
        for o in sent.tolist():
            own = values[starts[o] : starts[o + 1]] - np.uint64(o * span)
            low = rice_bits(len(own), span)
            codes.append((len(own), low, golomb_encode(own, low)))
        yield batch(
            run=np.full(len(sent), run), owner=sent, n=[c[0] for c in codes],
            low_bits=[c[1] for c in codes], payload=[c[2] for c in codes],
        )

    def body(batches):
        base, runs = TaskContext.get().partitionId() << 24, 0
        prints, ids, digests, lengths = [], [], [], []
        for got in batches:
            ids += got.column("doc_id").to_pylist()
            for text in text_bytes(got.column("text")):
                text = text or b""
                digest = hashlib.sha256(text.translate(None, SPACE.encode())).digest()
                prints.append(int.from_bytes(digest[:8], "big") >> (64 - FINGERPRINT_BITS))
                digests.append(digest.hex())
                # Continuation bytes are those of the form 10xxxxxx.
                raw = np.frombuffer(text, dtype=np.uint8)
                lengths.append(len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80)))
            while len(prints) >= run_rows:
                yield from flush(base + runs, prints[:run_rows], ids[:run_rows], digests[:run_rows], lengths[:run_rows])
                prints, ids, digests, lengths = (x[run_rows:] for x in (prints, ids, digests, lengths))
                runs += 1
            release()
        if prints:
            yield from flush(base + runs, prints, ids, digests, lengths)

    return body


def _answer(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
    """Bitmaps for one owner: which fingerprints of each message came in other messages too."""
    parts = [
        golomb_decode(p, n, low)
        for p, n, low in zip(*(messages.column(c).to_pylist() for c in ("payload", "n", "low_bits")))
    ]
    values = np.concatenate(parts)
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    double = np.split(times[place] > 1, np.cumsum([len(p) for p in parts])[:-1])
    return pa.table(
        {
            "run": messages.column("run"),
            "owner": messages.column("owner"),
            "bitmap": pa.array([np.packbits(d, bitorder="little").tobytes() for d in double], pa.binary()),
        }
    )


def exact_duplicates(docs: DataFrame, run_rows: int = RUN_ROWS, owners: int | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs(doc_id, text)``.

    Of equal texts the one with most code points in its original form stays, then
    the smallest ``doc_id``. ``owners`` is the number of fingerprint ranges, the
    session's shuffle partitions if not given.
    """
    owners = owners or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = stored(slim.mapInArrow(_sender(owners, run_rows), _SENT), "fingerprints")
    rows = sent.where("payload IS NULL").select("run", "owner", "pos", "doc_id", "sha256", "n_chars", "twin")
    messages = sent.where("payload IS NOT NULL").select("run", "owner", "n", "low_bits", "payload")
    bitmaps = messages.groupBy("owner").applyInArrow(_answer, "run long, owner int, bitmap binary")
    marked = F.expr("twin OR (conv(hex(substring(bitmap, pos div 8 + 1, 1)), 16, 10) >> (pos % 8)) & 1 = 1")
    suspects = stored(
        rows.join(bitmaps, ["run", "owner"]).where(marked).select("doc_id", "sha256", "n_chars"), "suspects"
    )
    # The bytes themselves: under one digest there must be one text.
    squeezed = only_rows(slim, suspects).select(F.translate(F.coalesce("text", F.lit("")), SPACE, "").alias("squeezed"))
    verified = (
        squeezed.groupBy("squeezed")
        .agg(F.count("*").alias("n"))
        .groupBy(F.sha2("squeezed", 256).alias("sha256"))
        .agg(F.count("*").alias("texts"))
    )
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"))).alias("best")
    groups = (
        suspects.groupBy("sha256")
        .agg(best, F.count("*").alias("group_size"))
        .join(verified, "sha256")
        .where("group_size > 1")
        .select(
            "sha256",
            (-F.col("best.id")).alias("best_id"),
            F.when(F.col("texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.concat(F.lit("different texts with one digest "), "sha256")))
            .alias("group_size"),
        )
    )
    out = rows.select("doc_id", "sha256").join(groups, "sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        same_id(F.col("doc_id"), keep).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    The row that stays has the group's id and digest and the most code points; of rows alike in
    all three one stays, whichever comes first.
    """
    # One key of id and digest, by which rows are joined and then lie sorted.
    name = lambda doc_id, digest: F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest), 256)
    found = exact_duplicates(docs, **options).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias("_wanted"))
    squeezed = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), SPACE, ""), 256)
    rows = docs.select(
        name(docs["doc_id"].cast("long"), squeezed).alias("_key"),
        F.coalesce(F.length(docs["text"]), F.lit(0)).alias("_size"),
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )
    kept = rows.join(found.distinct().hint("merge"), F.col("_key") == F.col("_wanted"), "left_semi")
    return first_of_key(kept, "_key", -F.col("_size")).select("_row.*")
