"""Rows with the cases that every operator must survive."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that operators use themselves.
        *[T.StructField(name, T.StringType()) for name in ("kept", "shard", "key", "rep", "hit", "items", "row", "run", "owner", "size", "slot")],
    ]
)
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (3, "the  quick brown fox jumps over the lazy dog\nand runs far away from here.", None),
    (4, None, "en"),
    (5, "", "en"),
    (6, " \t\n", None),
    (7, "😀 é ñ", "es"),
    (8, LONG, "en"),
    (9, LONG + " end", "en"),
    (None, "no id at all but some words to read", "en"),
    (None, None, None),
    (10, "x" * 50_000, "de"),
]
