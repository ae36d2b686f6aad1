"""Settings of one run, kept as a plain dataclass so it can be stored as a struct column."""

from __future__ import annotations

import dataclasses

from pyspark.sql import types as T


@dataclasses.dataclass(frozen=True)
class RunConfig:
    """Inputs, outputs and hyper-parameters of a train / score / evaluate run.

    ``num_shards`` is the number of stored shards; results do not depend on it. ``num_features``,
    ``num_classes`` and ``class_names`` are filled from the data by
    :meth:`with_metadata`.
    """

    train_path: str
    test_path: str
    label_indexer_path: str
    output_dir: str
    val_path: str | None = None
    mode: str = "local"
    num_shards: int = 1
    epochs: int = 3
    batch_size: int = 512
    learning_rate: float = 0.002
    hidden_size: int = 64
    dropout: float = 0.2
    seed: int = 0
    num_features: int | None = None
    num_classes: int | None = None
    class_names: tuple[str, ...] | None = None

    def with_metadata(self, num_features: int, class_names: list[str]) -> "RunConfig":
        return dataclasses.replace(
            self,
            num_features=num_features,
            num_classes=len(class_names),
            class_names=tuple(class_names),
        )

    def to_dict(self) -> dict:
        out = dataclasses.asdict(self)
        out["class_names"] = list(self.class_names) if self.class_names is not None else None
        return out


CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("train_path", T.StringType()),
        T.StructField("test_path", T.StringType()),
        T.StructField("label_indexer_path", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("val_path", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("num_shards", T.IntegerType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("hidden_size", T.IntegerType()),
        T.StructField("dropout", T.DoubleType()),
        T.StructField("seed", T.LongType()),
        T.StructField("num_features", T.IntegerType()),
        T.StructField("num_classes", T.IntegerType()),
        T.StructField("class_names", T.ArrayType(T.StringType())),
    ]
)
