"""Command line: ``spark-submit scoreloom/__main__.py --train_path ... --test_path ...``."""

from __future__ import annotations

import argparse
import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from scoreloom.config import RunConfig  # noqa: E402
from scoreloom.plans.experiment import run_experiment  # noqa: E402
from scoreloom.session import build_session  # noqa: E402


def parse(arguments: list[str] | None = None) -> RunConfig:
    parser = argparse.ArgumentParser(description="Train, score and evaluate a classifier on Spark tables")
    parser.add_argument("--mode", choices=["local", "cluster"], default="local")
    parser.add_argument("--num_processes", dest="num_shards", type=int, default=1, help="stored shards")
    for name in ("train_path", "test_path", "label_indexer_path", "output_dir"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--val_path", help="default: val_df.parquet beside the training table")
    for name, kind in (
        ("epochs", int),
        ("batch_size", int),
        ("learning_rate", float),
        ("hidden_size", int),
        ("dropout", float),
        ("seed", int),
    ):
        parser.add_argument(f"--{name}", type=kind, default=getattr(RunConfig, name))
    return RunConfig(**vars(parser.parse_args(arguments)))


def main() -> None:
    config = parse()
    spark = build_session(config.mode)
    try:
        done = run_experiment(spark, config)
        done.evaluation.full.show(1000, truncate=False)
        done.summary.show(truncate=False, vertical=True)
        print(done.output_dir)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
