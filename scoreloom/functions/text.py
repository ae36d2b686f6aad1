"""Text forms of metrics and run stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_metric(value: Column, decimals: int = 4) -> Column:
    """Fixed-point text, rounded on the exact binary value with ties to even.

    ``format_number`` rounds that way; ``format_string`` rounds the shortest
    decimal form half up and differs in the last digit for values like 0.00015.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * decimals))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def stamped_output(base: Column, ts: Column) -> Column:
    """Output folder of a run; stamped once."""
    return F.concat(base, F.lit("_"), run_stamp(ts))
