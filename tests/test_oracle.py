"""Every registered query against its SQL, at the smallest scale."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from compare_oracle import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


# Those of the optional subpackage have tests of their own.
NAMES = sorted(set(entry_module.queries()) - set(getattr(entry_module.llm_queries, "QUERIES", ())))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf, name):
    assert compare(spark, duck, name, sf).startswith(("ok", "rows"))


def test_entry_reports_every_class(spark):
    assert entry_module.entry(spark).count() == 10


def test_sql_only_for_known_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
