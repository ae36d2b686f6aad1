import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from rows import DOCS, EDGE  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows ``(doc_id, text[, lang])`` as documents with extra columns of clashing names."""

    def make(rows):
        full = [(*row, None)[:3] + ("extra",) * (len(DOCS) - 3) for row in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def edge(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
