"""Documents with every awkward case, and the small test tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from doc_rows import make_docs  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the town "
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
ODD_ROWS = [
    (None, None), (None, SENTENCE * 6), (1, ""), (2, None), (3, " \n\t "), (4, "word"), (5, SENTENCE * 6), (5, SENTENCE * 6),
    (6, SENTENCE * 6), (7, SENTENCE * 6 + "end"), (7, "another text under the same id"), (8, LONG), (9, LONG + " tail"),
    (10, "Ünïcödé ÀÉ straße 漢字 " * 30), (11, "a" * 30_000), (12, "!!! ### $$$"), (13, "one two"),
]
EXTRA = ["kept", "score", "n_words", "spans", "votes", "tokens", "fp", "chunk", "salt", "at"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SF_DIR}/benchmark.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """All awkward rows, with extra columns whose names the operators use inside."""
    return make_docs(spark, ODD_ROWS, EXTRA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: make_docs(spark, rows)
