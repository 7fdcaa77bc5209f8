from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# the workers import the operators from the repository
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DOCUMENTS = "doc_id long, text string"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def texts(spark):
    """The texts of the smallest documents table by id."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts; columns with the names that operators use stand beside them."""

    def make(values: list[str | None], ids: list[int | None] | None = None):
        ids = list(range(len(values))) if ids is None else ids
        rows = [(i, t, "clash", True, -1, b"x") for i, t in zip(ids, values, strict=True)]
        return spark.createDataFrame(
            rows, DOCUMENTS + ", node string, kept boolean, length int, row binary"
        )

    return make
