from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

import vecloom.llm  # noqa: F401
from vecloom.llm.registry import FOLDS  # noqa: F401

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` pairs, with a null language or source here and there."""

    def make(rows: list[tuple]) -> DataFrame:
        full = [(i, t, "en" if n % 3 else None, "s" if n % 2 else None, len(t or "")) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
