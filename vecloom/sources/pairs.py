"""Captioned rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Longer lists of ids come as a table.
MAX_LISTED = 1000


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_rows(df: DataFrame, idx_col: str, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows by position. A short list is pushed into the scan; a table is semi-joined."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(idx_col))
        return df.join(wanted, idx_col, "left_semi")
    listed = list(ids)
    if len(listed) > MAX_LISTED:
        raise ValueError(f"pass more than {MAX_LISTED} ids as a DataFrame")
    return df.filter(F.col(idx_col).isin(listed))
