"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.scratch import fresh_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write ends, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, used: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns other than ``used`` under names that clash with nothing, and how to give them their own again.

    The second part takes a table that has all columns of the first, and puts them in order.
    """
    names = {c: c if c in used else f"aside_{i}__" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in docs.columns])
    return inner, lambda done: done.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def held_out(doc_id: str | Column, folds: int) -> Column:
    """True for the documents no fit may see. A null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % folds == 0, F.lit(True))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one narrow pass, one number to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0])


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: object) -> int:
        number = self[key] = len(self)
        return number


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
