"""Checkpoint manifests: which files there are, which is the newest, which to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The file name patterns and the retention defaults.
FILE_PATTERN = r"(^|/)checkpoint_step_[^/]*\.pt$"
STEP_PATTERN = r"checkpoint_step_(\d+)\.pt"
KEEP_RECENT = 5
KEEP_EVERY_N = 2500


def parse_manifest(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``step`` from the file name; files with another name are dropped."""
    named = F.when(F.col(path).rlike(FILE_PATTERN), F.regexp_extract(path, STEP_PATTERN, 1))
    return df.withColumn("step", F.nullif(named, F.lit("")).cast("bigint")).filter("step IS NOT NULL")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("step"), F.desc("path"))


def latest_checkpoint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Path with the greatest step, per run if ``by`` names one; no files, null."""
    newest = F.max(F.struct("step", "path"))
    return (
        df.groupBy(*by)
        .agg(newest.alias("_newest"))
        .select(*by, F.col("_newest.path").alias("path"), F.col("_newest.step").alias("step"))
    )


def _oldest_recent(df: DataFrame, keep_recent: int, by: Sequence[str]) -> DataFrame:
    """Per run the oldest of its newest files: one row, whatever the number of files.

    A rank filter drops all but a task's own newest before the shuffle. Listings of
    one file share a rank.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("step"), F.desc("path"))
    ranked = df.select(*by, "step", "path").withColumn("_rank", F.dense_rank().over(order))
    oldest = F.min(F.struct("step", "path")).alias("_oldest")
    return ranked.filter(F.col("_rank") <= keep_recent).groupBy(*by).agg(oldest)


def retention(
    df: DataFrame,
    keep_recent: int = KEEP_RECENT,
    every_n: int = KEEP_EVERY_N,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``keep``: the newest ``keep_recent`` files of a run and every ``every_n``-th step.

    A file is compared with one border of its run. A null run is a run, and a file
    listed twice counts once and keeps both rows.
    """
    periodic = F.col("step") % every_n == 0
    if keep_recent < 1:
        return df.withColumn("keep", periodic)
    if not by:
        top = df.select("step", "path").distinct().orderBy(F.desc("step"), F.desc("path")).limit(keep_recent)
        oldest = top.agg(F.min(F.struct("step", "path"))).scalar()
        return df.withColumn("keep", periodic | (F.struct("step", "path") >= oldest))
    borders = _oldest_recent(df, keep_recent, by).withColumnsRenamed({c: f"_run_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    return (
        df.join(borders, same, "left")
        .withColumn("keep", periodic | (F.struct("step", "path") >= F.col("_oldest")))
        .select(*df.columns, "keep")
    )


def retention_deletes(
    df: DataFrame,
    keep_recent: int = KEEP_RECENT,
    every_n: int = KEEP_EVERY_N,
    by: Sequence[str] = (),
) -> DataFrame:
    """The listed files that retention does not keep."""
    return retention(df, keep_recent, every_n, by).filter(~F.col("keep")).select(*df.columns)
