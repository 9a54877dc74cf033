"""Velocity loss of vectors under a velocity field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions import interpolate, sample_noise, sample_time, target_velocity


def draw(df: DataFrame, key: str, col: str, dim: int, seed: int = 0) -> DataFrame:
    """Add ``noise``, ``time``, the mixed vector ``z_t`` and its velocity ``target``."""
    time: Column = sample_time(F.col(key), seed)
    return (
        df.withColumn("noise", sample_noise(F.col(key), dim, seed))
        .withColumn("time", time)
        .withColumn("z_t", interpolate("noise", col, F.col("time")))
        .withColumn("target", target_velocity(col, "noise"))
    )
