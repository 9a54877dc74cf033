"""Filters, splits and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.feed import in_ranges, numbered

# Fixed value: any character that is not white space, in the Unicode sense.
NOT_BLANK = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is null, empty or only white space."""
    return df.filter(F.col(col).rlike(NOT_BLANK))


def take_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in ``order``, sorted.

    The rows are counted by range; the range that holds the n-th is found from the
    counts, ranges beyond it are dropped before the shuffle, and rows are numbered in
    their range. So no task gathers the result, whatever ``n``, and nothing runs
    beforehand. Rows that tie at the n-th place are chosen by a hash of the row.
    """
    ranged = in_ranges(df, order).filter(F.col("_start") < n)
    first = ranged.withColumn("_number", numbered(ranged, order)).filter(F.col("_number") < n)
    return first.orderBy("_number").select(*df.columns)


def take_images(df: DataFrame, k: int = 32, *order: str) -> DataFrame:
    """The first ``k`` outputs, for a report."""
    return take_first(df, k, *order)


def resume_after(df: DataFrame, step: int, batch_size: int, idx: str = "idx") -> DataFrame:
    """Rows not yet consumed after ``step`` batches."""
    return df.filter(F.col(idx) >= step * batch_size)


def split_train_eval(df: DataFrame, shard: str = "shard", eval_shard: int = 0) -> DataFrame:
    """Add ``split``: the held-out shard is ``eval``, every other shard ``train``."""
    return df.withColumn("split", F.when(F.col(shard) == eval_shard, "eval").otherwise("train"))


def split_by_rank(
    df: DataFrame, rank: int, world: int, shard: str = "shard", first: int = 0
) -> DataFrame:
    """Rows of the shards read by one of ``world`` readers: every ``world``-th shard.

    ``first`` is the shard that the list of shards begins with.
    """
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} is outside 0..{world - 1}")
    return df.filter(F.pmod(F.col(shard) - first, F.lit(world)) == rank)


def cadence(
    df: DataFrame,
    step: str = "step",
    log_every: int = 100,
    checkpoint_freq: int = 500,
    emit_every: int = 5,
    last: int | None = None,
) -> DataFrame:
    """Flag the steps that evaluate, save and emit.

    Saving needs both cadences. ``last`` is the number of steps of a sampling run,
    whose last step always emits.
    """
    s = F.col(step)
    evaluates = (s > 0) & (s % log_every == 0)
    emits = (s + 1) % emit_every == 0
    if last is not None:
        emits = emits | (s == last - 1)
    return (
        df.withColumn("evaluates", evaluates)
        .withColumn("saves", evaluates & (s % checkpoint_freq == 0))
        .withColumn("emits", emits)
    )


def require_one_of(df: DataFrame, single: str, group: Sequence[str], mode: str = "flag") -> DataFrame:
    """Each row must have ``single`` alone or all of ``group`` alone.

    ``flag`` adds ``input_kind`` (``single``, ``group`` or ``invalid``); ``fail``
    stops the job at an invalid row, whichever columns are read.
    """
    has_single = F.col(single).isNotNull()
    has_all, has_any = F.lit(True), F.lit(False)
    for name in group:
        has_all = has_all & F.col(name).isNotNull()
        has_any = has_any | F.col(name).isNotNull()
    kind = F.when(has_single & ~has_any, "single").when(~has_single & has_all, "group")
    if mode == "flag":
        return df.withColumn("input_kind", kind.otherwise("invalid"))
    if mode == "fail":
        problem = F.lit(f"either {single} or all of {', '.join(group)} must be given")
        checked = df.filter(F.when(kind.isNotNull(), True).otherwise(F.raise_error(problem).cast("boolean")))
        return checked.withColumn("input_kind", kind)
    raise ValueError(f"unknown mode {mode!r}")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly to as many tasks as shuffles have, for work that is large beside the rows.

    A given number of tasks stays: adaptive execution joins small partitions of others again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
