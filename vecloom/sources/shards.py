"""Shards: a Parquet table partitioned by shard number."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.arrays import let
from vecloom.operators.feed import SAMPLES_PER_SHARD, assign_shard, global_index

# A numeric range or a list in braces, as in name-{000001..000230}.tar and {train,eval}.tar.
BRACES = r"\{(\d+\.\.\d+|[^{}]*,[^{}]*)\}"
BRACE_RANGE = r"^(\d+)\.\.(\d+)$"

# A pattern has at most so many braces.
MAX_BRACES = 4


def _choices(inside: Column) -> Column:
    """What one pair of braces stands for. Numbers are padded if either bound starts with a zero."""

    def numbers(b: Column) -> Column:
        padded = b.low.rlike(r"^0\d") | b.high.rlike(r"^0\d")
        width = F.when(padded, F.greatest(F.length(b.low), F.length(b.high))).otherwise(0)
        ends = F.sequence(*[F.nullif(end, F.lit("")).cast("bigint") for end in (b.low, b.high)])

        def digits(v: Column) -> Column:
            return F.transform(v.texts, lambda text: F.lpad(text, F.greatest(F.length(text), v.width), "0"))

        return let(digits, texts=ends.cast("array<string>"), width=width)

    low, high = (F.regexp_extract(inside, BRACE_RANGE, g) for g in (1, 2))
    return F.coalesce(let(numbers, low=low, high=high), F.split(inside, ",", -1))


def expand_shards(pattern: Column) -> Column:
    """Names that ranges and lists in braces stand for, the leftmost changing slowest.

    A pattern without braces stands for itself; more than ``MAX_BRACES`` are an error.
    What a pattern is cut into is found once for it, not once for each of its names.
    """

    def joined(v: Column) -> Column:
        return F.transform(v.many, lambda x: F.concat(v.head, x, v.tail))

    def cut(v: Column) -> Column:
        head = F.substring(v["name"], F.lit(1), v.at - 1)
        tail = F.substring(v["name"], v.at + F.length(v.found), F.length(v["name"]))
        inside = F.substring(v.found, F.lit(2), F.length(v.found) - 2)
        many = let(lambda w: _choices(w.inside), inside=inside)
        return F.when(v.at > 0, let(joined, many=many, head=head, tail=tail)).otherwise(F.array(v["name"]))

    def one(name: Column) -> Column:
        parts = let(cut, name=name, at=F.regexp_instr(name, F.lit(BRACES)), found=F.regexp_extract(name, BRACES, 0))
        return F.when(name.contains("{"), parts).otherwise(F.array(name))

    def step(v: Column) -> Column:
        braced = F.exists(v.names, lambda name: name.contains("{"))
        return F.when(braced, F.flatten(F.transform(v.names, one))).otherwise(v.names)

    def checked(v: Column) -> Column:
        left = F.exists(v.names, lambda name: name.contains("{") & name.rlike(BRACES))
        return F.when(left, F.raise_error(F.lit(f"more than {MAX_BRACES} braces")).cast("array<string>")).otherwise(v.names)

    names = F.array(pattern)
    for _ in range(MAX_BRACES):
        names = let(step, names=names)
    return let(checked, names=names)


def expand_braces(pattern: str) -> list[str]:
    """The same for one path, on the driver."""
    match = re.search(BRACES, pattern)
    if not match:
        return [pattern]
    bounds = re.match(BRACE_RANGE, match[1])
    if bounds:
        low, high = bounds.groups()
        padded = any(len(b) > 1 and b.startswith("0") for b in (low, high))
        width = max(len(low), len(high)) if padded else 0
        step = 1 if int(low) <= int(high) else -1
        choices = [f"{n:0{width}d}" for n in range(int(low), int(high) + step, step)]
    else:
        choices = match[1].split(",")
    return [name for c in choices for name in expand_braces(pattern[: match.start()] + c + pattern[match.end() :])]


def write_shards(
    df: DataFrame,
    path: str,
    order: Sequence[str] = (),
    samples_per_shard: int = SAMPLES_PER_SHARD,
    idx: str = "idx",
    mode: str = "errorifexists",
) -> None:
    """Write one file per shard, with at most ``samples_per_shard`` rows in index order.

    Rows without an index column get one by ``order``.
    """
    indexed = df if idx in df.columns else global_index(df, *order, idx=idx)
    (
        indexed.withColumn("shard", assign_shard(F.col(idx), samples_per_shard))
        .repartition("shard")
        .sortWithinPartitions("shard", idx)
        .write.mode(mode)
        .partitionBy("shard")
        .parquet(path)
    )


def scan_shards(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Rows of shards ``first`` to ``last``; other shards' files are not opened."""
    return spark.read.parquet(root).filter(F.col("shard").between(first, last))


def scan_eval_shard(
    spark: SparkSession, root: str, shard: int = 0, order: Sequence[str] = ("idx",)
) -> DataFrame:
    """Rows of the held-out shard in fixed order."""
    return spark.read.parquet(root).filter(F.col("shard") == shard).orderBy(*order)
