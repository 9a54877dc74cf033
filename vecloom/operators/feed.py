"""Indexing, shuffling, batching and step accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.functions.draws import rank_word

# Rows in a shard, and digits of a sample key.
SAMPLES_PER_SHARD = 10_000
KEY_DIGITS = 8

# Slices of a hashed order per shuffle partition: with several, the partitions even out.
SLICES_PER_PARTITION = 8

# Sampled rows a range of an index has on average, and columns that ranging adds.
SAMPLES_PER_RANGE = 16
RANGE_COLUMNS = ("_tie", "_range", "_start")

# Offset tables have one row per slice of the shuffle; larger ones are not broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def cut_ranges(df: DataFrame, order: Sequence[str], ties: Sequence[str] | None = None) -> DataFrame:
    """Add ``_tie`` and ``_range``: ranges of about equally many rows in ``order``.

    The borders are quantiles of a sample that only the rows decide: for every value of
    a hash the row of least hash in full. So every pass, and every retry, cuts alike.
    Rows that tie in ``order`` go by a hash of ``ties`` (by default all columns but maps),
    so a value that very many rows share is spread over ranges. Nothing runs before the
    result is asked for; the sample has some rows per range, whatever the number of rows.
    """
    ranges = _ranges(df)
    hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    names = hashable if ties is None else [*order, *ties]
    tie = F.xxhash64(*names) if names else F.lit(0).cast("bigint")
    keyed = df.withColumn("_tie", tie).withColumn("_key", F.struct(*order, "_tie"))
    spot = F.pmod(F.xxhash64("_key"), F.lit(ranges * SAMPLES_PER_RANGE))
    fields = keyed.schema["_key"].dataType.names
    least = [F.min_by(f"_key.{f}", F.xxhash64("_key", F.lit(1))).alias(f) for f in fields]
    sample = keyed.groupBy(spot.alias("_spot")).agg(*least)
    every = F.ceil(F.size("_found") / ranges)
    borders = (
        sample.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_found"))
        .select(F.filter("_found", lambda _, i: (i > 0) & (i % every == 0)))
        .scalar()
    )
    # Borders at most the key, by binary search; one projection a step keeps it in generated code.
    cut = keyed.withColumn("_borders", borders).withColumn("_range", F.lit(0))
    for width in (1 << k for k in range(ranges.bit_length() - 1, -1, -1)):
        above = F.get("_borders", F.col("_range") + (width - 1)) <= F.col("_key")
        cut = cut.withColumn("_range", F.col("_range") + F.when(above, width).otherwise(0))
    return cut.drop("_borders", "_key")


def _ranges(df: DataFrame) -> int:
    return SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, order: Sequence[str], ties: Sequence[str] | None = None) -> DataFrame:
    """``cut_ranges`` with ``_start``, the rows in the ranges before."""
    cut = cut_ranges(df, order, ties)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.drop("count")
    # Every range has its offset; an inner join would compute the range again to look for nulls.
    return cut.join(F.broadcast(starts) if _ranges(df) <= MAX_BROADCAST_ROWS else starts, "_range", "left")


def numbered(ranged: DataFrame, order: Sequence[str]) -> Column:
    """The running number, from 0, of a row of ``in_ranges``; equal rows have an open order."""
    hashable = [f.name for f in ranged.schema if "map<" not in f.dataType.simpleString() and f.name not in RANGE_COLUMNS]
    whole = F.xxhash64(*hashable) if hashable else F.lit(0)
    inside = Window.partitionBy("_range").orderBy(*order, "_tie", whole)
    return F.col("_start") + F.row_number().over(inside) - 1


def global_index(
    df: DataFrame, *order: str, idx: str = "idx", key: str = "key", ties: Sequence[str] | None = None
) -> DataFrame:
    """Add a gapless running index in ``order`` and its zero-padded key.

    Rows are cut into ranges by fixed borders, counted, and numbered inside their range
    after one shuffle; see ``cut_ranges`` for ties. Only equal rows have an open order,
    and all copies of one row meet in one range. Nothing is written or run beforehand.
    """
    ranged = in_ranges(df, order, ties)
    out = ranged.withColumn("_number", numbered(ranged, order))
    return out.select(F.col("_number").alias(idx), sample_key(F.col("_number")).alias(key), *df.columns)


def sample_key(idx: Column) -> Column:
    """Zero-padded to eight digits; longer numbers keep all their digits."""
    return F.format_string(f"%0{KEY_DIGITS}d", idx)


def assign_shard(idx: Column, samples_per_shard: int = SAMPLES_PER_SHARD) -> Column:
    return F.floor(idx / samples_per_shard).cast("int")


def _rank_by_hash(
    df: DataFrame, word: Column, ties: Sequence[str], groups: Sequence[str], position: str, n_groups: int
) -> DataFrame:
    """Position of each row in the order of a uniform 32-bit hash, per group.

    The hash is uniform, so equal slices of its range hold about equally many
    rows whatever the data, and their borders are fixed numbers: every run, and
    every retry, cuts the rows alike.
    """
    slices = SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_word", word).withColumn(
        "_slice", F.shiftright(F.col("_word") * slices, 32).cast("int")
    )
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*groups, "_slice")
        .count()
        .withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    if n_groups * slices <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy(*groups, "_slice").orderBy("_word", *ties)
    return (
        keyed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [*groups, "_slice"])
        .withColumn(position, F.col("_start") + F.col("_row"))
        .drop("_word", "_slice", "_row", "_start")
        .select(*df.columns, position)
    )


def shuffle_shards(df: DataFrame, seed: int = 0, shard: str = "shard") -> DataFrame:
    """Add ``shard_pos``: the place of the row's shard in a seeded permutation of shards.

    Rows without a shard make one more shard together.
    """
    shards = df.select(shard).distinct()
    order = _rank_by_hash(
        shards, rank_word(seed, "shard", F.col(shard)), [shard], [], "shard_pos", 1
    )
    order = order.withColumnRenamed(shard, "_shard")
    return df.join(order, F.col(shard).eqNullSafe(F.col("_shard"))).select(*df.columns, "shard_pos")


def shuffle_samples(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int = 0,
    epoch: int = 0,
    buffer: int | None = None,
    idx: str = "idx",
) -> DataFrame:
    """Add ``pos``: the row's place in a seeded shuffle.

    The columns of ``key`` together have to identify a row; rows of one key would
    share a hash, and so a task. A null in a key counts as a value. With ``buffer`` the order changes only inside blocks of that many consecutive
    indexes, much as a reader with a bounded buffer would do it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    word = rank_word(seed, epoch, *map(F.col, keys))
    if buffer is None:
        return _rank_by_hash(df, word, keys, [], "pos", 1)
    block = F.floor(F.col(idx) / buffer)
    inside = Window.partitionBy("_block").orderBy("_word", *keys)
    return (
        df.withColumn("_block", block)
        .withColumn("_word", word)
        .withColumn("pos", F.col("_block") * buffer + F.row_number().over(inside) - 1)
        .select(*df.columns, "pos")
    )


def repeat_epochs(df: DataFrame, key: str | Sequence[str], epochs: int, seed: int = 0) -> DataFrame:
    """Every row once per epoch, with its place in that epoch's own shuffle."""
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keys = [key] if isinstance(key, str) else list(key)
    word = rank_word(seed, F.col("epoch"), *map(F.col, keys))
    return _rank_by_hash(repeated, word, keys, ["epoch"], "pos", epochs)


def batch(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    """Group consecutive rows; the last, short batch stays. A batch holds at most ``size`` rows."""
    sample = F.struct(idx, *[c for c in df.columns if c != idx])
    return (
        df.groupBy(F.floor(F.col(idx) / size).alias("batch_id"))
        .agg(F.sort_array(F.collect_list(sample)).alias("samples"))
        .withColumn("n", F.size("samples"))
    )


def accumulation_plan(
    df: DataFrame, k: int, batch_col: str = "batch_id", faithful: bool = True
) -> DataFrame:
    """Map each batch to ``step`` and ``micro``.

    ``faithful`` pulls k + 1 batches for a step and leaves the last unused;
    otherwise every batch is used.
    """
    pulled = k + 1 if faithful else k
    b = F.col(batch_col)
    return (
        df.withColumn("step", F.floor(b / pulled))
        .withColumn("micro", b % pulled)
        .withColumn("used", F.col("micro") < k)
    )


def step_plan(
    df: DataFrame,
    images: str,
    batch_size: str,
    accumulation: str,
    world: str,
    eval_samples: str,
) -> DataFrame:
    """Images in a step, steps needed for all images, and batches of an evaluation."""
    per_step = F.col(batch_size).cast("bigint") * F.col(accumulation) * F.col(world)
    return (
        df.withColumn("images_per_step", per_step)
        .withColumn("n_steps", F.ceil(F.col(images) / F.col("images_per_step")))
        .withColumn("eval_batches", F.ceil(F.col(eval_samples) / F.col(batch_size)))
    )
