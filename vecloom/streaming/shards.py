"""A file stream of shards through the same operators as a batch read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.feed import SAMPLES_PER_SHARD, global_index, sample_key
from vecloom.sources.shards import write_shards


def stream_shards(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Rows of Parquet files in a folder, each file once, as they come."""
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_prepare(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
) -> StreamingQuery:
    """Take in all files there are, transform their rows and append them to ``sink``.

    ``checkpoint`` remembers the files done: a restart goes on after them.
    """
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_indexed(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    order: Sequence[str],
    sink: str,
    checkpoint: str,
    samples_per_shard: int = SAMPLES_PER_SHARD,
) -> StreamingQuery:
    """Take in all files there are and write their rows as shards with an index that goes on.

    Each micro-batch is indexed in ``order`` after the rows of those before it and written
    to a folder of its number, whose size is noted beside it when it is whole. A batch
    that is repeated after a stop replaces its folder and its note, so a restart adds no
    row and leaves no gap. Read it with ``scan_indexed``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _noted(spark, sink, number)
        indexed = global_index(transform(batch), *order)
        rows = indexed.withColumn("idx", F.col("idx") + before).withColumn("key", sample_key(F.col("idx")))
        data = f"{sink}/data/batch={number}"
        write_shards(rows, data, samples_per_shard=samples_per_shard, mode="overwrite")
        written = spark.read.schema(rows.schema).parquet(data).count()
        spark.createDataFrame([(number, before, written)], _NOTE).coalesce(1).write.mode("overwrite").parquet(
            f"{sink}/notes/batch={number}"
        )

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_NOTE = "number bigint, before bigint, written bigint"


def _noted(spark: SparkSession, sink: str, number: int) -> int:
    """Rows of the batches before a batch, by their notes: a row a batch."""
    if number == 0:
        return 0
    last = spark.read.schema(_NOTE).parquet(f"{sink}/notes/batch={number - 1}").head()
    return last["before"] + last["written"]


def scan_indexed(spark: SparkSession, sink: str) -> DataFrame:
    """Rows of ``stream_indexed`` with ``batch`` and ``shard``; a batch without a note is not whole and left out."""
    notes = spark.read.parquet(f"{sink}/notes").select("number")
    rows = spark.read.parquet(f"{sink}/data")
    return rows.join(notes, rows["batch"] == notes["number"], "left_semi")
