"""Metric records and checkpoint listings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.manifest import parse_manifest
from vecloom.operators.rows import spread
from vecloom.sources.tars import _open_fs as open_fs


def log_metrics(df: DataFrame, path: str, step: str, names: Sequence[str], prefix: str = "") -> None:
    """Append one row (step, name, value) per metric that has a value."""
    numbers = df.select(
        F.col(step).cast("bigint").alias("step"),
        *[F.col(n).cast("double").alias(f"{prefix}{n}") for n in names],
    )
    long = numbers.unpivot("step", [f"{prefix}{n}" for n in names], "name", "value")
    long.filter("value IS NOT NULL").write.mode("append").parquet(path)


def list_files(folders: DataFrame, folder: str, pattern: str) -> DataFrame:
    """Add ``path``: the files of each row's folder whose name fits ``pattern``, one row each.

    Tasks list the folders, which are dealt out evenly to them; names are read, contents
    are not. A folder that is not there, or is null, has no files.
    """
    names = folders.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in folders.schema), "path string"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths = [], []
            for row, place in enumerate(batch.column(folder).to_pylist()):
                if place is None:
                    continue
                files, inner = open_fs(place)
                store = place.removesuffix(inner) if "://" in place else ""
                for info in files.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                    if info.type == pafs.FileType.File and fnmatch(info.base_name, pattern):
                        rows.append(row)
                        paths.append(store + info.path)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(paths, pa.string())], [*names, "path"])

    return spread(folders).mapInArrow(walk, schema)


def list_manifest(spark: SparkSession, path: str | DataFrame, folder: str = "folder") -> DataFrame:
    """Checkpoint files in a folder, or in the folders of a table, and their steps."""
    folders = path if isinstance(path, DataFrame) else spark.createDataFrame([(path,)], f"{folder} string")
    found = list_files(folders, folder, "checkpoint_step_*.pt")
    return parse_manifest(found if isinstance(path, DataFrame) else found.select("path"))
