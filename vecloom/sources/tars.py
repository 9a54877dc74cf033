"""Tar shards: members whose names share a prefix make one sample.

Each archive is read by one task, as its writer bounds its size; larger ones have a
member index, by which many tasks read one. Files are opened through ``pyarrow.fs``, so paths may be URIs of a shared store.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import tarfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from vecloom.functions.arrays import _col
from vecloom.functions.arrow import tensor_lists, tensor_rows, vector_udf
from vecloom.operators.feed import SAMPLES_PER_SHARD, assign_shard, sample_key
from vecloom.sources.shards import expand_braces

# Format name, archive name pattern, and row layout.
FORMAT = "wdstar"
ARCHIVE = "shard-{:06d}.tar"
MARKER = "_archives.json"
SCHEMA = "shard int, key string, fields map<string, binary>"

# Members told at once, bytes of contents handed on at once, and of an archive read by one task.
MEMBERS_AT_ONCE = 10_000
MEMBER_BYTES = 32 << 20
BYTES_PER_TASK = 128 << 20
# Old archives taken away at once.
DELETES = 16


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path; Spark's ``file:`` and ``s3a:`` are told by other names here."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _marked(files: pafs.FileSystem, folder: str) -> set[str] | None:
    """Names of the archives in a folder that count, None if it has no marker."""
    marker = posixpath.join(folder, MARKER)
    if files.get_file_info(marker).type != pafs.FileType.File:
        return None
    with files.open_input_stream(marker) as stream:
        return set(json.loads(stream.read())["archives"])


def _mark(files: pafs.FileSystem, folder: str, names: set[str]) -> None:
    """Say which archives count: one small file, put in place whole."""
    marker = posixpath.join(folder, MARKER)
    fresh = f"{marker}.{uuid.uuid4().hex}"
    with files.open_output_stream(fresh) as stream:
        stream.write(json.dumps({"archives": sorted(names)}).encode())
    files.move(fresh, marker)


def _archives(path: str) -> list[str]:
    """Archives a folder, a glob or a brace range stands for.

    In a folder with a marker only those it lists are there: what a writer left before
    it committed is not read.
    """
    found = []
    known: dict[tuple[str, str], set[str] | None] = {}

    def counted(files: pafs.FileSystem, folder: str) -> set[str] | None:
        place = (files.type_name, folder)
        if place not in known:
            known[place] = _marked(files, folder)
        return known[place]

    for one in expand_braces(path):
        files, inner = _open_fs(one)
        name = posixpath.basename(inner)
        if "*" in name or "?" in name:
            folder, pattern = posixpath.dirname(inner), name
        elif files.get_file_info(inner).type == pafs.FileType.Directory:
            folder, pattern = inner, "*.tar"
        else:
            names = counted(files, posixpath.dirname(inner))
            if names is not None and name not in names:
                raise FileNotFoundError(f"{one} is not among the archives that count in its folder")
            found.append(one)
            continue
        names = counted(files, folder)
        store = one.removesuffix(inner) if "://" in one else ""
        for info in files.get_file_info(pafs.FileSelector(folder)):
            counts = names is None or info.base_name in names
            if info.type == pafs.FileType.File and fnmatch(info.base_name, pattern) and counts:
                found.append(store + info.path)
    return sorted(found)


def shard_number(path: str) -> int | None:
    number = re.search(r"(\d+)\.tar$", path)
    return int(number.group(1)) if number else None


def _samples(path: str, with_content: bool) -> Iterator[tuple[str, list[tuple[str, bytes | None, int, int]]]]:
    """Each sample's key and members: extension, content, and where the content begins and how long it is."""
    files, inner = _open_fs(path)
    # Contents that nobody asks for are sought past.
    opened = files.open_input_stream(inner, buffer_size=1 << 20) if with_content else files.open_input_file(inner)
    with opened as stream, tarfile.open(fileobj=stream, mode="r|" if with_content else "r:") as tar:
        key, members = None, []
        for member in tar:
            tar.members = []
            folder, _, name = member.name.rpartition("/")
            stem, dot, extension = name.partition(".")
            if not member.isfile() or not stem or not dot:
                continue
            prefix = f"{folder}/{stem}" if folder else stem
            if prefix != key:
                if members:
                    yield key, members
                key, members = prefix, []
            if any(extension.lower() == e for e, _, _, _ in members):
                raise ValueError(f"{path}: {member.name} stands twice in sample {prefix}")
            content = tar.extractfile(member).read() if with_content else None
            members.append((extension.lower(), content, member.offset_data, member.size))
        if members:
            yield key, members


@dataclass
class Archive(InputPartition):
    path: str


class TarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Archive(p) for p in _archives(self.path)]

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        # Spark asks for one part where there is none.
        if partition is None:
            return
        shard = shard_number(partition.path)
        for key, members in _samples(partition.path, with_content=True):
            yield shard, key, {extension: content for extension, content, _, _ in members}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TarWriter(DataSourceArrowWriter):
    """Tasks give finished archives their own names; the commit lists what counts in a marker.

    The folder has a marker before the first task starts, so a write that stops leaves
    nothing that is read. An archive is moved into place by the task that wrote it, as
    soon as it is whole; the driver writes one small file. One write at a time may go to
    a folder. Appending never touches an archive that counts.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite
        files, folder = _open_fs(path)
        files.create_dir(folder, recursive=True)
        marked = _marked(files, folder)
        infos = files.get_file_info(pafs.FileSelector(folder))
        self.present = {i.base_name for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(".tar")}
        self.kept: set[str] = set() if overwrite else self.present if marked is None else marked
        _mark(files, folder, self.kept)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _open_fs(self.path)
        names: list[str] = []
        current, fresh, stream, tar = None, None, None, None

        def finish() -> None:
            tar.close()
            stream.close()
            files.move(fresh, posixpath.join(folder, names[-1]))

        try:
            for batch in iterator:
                columns = [batch.column(name).to_pylist() for name in ("shard", "key", "fields")]
                for shard, key, fields in zip(*columns):
                    if tar is None or shard != current:
                        if tar is not None:
                            finish()
                        current, name = shard, ARCHIVE.format(shard)
                        if name in names:
                            raise ValueError(f"rows of shard {shard} do not follow each other")
                        if name in self.kept:
                            raise ValueError(f"{name} is there already; use mode overwrite")
                        names.append(name)
                        fresh = posixpath.join(folder, f".{uuid.uuid4().hex}.part")
                        stream = files.open_output_stream(fresh, buffer_size=1 << 20)
                        tar = tarfile.open(fileobj=stream, mode="w|")
                    for extension, content in sorted(fields):
                        info = tarfile.TarInfo(f"{key}.{extension}")
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
                        tar.members = []
            if tar is not None:
                finish()
        except BaseException:
            if stream is not None:
                stream.close()
                if files.get_file_info(fresh).type == pafs.FileType.File:
                    files.delete_file(fresh)
            raise
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [name for m in messages if m is not None for name in m.names]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote the same shard; repartition by shard first")
        files, folder = _open_fs(self.path)
        _mark(files, folder, self.kept | set(names))
        # What no longer counts is not read; taking it away only frees space.
        stale = self.present - self.kept - set(names)
        with ThreadPoolExecutor(DELETES) as pool:
            list(pool.map(lambda name: files.delete_file(posixpath.join(folder, name)), stale))

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _open_fs(self.path)
        for name in {name for m in messages if m is not None for name in m.names} - self.kept:
            place = posixpath.join(folder, name)
            if files.get_file_info(place).type == pafs.FileType.File:
                files.delete_file(place)


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options["path"], overwrite)


def register_tars(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)


def tar_source(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, key, fields) of a folder, glob or brace range of archives."""
    register_tars(spark)
    return spark.read.format(FORMAT).load(path)


def tar_sink(
    df: DataFrame,
    path: str,
    fields: Mapping[str, str],
    idx: str = "idx",
    samples_per_shard: int = SAMPLES_PER_SHARD,
    mode: str = "append",
) -> None:
    """Write one archive per shard; ``fields`` maps a member's extension to a binary column."""
    register_tars(df.sparkSession)
    members = F.create_map(*[c for ext, col in fields.items() for c in (F.lit(ext), F.col(col))])
    (
        df.select(
            assign_shard(F.col(idx), samples_per_shard).alias("shard"),
            sample_key(F.col(idx)).alias("key"),
            F.map_filter(members, lambda _, v: v.isNotNull()).alias("fields"),
        )
        .repartition("shard")
        .sortWithinPartitions("shard", "key")
        .write.format(FORMAT)
        .mode(mode)
        .save(path)
    )


def _npy_start(shape: tuple[int, ...], dtype: str) -> bytes:
    """What a ``.npy`` file of this shape and type begins with."""
    buffer = io.BytesIO()
    np.save(buffer, np.empty(shape, dtype), allow_pickle=False)
    return buffer.getvalue()[: buffer.tell() - np.dtype(dtype).itemsize * int(np.prod(shape))]


def encode_npy(col: Column | str, dtype: str = "float16", depth: int = 1) -> Column:
    """An array column as ``.npy`` bytes; ``depth`` is the number of axes, and the shape stays."""

    @vector_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        flat, found = tensor_rows(rows)
        values = flat.astype(dtype)
        start = lru_cache(lambda shape: _npy_start(shape, dtype))
        out = [
            None if row is None else start(row[1]) + values[row[0] : row[0] + int(np.prod(row[1]))].tobytes()
            for row in found
        ]
        return pa.array(out, type=pa.binary())

    return encode(_col(col))


def _npy_layout(start: bytes) -> tuple[tuple[int, ...], np.dtype] | None:
    """Shape and type told by the start of a ``.npy`` file, unless it takes more than raw bytes."""
    buffer = io.BytesIO(start)
    np.lib.format.read_magic(buffer)
    shape, by_columns, dtype = np.lib.format.read_array_header_1_0(buffer)
    return None if by_columns or dtype.hasobject else (shape, dtype)


def _load_npy(content: bytes, layout_of: Callable) -> np.ndarray:
    """The array of a ``.npy`` file; files of one shape and type share their start."""
    if content[:8] == b"\x93NUMPY\x01\x00":
        end = 10 + int.from_bytes(content[8:10], "little")
        layout = layout_of(content[:end])
        if layout is not None:
            return np.frombuffer(content, layout[1], offset=end).reshape(layout[0])
    return np.load(io.BytesIO(content), allow_pickle=False)


def _decode_npy(col: Column, kind: str) -> Column:
    """Arrays as lists of ``kind``'s depth; axes beyond it are laid out in the last."""
    value_type = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
    depth = kind.count("array<")
    scalar = value_type[kind.replace("array<", "").rstrip(">")]

    def shaped(content: bytes, layout_of: Callable) -> np.ndarray:
        array = _load_npy(content, layout_of).astype(scalar.to_pandas_dtype(), copy=False)
        if array.ndim < depth and depth > 1:
            raise ValueError(f"an array of {array.ndim} axes is no {kind}")
        last = int(np.prod(array.shape[depth - 1 :]))
        return array.reshape(*array.shape[: depth - 1], last)

    @vector_udf(kind)
    def decode(rows: pa.Array) -> pa.Array:
        layout_of = lru_cache(_npy_layout)
        arrays = [None if content is None else shaped(content, layout_of) for content in rows.to_pylist()]
        return tensor_lists(arrays, depth, scalar)

    return decode(col)


def decode_fields(df: DataFrame, spec: Mapping[str, tuple[str, str]], fields: str = "fields") -> DataFrame:
    """Add typed columns: ``{"latents": ("latents.npy", "array<float>")}``, of any depth for ``.npy``.

    The last part of a member's extension says how to read it: npy, json and txt
    (text), cls (a whole number). Pickles can run code and are refused.
    """
    out = df
    for name, (extension, kind) in spec.items():
        content = F.try_element_at(F.col(fields), F.lit(extension))
        last = extension.rpartition(".")[2]
        if last == "npy":
            column = _decode_npy(content, kind)
        elif last in ("json", "txt", "cls"):
            column = F.decode(content, "UTF-8").cast(kind)
        else:
            raise ValueError(f"members of type .{last} are not decoded")
        out = out.withColumn(name, column)
    return out


MEMBERS = "path string, shard int, key string, first bigint, extension string, offset bigint, length bigint"


def index_members(spark: SparkSession, path: str) -> DataFrame:
    """Where each member of the archives of ``path`` lies: path, shard, key, extension, offset, length.

    ``first`` is the offset of the sample's first member and tells its samples apart. A task goes over the headers of an archive and skips the contents. Kept as a table,
    the index lets many tasks read one large archive, or find samples by key.
    """
    archives = _archives(path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = (
                    (archive, shard_number(archive), key, members[0][2], extension, offset, length)
                    for key, members in _samples(archive, with_content=False)
                    for extension, _, offset, length in members
                )
                while some := list(islice(found, MEMBERS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    names = ["path", "shard", "key", "first", "extension", "offset", "length"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = spark.createDataFrame([(a,) for a in archives], "path string")
    return rows.repartition(max(len(archives), 1), "path").mapInArrow(walk, MEMBERS)


def read_members(members: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """Samples (shard, key, fields) of rows of a member index, by range reads.

    Members are dealt by stretches of ``bytes_per_task`` of their archive, so a large
    archive is read by several tasks; a task reads its members in the order of their
    place. A sample stays together: its stretch is that of its first member. Rows may be
    filtered beforehand, by key or by extension; the rest of an archive is not read.
    """
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    # A fixed number of partitions: the index is small, what it points to is not.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*names).repartition(tasks, "path", F.floor(F.col("first") / bytes_per_task))
    ordered = dealt.sortWithinPartitions("path", "first", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        current, shard, fields, size = None, None, [], 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.map_(pa.string(), pa.binary())))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["shard", "key", "fields"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    for file in opened.values():
                        file.close()
                    files, inner = _open_fs(row["path"])
                    opened = {row["path"]: files.open_input_file(inner)}
                if current != (row["path"], row["first"], row["key"]):
                    if current is not None:
                        done.append((shard, current[2], fields))
                        if size > MEMBER_BYTES:
                            yield flush()
                            size = 0
                    current, shard, fields = (row["path"], row["first"], row["key"]), row["shard"], []
                content = opened[row["path"]].read_at(row["length"], row["offset"])
                size += len(content)
                fields.append((row["extension"], content))
        if current is not None:
            done.append((shard, current[2], fields))
            yield flush()
        for file in opened.values():
            file.close()

    return ordered.mapInArrow(fetch, SCHEMA)
