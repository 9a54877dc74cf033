"""Queries on tables of other shapes than the test data's."""

from __future__ import annotations

import errno
import os
from collections import Counter

import duckdb
import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

import __spark_entry__ as registered
from tests.oracle import differences
from vecloom.plans import reads
from vecloom.sources import expand_shards, list_files


@pytest.mark.parametrize("folder", [True, False])
@pytest.mark.parametrize("name", ["stream_shards", "stream_prepare", "stream_indexed"])
def test_streams_read_a_table_of_any_files(spark, tmp_path, name, folder):
    n = F.col("id")
    embeddings = spark.range(30, numPartitions=3).select(
        n.alias("vec_id"),
        (n % 4).cast("int").alias("label"),
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * n % 7).cast("float")).alias("embedding"),
    )
    # Languages are spread over the files: an index by file would number them otherwise.
    documents = spark.range(30, numPartitions=3).select(
        n.alias("doc_id"), F.concat(F.lit("l"), n % 3).alias("lang"), (90 + n).alias("n_chars")
    )
    connection = duckdb.connect()
    for table, rows in (("embeddings", embeddings), ("documents", documents)):
        path = tmp_path / f"{table}.parquet"
        if folder:
            rows.write.parquet(str(path))
        else:
            rows.toPandas().to_parquet(path, index=False)
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if folder else ''}'")
    result = registered.queries()[name](spark, str(tmp_path))
    assert differences(result, connection, registered.oracle_sql()[name]) == []


def test_shard_names_are_made_by_many_tasks(spark, tmp_path):
    parts = [(1, 50), (1, 50), (2, 1), (3, 12), (None, 3), (4, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    result = registered.queries()["expand_shards"](spark, str(tmp_path))
    assert result.rdd.getNumPartitions() > 1
    # What a pattern is cut into is bound once: no expression holds copies of another.
    assert result._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 20
    known = [r for r in result.collect() if r.name is not None and r.p_partkey is not None]
    expected = [f"p{key}-{k:06d}.tar" for key, size in parts if key and size for k in range(1, size + 1)]
    assert sorted(r.name for r in known) == sorted(expected)


@pytest.mark.parametrize(
    "pattern, names",
    [
        ("s-{a{1,2},b}", ["s-a1", "s-b", "s-a2", "s-b"]),
        ("s-{{1,3}..2}", ["s-1", "s-2", "s-3", "s-2"]),
        ("{,}{x}{0..1}", ["{x}0", "{x}1", "{x}0", "{x}1"]),
        (None, [None]),
    ],
)
def test_braces_within_braces(spark, pattern, names):
    rows = spark.createDataFrame([(pattern,)], "p string")
    assert rows.select(expand_shards(F.col("p")).alias("n")).head()["n"] == names


def test_too_many_braces(spark):
    with pytest.raises(Exception, match="braces"):
        spark.range(1).select(expand_shards(F.lit("{a,b}" * 5))).collect()


def test_folders_are_listed_by_many_tasks(spark, tmp_path):
    orders = [(i, i % 13, "P" if i % 5 == 0 else "O") for i in range(60)] + [(None, 3, "O"), (70, None, "O"), (71, 3, None)]
    rows = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").coalesce(1)
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    result = registered.queries()["list_manifest"](spark, str(tmp_path))
    assert result.rdd.getNumPartitions() > 1
    expected = [
        (c if c % 10 else None, f"run-{c}/checkpoint_step_{o}.pt", o)
        for o, c, status in orders if o is not None and c is not None and status != "P"
    ]
    assert sorted(map(str, map(tuple, result.collect()))) == sorted(map(str, expected))
    folders = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(8)], "f string").coalesce(1)
    assert list_files(folders, "f", "*").rdd.getNumPartitions() > 1


def test_files_to_list_take_few_of_the_file_system(spark, tmp_path, monkeypatch):
    """A file system has a limited number of files: however many names there are, few are taken."""
    orders = [(i, i % 37, "P" if i % 5 == 0 else "O") for i in range(400)] + [(None, 3, "O"), (900, None, "O"), (901, 3, None), (5, 5, "O")]
    rows = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    made = tmp_path / "made"
    monkeypatch.setattr(reads, "fresh_path", lambda spark, name: str(made / name))
    found = registered.queries()["list_manifest"](spark, str(tmp_path))
    expected = {
        (c if c % 10 else None, f"run-{c}/checkpoint_step_{o}.pt", o)
        for o, c, status in orders if o is not None and c is not None and status != "P"
    }
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    written = [p for p in made.rglob("*.pt") if p.is_file() and not p.stat().st_size]
    assert len(written) == len({(o, c, s == "P") for o, c, s in orders if o is not None and c is not None})
    assert len({p.stat().st_ino for p in written}) <= 8


def test_an_empty_file_takes_only_so_many_names(tmp_path, monkeypatch):
    files, link, links = LocalFileSystem(), os.link, Counter()

    def few(seed, path):
        if links[seed] == 3:
            raise OSError(errno.EMLINK, "too many links")
        link(seed, path)
        links[seed] += 1

    monkeypatch.setattr(os, "link", few)
    make = reads._empty_files(files, str(tmp_path / "base"))
    for name in [*"abcdefgh", "a"]:
        make(str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        make(str(tmp_path / "none" / "a"))
    assert sorted(links.values()) == [2, 3, 3] and all((tmp_path / n).stat().st_size == 0 for n in "abcdefgh")
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError()))
    for name in "ijk":
        make(str(tmp_path / name))
    assert all((tmp_path / n).is_file() for n in "ijk") and len(list((tmp_path / "base").iterdir())) == 4
