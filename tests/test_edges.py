"""Nulls, repeats and other rows that the given tables do not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vecloom.functions import layout, scale_latents
from vecloom.operators import (
    clip_norm,
    global_index,
    repeat_epochs,
    require_one_of,
    retention,
    retention_deletes,
    shuffle_samples,
    shuffle_shards,
    zip_columns,
)
from vecloom.sources import expand_shards
from vecloom.sources.shards import expand_braces


def test_shuffles_keep_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (None, None)], "a int, b string")
    assert sorted(r["pos"] for r in shuffle_samples(rows, ["a", "b"], seed=1).collect()) == [0, 1, 2, 3]
    assert sorted(r["pos"] for r in shuffle_samples(rows, "a", seed=1).collect()) == [0, 1, 2, 3]
    epochs = repeat_epochs(rows, ["a", "b"], 2).collect()
    assert sorted((r["epoch"], r["pos"]) for r in epochs) == [(e, p) for e in range(2) for p in range(4)]


def test_rows_without_a_shard_make_a_shard(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, None)], "id int, shard int")
    found = {r["id"]: r["shard_pos"] for r in shuffle_shards(rows, seed=1).collect()}
    assert len(found) == 4 and found[3] == found[4] and set(found.values()) == {0, 1, 2}


def test_retention_of_a_null_run_and_of_repeated_listings(spark):
    rows = spark.createDataFrame([(None, f"p{i}", i) for i in range(1, 9)], "run int, path string, step long")
    assert retention(rows, by=["run"]).filter("keep").count() == 5
    assert {r["step"] for r in retention_deletes(rows, by=["run"]).collect()} == {1, 2, 3}
    twice = rows.unionByName(rows)
    assert retention(twice, by=["run"]).count() == 16
    assert retention(twice, by=["run"]).filter("keep").count() == 10
    assert retention(twice).filter("keep").count() == 10
    assert retention(rows, 0).filter("keep").count() == 0
    assert retention(rows.filter("false"), by=["run"]).count() == retention(rows.filter("false")).count() == 0


def test_a_null_group_is_clipped(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (None, [6.0, 8.0])], "g int, v array<double>")
    found = {r["g"]: (r["norm"], r["v"]) for r in clip_norm(rows, "v", 5.0, ["g"]).collect()}
    assert found[None][0] == 10.0 and found[None][1] == pytest.approx([3.0, 4.0], rel=1e-5)
    assert found[1] == (5.0, pytest.approx([3.0, 4.0], rel=1e-5))


def test_zip_keeps_a_row_with_a_null_array(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3, 4, 5]), (2, None, [6]), (3, [], [7])], "id int, a array<int>, b array<int>")
    found = sorted((tuple(r) for r in zip_columns(rows, ["a", "b"], ["id"]).collect()), key=str)
    assert found == [(1, 1, 3), (1, 2, 4), (2, None, None)]


def test_a_failing_check_cannot_be_pruned(spark):
    rows = spark.createDataFrame([(1, None, None)], "id int, a string, b string")
    checked = require_one_of(rows, "a", ["b"], "fail")
    for act in (lambda: checked.count(), lambda: checked.select("id").collect()):
        with pytest.raises(Exception, match="must be given"):
            act()
    good = spark.createDataFrame([(1, "x", None), (2, None, "y")], "id int, a string, b string")
    assert [r["input_kind"] for r in require_one_of(good, "a", ["b"], "fail").orderBy("id").collect()] == ["single", "group"]


@pytest.mark.parametrize(
    "pattern, names",
    [
        ("d{0..1}/s-{0..2}.tar", [f"d{d}/s-{s}.tar" for d in range(2) for s in range(3)]),
        ("s-{a,b}.tar", ["s-a.tar", "s-b.tar"]),
        ("s-{08..10}", ["s-08", "s-09", "s-10"]),
        ("s-{2..1}{,x}", ["s-2", "s-2x", "s-1", "s-1x"]),
        ("plain{}", ["plain{}"]),
    ],
)
def test_braces(spark, pattern, names):
    assert expand_braces(pattern) == names
    assert spark.range(1).select(expand_shards(F.lit(pattern)).alias("n")).head()["n"] == names


def test_layout_binds_a_computed_array_once(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    laid = rows.select(layout(scale_latents("x"), 2, 2, "channels_last").alias("x"))
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0.18215") == 1
    assert laid.head()["x"] == pytest.approx([v * 0.18215 for v in (1.0, 3.0, 2.0, 4.0)])


def test_ties_of_an_index_are_spread(spark):
    rows = spark.range(200_000).select(F.col("id"), F.lit("x").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexed = global_index(rows, "source")
        sizes = [r["count"] for r in indexed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 60_000
    assert indexed.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).head() == (0, 199_999, 200_000)
