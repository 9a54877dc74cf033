"""Rows, indexes, shuffles, batches and manifests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vecloom.operators import (
    accumulate_loss,
    accumulation_plan,
    assign_shard,
    batch,
    batch_mean_loss,
    cadence,
    drop_blank,
    global_index,
    latest_checkpoint,
    newest_first,
    parse_manifest,
    repeat_epochs,
    require_one_of,
    resume_after,
    retention,
    retention_deletes,
    shuffle_samples,
    shuffle_shards,
    split_by_rank,
    split_train_eval,
    step_plan,
    take_first,
)


def test_drop_blank(spark):
    rows = [(1, "a"), (2, ""), (3, " \t\n"), (4, None), (5, " b "), (6, "\u00a0\u2003\u3000"), (7, "\u00a0é")]
    kept = drop_blank(spark.createDataFrame(rows, "id int, t string"), "t")
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 5, 7]
    every = [(i, chr(i)) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    kept = drop_blank(spark.createDataFrame(every, "id int, t string"), "t")
    assert {r.id for r in kept.collect()} == {i for i, c in every if c.strip()}


def test_take_first(spark):
    assert [r.id for r in take_first(spark.range(50).repartition(5), 3, "id").collect()] == [0, 1, 2]


def test_resume_after_skips_whole_batches(spark):
    rows = spark.range(10).withColumnRenamed("id", "idx")
    assert resume_after(rows, 2, 4).count() == 2
    assert resume_after(rows, 0, 4).count() == 10


def test_splits_partition_the_rows(spark):
    rows = spark.range(100).withColumn("shard", F.floor(F.col("id") / 10))
    assert {(r.split, r["count"]) for r in split_train_eval(rows).groupBy("split").count().collect()} == {
        ("eval", 10), ("train", 90),
    }
    assert sorted(split_by_rank(rows, r, 3).count() for r in range(3)) == [30, 30, 40]
    from_one = split_by_rank(rows.filter("shard > 0"), 0, 3, first=1)
    assert {r.shard for r in from_one.collect()} == {1, 4, 7}
    with pytest.raises(ValueError):
        split_by_rank(rows, 3, 3)


def test_cadence(spark):
    flags = {r.step: r for r in cadence(spark.range(1001).withColumnRenamed("id", "step"), last=998).collect()}
    assert not flags[0].evaluates and not flags[0].saves
    assert flags[100].evaluates and not flags[100].saves
    assert flags[500].evaluates and flags[500].saves
    assert flags[4].emits and not flags[5].emits and flags[997].emits


def test_require_one_of(spark):
    rows = [("t", None, None), (None, 1, 2), (None, 1, None), ("t", 1, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, e int, m int")
    kinds = [r.input_kind for r in require_one_of(df, "t", ["e", "m"]).collect()]
    assert kinds == ["single", "group", "invalid", "invalid", "invalid"]
    valid = spark.createDataFrame(rows[:2], df.schema)
    assert require_one_of(valid, "t", ["e", "m"], "fail").filter("input_kind = 'group'").count() == 1
    with pytest.raises(Exception, match="must be given"):
        require_one_of(df, "t", ["e", "m"], "fail").collect()


def test_global_index_is_gapless_and_ordered(spark):
    rows = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit("hot").alias("source")).repartition(13)
    got = global_index(rows, "source", "k").collect()
    assert sorted((r.idx, r.k) for r in got) == [(i, i) for i in range(1000)]
    assert {r.key for r in got} == {f"{i:08d}" for i in range(1000)}


def test_global_index_of_few_rows(spark):
    rows = spark.createDataFrame([(5, "x")], "k int, v string")
    assert global_index(rows, "k").collect() == [(0, "00000000", 5, "x")]
    assert global_index(rows.filter("k < 0"), "k").count() == 0


def test_keys_over_eight_digits_stay_whole(spark):
    from vecloom.operators.feed import sample_key

    assert spark.range(1).select(sample_key(F.lit(1234567890123))).head()[0] == "1234567890123"


def test_assign_shard(spark):
    df = spark.range(25).select("id", assign_shard(F.col("id"), 10).alias("s"))
    assert [r["count"] for r in df.groupBy("s").count().orderBy("s").collect()] == [10, 10, 5]


def test_shuffle_samples_is_a_seeded_permutation(spark):
    rows = spark.range(500)

    def order(df, **options):
        return {r.id: r.pos for r in shuffle_samples(df, "id", **options).collect()}

    first = order(rows, seed=1)
    assert sorted(first.values()) == list(range(500))
    assert first == order(rows.repartition(11), seed=1)
    assert first != order(rows, seed=2) and first != order(rows, seed=1, epoch=1)
    assert sum(first[i] == i for i in first) < 20


def test_shuffle_does_not_depend_on_the_number_of_partitions(spark):
    rows = spark.range(500)
    one = {tuple(r) for r in shuffle_samples(rows, "id", seed=1).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert one == {tuple(r) for r in shuffle_samples(rows, "id", seed=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_buffered_shuffle_stays_in_its_block(spark):
    got = shuffle_samples(spark.range(95), "id", seed=1, buffer=10, idx="id").collect()
    assert sorted(r.pos for r in got) == list(range(95))
    assert all(r.pos // 10 == r.id // 10 for r in got)


def test_shuffle_shards(spark):
    rows = spark.range(90).withColumn("shard", F.expr("if(id < 30, 0, id div 10)"))
    got = shuffle_shards(rows, seed=3).collect()
    places = {(r.shard, r.shard_pos) for r in got}
    assert len(got) == 90 and sorted(p for _, p in places) == list(range(7))


def test_batches_partition_the_rows(spark):
    rows = spark.range(10).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("v")).repartition(4)
    got = batch(rows, 4).orderBy("batch_id").collect()
    assert [[s.v for s in r.samples] for r in got] == [[0, 2, 4, 6], [8, 10, 12, 14], [16, 18]]
    assert [r.n for r in got] == [4, 4, 2]


def test_repeat_epochs(spark):
    got = repeat_epochs(spark.range(20), "id", 3, seed=1).collect()
    orders = {e: [r.id for r in sorted(got, key=lambda r: r.pos) if r.epoch == e] for e in range(3)}
    assert all(sorted(o) == list(range(20)) for o in orders.values())
    assert orders[0] != orders[1]


def test_accumulation_plan_drops_the_last_batch_of_a_step(spark):
    batches = spark.range(9).withColumnRenamed("id", "batch_id")
    unused = accumulation_plan(batches, 2).filter("not used").collect()
    assert sorted(r.batch_id for r in unused) == [2, 5, 8]
    assert accumulation_plan(batches, 2, faithful=False).filter("not used").count() == 0


def test_step_plan(spark):
    row = spark.createDataFrame([(2048, 128, 2, 2, 300)], "images int, b int, a int, w int, e int")
    got = step_plan(row, "images", "b", "a", "w", "e").head()
    assert (got.images_per_step, got.n_steps, got.eval_batches) == (512, 4, 3)


def test_losses(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "b int, loss double")
    assert batch_mean_loss(rows, "b", "loss").head()[0] == 6.0
    assert batch_mean_loss(rows, "b", "loss", row_weighted=True).head()[0] == pytest.approx(14 / 3)
    assert batch_mean_loss(rows.limit(0), "b", "loss").head()[0] is None
    assert {tuple(r) for r in accumulate_loss(rows, "b", "loss", 2).collect()} == {(0, 2.0), (1, 5.0)}


STEPS = [100, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 5500]


@pytest.fixture()
def listing(spark):
    names = [f"run/checkpoint_step_{s}.pt" for s in STEPS] + ["run/checkpoint_step_best.pt"]
    names += ["run/checkpoint_step_7000.pt.part", "run/old_checkpoint_step_8000.pt"]
    return parse_manifest(spark.createDataFrame([(n,) for n in names], "path string"))


def test_manifest(listing):
    assert listing.count() == 12
    assert [r.step for r in newest_first(listing).collect()] == STEPS[::-1]
    assert latest_checkpoint(listing).head().path == "run/checkpoint_step_5500.pt"
    assert latest_checkpoint(listing.limit(0)).head().path is None


def test_retention(listing):
    kept = {r.step for r in retention(listing).filter("keep").collect()}
    assert kept == {2500, 3500, 4000, 4500, 5000, 5500}
    assert {r.step for r in retention_deletes(listing).collect()} == set(STEPS) - kept


def test_retention_per_run_with_one_huge_run(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("run"), F.col("id").alias("step")
    ).withColumn("path", F.concat(F.lit("p"), F.col("step")))
    kept = retention(rows, 5, 2500, ["run"]).filter("keep")
    assert {r.step for r in kept.filter("run = 0 and step < 2990").collect()} == {0, 2500}
    assert kept.filter("run = 0").count() == 7
    assert kept.filter("run > 0").count() == 1000
    assert retention_deletes(rows, 5, 2500, ["run"]).count() == 2000 - 7


@pytest.mark.parametrize("n", [0, 1, 25, 59, 60, 1000])
def test_take_first_is_sorted_whatever_the_number(spark, n):
    rows = spark.range(60).select((59 - F.col("id")).alias("id"), F.lit(1).alias("_row")).repartition(5)
    got = take_first(rows, n, "id")
    assert got.columns == ["id", "_row"] and [r.id for r in got.collect()] == list(range(min(n, 60)))


@pytest.mark.parametrize("n", [99_999, 100_001])
def test_take_first_of_many_is_spread(spark, n):
    rows = spark.range(150_000).select((149_999 - F.col("id")).alias("id"))
    got = take_first(rows, n, "id").withColumn("part", F.spark_partition_id())
    assert got.agg(F.count("*"), F.max("id")).head() == (n, n - 1)
    assert "Limit" not in got._jdf.queryExecution().executedPlan().toString()


def test_an_index_runs_nothing_beforehand(spark):
    rows = spark.range(10).select(F.when(F.raise_error(F.lit("ran")).isNull(), F.col("id")).alias("id"))
    for build in (lambda: global_index(rows, "id"), lambda: take_first(rows, 3, "id")):
        with pytest.raises(Exception, match="ran"):
            build().collect()


def test_an_index_of_nulls_nans_and_repeats(spark):
    nan = float("nan")
    rows = [(None, 1.0), (2, nan), (None, None), (2, 0.5), (1, 7.0), (1, 7.0), (1, 7.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = global_index(df, "k", "v").orderBy("idx").collect()
    assert [(r.k, str(r.v)) for r in got] == [(None, "None"), (None, "1.0"), *[(1, "7.0")] * 3, (2, "0.5"), (2, "nan")]
    assert [r.idx for r in got] == list(range(7))


def test_an_index_by_narrow_ties(spark):
    rows = spark.range(500).select((F.col("id") % 100).alias("k"), F.col("id"))
    got = global_index(rows.repartition(7), "k", ties=[]).collect()
    assert [r.k for r in sorted(got)] == [i // 5 for i in range(500)] and sorted(r.idx for r in got) == list(range(500))


def test_shuffle_by_two_columns(spark):
    rows = spark.range(300).select(F.lit("hot").alias("source"), F.col("id"))
    got = shuffle_samples(rows, ["source", "id"], seed=1).collect()
    assert sorted(r.pos for r in got) == list(range(300))


def test_one_hot_shard_keeps_all_its_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).alias("shard"))
    got = shuffle_shards(rows, seed=1).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("shard_pos").alias("p"))
    found = {r.shard: (r.n, r.p) for r in got.collect()}
    assert found[7] == (1000, 1) and all(p == 1 for _, p in found.values())
    assert sum(n for n, _ in found.values()) == 3000
