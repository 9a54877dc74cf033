"""Queries of indexing, shuffling, batching and step accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import (
    accumulate_loss,
    accumulation_plan,
    assign_shard,
    batch,
    batch_mean_loss,
    global_index,
    repeat_epochs,
    shuffle_samples,
    shuffle_shards,
    step_plan,
)
from vecloom.plans.catalog import query, r6, table


def word_sql(seed: int, tag: str, key: str) -> str:
    return f"('0x'||substr(md5('{seed}:'||{tag}||':'||{key}),1,8))::BIGINT"


@query(
    "global_index",
    """select source, doc_id, idx, lpad(idx::VARCHAR, 8, '0') AS key from (
  select source, doc_id, row_number() over (order by source, doc_id) - 1 idx from documents)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    return global_index(rows, "source", "doc_id").select("source", "doc_id", "idx", "key")


@query("assign_shard", "select doc_id, (doc_id//50)::INTEGER shard from documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", assign_shard(F.col("doc_id"), 50).alias("shard"))


@query(
    "shuffle_shards",
    f"""with s as (select distinct doc_id//20 shard from documents),
r as (select shard, row_number() over (order by {word_sql(7, "'shard'", 'shard')}, shard) - 1 shard_pos from s)
select doc_id, shard, shard_pos from documents join r on shard = doc_id//20""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 20).alias("shard"))
    return shuffle_shards(rows, seed=7).select("doc_id", "shard", "shard_pos")


@query(
    "shuffle_samples",
    f"""select doc_id, row_number() over (order by w, doc_id) - 1 pos,
doc_id//100*100 + row_number() over (partition by doc_id//100 order by w, doc_id) - 1 buffered_pos
from (select doc_id, {word_sql(7, "0", 'doc_id')} w from documents)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id")
    buffered = shuffle_samples(rows, "doc_id", seed=7, buffer=100, idx="doc_id")
    return shuffle_samples(buffered.withColumnRenamed("pos", "buffered_pos"), "doc_id", seed=7)


@query(
    "batch",
    """select doc_id//32 batch_id, count(*)::INTEGER n, min(doc_id) first_id, max(doc_id) last_id,
string_agg(md5(text), '' order by doc_id) digests from documents group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return batch(rows, 32, "doc_id").select(
        "batch_id",
        "n",
        F.col("samples")[0]["doc_id"].alias("first_id"),
        F.element_at("samples", -1)["doc_id"].alias("last_id"),
        F.array_join(F.col("samples.digest"), "").alias("digests"),
    )


@query(
    "repeat_epochs",
    f"""select doc_id, quality, epoch::INTEGER epoch,
row_number() over (partition by epoch order by {word_sql(3, 'epoch', 'doc_id')}, doc_id) - 1 pos
from labels, range(3) r(epoch)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return repeat_epochs(rows, "doc_id", 3, seed=3)


@query(
    "accumulation_plan",
    """select o_orderkey, o_orderkey//3 step, o_orderkey%3 micro, o_orderkey%3 < 2 used, o_orderkey//2 step_all,
o_orderkey%2 micro_all from orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "orders").select("o_orderkey")
    every = accumulation_plan(batches, 2, "o_orderkey", faithful=False)
    every = every.select("o_orderkey", F.col("step").alias("step_all"), F.col("micro").alias("micro_all"))
    return accumulation_plan(every, 2, "o_orderkey")


@query(
    "step_plan",
    """select p_partkey, images_per_step, ceil(p_partkey/images_per_step)::BIGINT n_steps,
ceil(p_retailprice/p_size)::BIGINT eval_batches
from (select *, (p_size*2*2)::BIGINT images_per_step from part)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = table(spark, sf_dir, "part").withColumn("two", F.lit(2))
    plan = step_plan(settings, "p_partkey", "p_size", "two", "two", "p_retailprice")
    return plan.select("p_partkey", "images_per_step", "n_steps", "eval_batches")


@query(
    "batch_mean_loss",
    """select b.*, row_loss from (
  select event_type, round(avg(m), 6)+0.0 mean_loss from (
    select event_type, event_id//128 b, avg(value) m from events group by all) group by 1) b
join (select event_type, round(avg(value), 6)+0.0 row_loss from events group by 1) r using (event_type)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_type", "value", F.floor(F.col("event_id") / 128).alias("batch_id")
    )
    by_batch = batch_mean_loss(rows, "batch_id", "value", ["event_type"])
    by_row = batch_mean_loss(rows, "batch_id", "value", ["event_type"], row_weighted=True)
    both = by_batch.join(by_row.withColumnRenamed("mean_loss", "row_loss"), "event_type")
    return both.select("event_type", r6(F.col("mean_loss")).alias("mean_loss"), r6(F.col("row_loss")).alias("row_loss"))


@query(
    "accumulate_loss",
    """select event_id//5 step, round(sum(value/4.0::DOUBLE), 6)+0.0 step_loss from events
where event_id%5 < 4 group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = accumulation_plan(table(spark, sf_dir, "events").select("event_id", "value"), 4, "event_id")
    losses = accumulate_loss(plan.filter("used"), "step", "value", 4)
    return losses.select("step", r6(F.col("step_loss")).alias("step_loss"))
