"""Queries of vector functions, models and sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import (
    layer_norm,
    linear_project,
    lr_schedule,
    recover_latent,
    sample_noise,
    sample_time,
    time_embedding,
    tokenize_pad,
    velocity_mse,
)
from vecloom.functions.arrays import doubles
from vecloom.functions.arrow import once
from vecloom.operators import (
    clip_norm,
    embed_images,
    embed_text,
    euler_fold,
    euler_sample,
    euler_snapshots,
    map_rows,
    velocity_at,
    velocity_loss,
)
from vecloom.plans.catalog import TOKEN_ID, drawn_sql, elements_sql, noise_sql, query, r6, table, time_sql, weighted
from vecloom.plans.score import draw

DIM = 64
E = elements_sql()
D = drawn_sql()


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIM)


def one_by_one(df: DataFrame, *cols: str, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Arrays side by side, one row per element; ``i`` counts from 1."""
    rows = df.select(*keep, F.posexplode(once(F.arrays_zip(*cols))).alias("at", "s"))
    return rows.select(
        *keep, (F.col("at") + 1).cast("bigint").alias("i"), *[r6(F.col(f"s.{c}").cast("double")).alias(c) for c in cols]
    )


def at_rest(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.zeros_like(z)


@query(
    "score_velocity",
    f"""with {D}, l as (select vec_id, label, avg((x-noise)*(x-noise)) loss from d group by all)
select label, count(*)::BIGINT n, round(avg(loss), 6)+0.0 loss from l group by label""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = velocity_loss(F.col("vec_id"), F.col("embedding"), DIM, at_rest)
    losses = table(spark, sf_dir, "embeddings").select("label", loss.alias("loss"))
    return losses.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("loss")).alias("loss"))


@query(
    "sample_noise",
    f"select vec_id, i, round(z, 6)+0.0 noise from ({noise_sql('embeddings', 'vec_id', DIM, 11)})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sample_noise(F.col("vec_id"), DIM, 11).alias("noise"))
    return one_by_one(rows, "noise")


@query("sample_time", f"select vec_id, round({time_sql('vec_id', 11)}, 9)+0.0 t from embeddings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.round(sample_time(F.col("vec_id"), 11), 9) + F.lit(0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", t.alias("t"))


@query("interpolate", f"with {D} select vec_id, i, round((1-t)*noise+t*x, 6)+0.0 z_t from d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_by_one(drawn(spark, sf_dir), "z_t")


@query("target_velocity", f"with {D} select vec_id, i, round(x-noise, 6)+0.0 target from d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_by_one(drawn(spark, sf_dir), "target")


@query(
    "recover_latent",
    f"""with {D} select vec_id, round(sum(i*x), 6)+0.0 exact,
round(sum(i*(((1-t)*noise+t*x)+(1-t)*noise)), 6)+0.0 rough from d group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drawn(spark, sf_dir)
    return rows.select(
        "vec_id",
        r6(weighted(recover_latent("z_t", "target", F.col("time")))).alias("exact"),
        r6(weighted(recover_latent("z_t", "noise", F.col("time")))).alias("rough"),
    )


@query(
    "velocity_mse",
    f"""with {D} select vec_id, round(avg((((1-t)*noise+t*x)-(x-noise))*(((1-t)*noise+t*x)-(x-noise))), 6)+0.0 loss
from d group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir).select("vec_id", r6(velocity_mse("z_t", "target")).alias("loss"))


def towards(z: np.ndarray, t: float | np.ndarray, x: np.ndarray) -> np.ndarray:
    """A field that pulls to ``x``, more so as time goes on."""
    return (x - z) * (1.0 + t)


def euler_sql(n: int) -> str:
    """CTEs ``e``, ``nz`` and ``walk``: the state of ``towards`` after each step."""
    return f"""e as ({E}), nz as ({noise_sql('embeddings', 'vec_id', DIM)}),
walk as (select e.vec_id, e.i, x, z, 0 step from e join nz on e.vec_id = nz.vec_id and e.i = nz.i
union all select vec_id, i, x, z+(x-z)*(1+step/{n}.0::DOUBLE)/{n}.0::DOUBLE, step+1 from walk where step < {n})"""


@query(
    "euler_sample",
    f"with recursive {euler_sql(50)} select vec_id, i, round(z, 6)+0.0 z from walk where step = 50",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = sample_noise(F.col("vec_id"), DIM)
    end = euler_sample(start, towards, 50, [F.col("embedding")])
    return one_by_one(table(spark, sf_dir, "embeddings").select("vec_id", end.alias("z")), "z")


@query(
    "euler_fold",
    f"""with recursive {euler_sql(10)} select vec_id, i, round(z, 6)+0.0 z from walk where step = 10""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("start", sample_noise(F.col("vec_id"), DIM))

    def pull(z: F.Column, t: F.Column) -> F.Column:
        return F.zip_with(doubles("embedding"), z, lambda x, a: (x - a) * (1 + t))

    return one_by_one(rows.select("vec_id", euler_fold(F.col("start"), pull, 10).alias("z")), "z")


@query(
    "euler_snapshots",
    f"""with recursive {euler_sql(12)} select vec_id, step::INTEGER step, round(sum(i*z), 6)+0.0 z from walk
where step in (5, 10, 12) group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("z", sample_noise(F.col("vec_id"), DIM))
    shots = euler_snapshots(rows, "z", towards, 12, 5, ["embedding"])
    return shots.select("vec_id", "step", r6(weighted(F.col("z"))).alias("z"))


@query(
    "apply_velocity",
    f"""with {D} select vec_id, round(sum(i*(x-((1-t)*noise+t*x))*(1+t)), 6)+0.0 velocity from d group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = velocity_at(F.col("z_t"), F.col("time"), towards, [F.col("embedding")])
    return drawn(spark, sf_dir).select("vec_id", r6(weighted(v)).alias("velocity"))


@query(
    "time_embedding",
    """select event_id, round(sum((k+1)*sin(value*f)), 6)+0.0 sines, round(sum((k+1)*cos(value*f)), 6)+0.0 cosines
from events, (select k, exp(-k*ln(10000.0::DOUBLE)/15) f from range(16) r(k)) group by event_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", time_embedding(F.col("value"), 32).alias("v"))
    return rows.select(
        "event_id",
        r6(weighted(F.slice("v", 1, 16))).alias("sines"),
        r6(weighted(F.slice("v", 17, 16))).alias("cosines"),
    )


@query(
    "layer_norm",
    f"""with m as (select vec_id, avg(x) mu, var_pop(x) va from ({E}) group by 1)
select e.vec_id, e.i, round((x-mu)/sqrt(va+1e-5::DOUBLE)*(1+i/64.0::DOUBLE)+0.5, 6)+0.0 y
from ({E}) e join m using (vec_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.lit([(i + 1) / DIM for i in range(DIM)])
    shift = F.array_repeat(F.lit(0.5), DIM)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", layer_norm("embedding", scale, shift).alias("y"))
    return one_by_one(rows, "y")


@query(
    "linear_project",
    f"""select vec_id, o output, round(sum(sin((o*64+i-1)::DOUBLE)*x)+cos(o::DOUBLE)+o/100.0::DOUBLE, 6)+0.0 y
from ({E}), range(8) r(o) group by vec_id, o""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = np.sin(np.arange(8 * DIM, dtype=np.float64)).reshape(8, DIM)
    bias, position = np.cos(np.arange(8.0)), np.arange(8) / 100.0
    projected = linear_project("embedding", weight, bias, position)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(once(projected)).alias("at", "v"))
    return rows.select("vec_id", F.col("at").cast("bigint").alias("output"), r6(F.col("v")).alias("y"))


@query(
    "clip_norm",
    f"""with n as (select sqrt(sum(x*x)) whole from ({E})),
g as (select label, sqrt(sum(x*x)) part from ({E}) group by 1)
select vec_id, round(whole, 6)+0.0 norm, round(sum(i*x)*least(1, 1/(whole+1e-6::DOUBLE)), 6)+0.0 clipped,
round(sum(i*x)*least(1, 5/(part+1e-6::DOUBLE)), 6)+0.0 clipped_by_label
from ({E}) e join g using (label), n group by vec_id, whole, part""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("other", F.col("embedding"))
    whole = clip_norm(rows, "embedding", 1.0).withColumnRenamed("norm", "whole")
    both = clip_norm(whole, "other", 5.0, ["label"])
    return both.select(
        "vec_id",
        r6(F.col("whole")).alias("norm"),
        r6(weighted(F.col("embedding"))).alias("clipped"),
        r6(weighted(F.col("other"))).alias("clipped_by_label"),
    )


def _tokens(table_name: str, key: str) -> str:
    return f"""select {key}, len(t)::INTEGER n_tokens, 128::INTEGER width, least(len(t), 128)::INTEGER mask_sum,
coalesce(list_sum(list_transform(list_slice(t, 1, 128), lambda w, k: {TOKEN_ID}*k)), 0)::DOUBLE id_sum
from (select {key}, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') t from {table_name})"""


@query("tokenize_pad", _tokens("documents", "doc_id"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize_pad("text").alias("t"))
    return rows.select(
        "doc_id",
        "t.n_tokens",
        F.size("t.ids").alias("width"),
        F.aggregate("t.mask", F.lit(0), lambda acc, m: acc + m).alias("mask_sum"),
        weighted(F.col("t.ids")).alias("id_sum"),
    )


@query(
    "embed_text",
    f"""select conv_id, turn, id % 32 bucket, sum(case when id//32 % 2 = 0 then 1.0::DOUBLE else -1 end) v
from (select conv_id, turn, {TOKEN_ID} id from (select conv_id, turn, unnest(list_slice(
  list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), 1, 128)) w from conversations))
group by all having v <> 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed_text(table(spark, sf_dir, "conversations"), "text", dim=32)
    long = rows.select("conv_id", "turn", F.posexplode(once("embeds")).alias("at", "v"))
    return long.filter("v <> 0").select(
        "conv_id", "turn", F.col("at").cast("bigint").alias("bucket"), F.col("v").cast("double").alias("v")
    )


def channel_peaks() -> Callable[[np.ndarray], np.ndarray]:
    """A model whose features are the peaks of the image's channels: exact in single precision."""
    return lambda images: images.max(axis=2)


@query(
    "embed_images",
    f"select vec_id, (i-1)//16 channel, round(max(x), 6)+0.0 v from ({E}) group by all",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed_images(table(spark, sf_dir, "embeddings"), "embedding", channel_peaks, (4, 16))
    long = rows.select("vec_id", F.posexplode("features").alias("at", "v"))
    value = r6(F.col("v").cast("double"))
    return long.select("vec_id", F.col("at").cast("bigint").alias("channel"), value.alias("v"))


def spread(row: dict) -> dict:
    vector = row["embedding"]
    return {"vec_id": row["vec_id"], "spread": float(max(vector)) - float(min(vector))}


@query("map_rows", f"select vec_id, round(max(x)-min(x), 6)+0.0 spread from ({E}) group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    mapped = map_rows(rows, spread, "vec_id bigint, spread double")
    return mapped.withColumn("spread", r6(F.col("spread")))


@query(
    "lr_schedule",
    """select o_orderkey step, round(1000*(case when s < 500 then 5e-4::DOUBLE*(0.1::DOUBLE+0.9::DOUBLE*s/500)
else 5e-5::DOUBLE+(5e-4::DOUBLE-5e-5::DOUBLE)*(1+cos(pi()*(s-500)/9500))/2 end), 9)+0.0 lr_milli
from (select o_orderkey, o_orderkey::DOUBLE s from orders)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lr_schedule(F.col("o_orderkey"), 10_000)
    milli = F.round(rate * 1000, 9) + F.lit(0.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), milli.alias("lr_milli"))
