"""Queries of statistics, manifests and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import velocity_mse
from vecloom.operators import (
    evaluate,
    fit_velocity,
    frechet_diagonal,
    frechet_distance,
    latest_checkpoint,
    map_fields,
    mean_vector,
    newest_first,
    parse_manifest,
    retention,
    retention_deletes,
    tensor_stats,
    vector_moments,
)
from vecloom.plans.catalog import noise_sql, query, r6, table, weighted
from vecloom.plans.reads import MANIFEST_SQL, manifest
from vecloom.plans.score import draw
from vecloom.plans.vectors import DIM, D, E, drawn, towards
from vecloom.scratch import fresh_path
from vecloom.streaming import scan_indexed, stream_indexed, stream_prepare, stream_shards


@query(
    "tensor_stats",
    f"""with {D}, s as (select label, 'latents' tensor, x v from d union all select label, 'noise', noise from d
union all select label, 'z_t', (1-t)*noise+t*x from d union all select label, 'target', x-noise from d
union all select label, 'time', t from d where i = 1)
select label, tensor, round(min(v), 6)+0.0 "min", round(avg(v), 6)+0.0 mean, round(max(v), 6)+0.0 "max",
round(stddev_samp(v), 6)+0.0 std from s group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drawn(spark, sf_dir).withColumnRenamed("embedding", "latents").withColumn("time", F.array("time"))
    stats = tensor_stats(rows, ["latents", "noise", "time", "z_t", "target"], ["label"])
    numbers = [r6(F.col(c)).alias(c) for c in ("min", "mean", "max", "std")]
    return stats.select("label", "tensor", *numbers)


@query("mean_gradient", f"select label, i, round(avg(x), 6)+0.0 mean from ({E}) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = mean_vector(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    long = means.select("label", F.posexplode("mean_vector").alias("at", "m"))
    return long.select("label", (F.col("at") + 1).cast("bigint").alias("i"), r6(F.col("m")).alias("mean"))


@query(
    "vector_moments",
    f"""with e as ({E}), m as (select i, avg(x) mu from e group by 1)
select a.i, b.i j, count(*)::BIGINT n, round(any_value(m.mu), 6)+0.0 mean,
round(covar_samp(a.x, b.x), 9)+0.0 cov
from e a join e b on a.vec_id = b.vec_id join m on m.i = a.i group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = vector_moments(table(spark, sf_dir, "embeddings"), "embedding")
    rows = moments.select("n", "mean", F.posexplode("cov").alias("at", "row"))
    rows = rows.select("n", F.col("mean")[F.col("at")].alias("mean"), "at", F.posexplode("row").alias("to", "cov"))
    return rows.select(
        (F.col("at") + 1).cast("bigint").alias("i"),
        (F.col("to") + 1).cast("bigint").alias("j"),
        "n",
        r6(F.col("mean")).alias("mean"),
        (F.round("cov", 9) + F.lit(0.0)).alias("cov"),
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter("label < 5"), rows.filter("label >= 5")


def product_sql(a: str, b: str) -> str:
    return f"select {a}.i, {b}.j, sum({a}.v*{b}.v) v from {a} join {b} on {a}.j = {b}.i group by all"


def root_sql(matrix: str, rounds: int = 30) -> str:
    """CTEs of the coupled Newton iteration: ``y{rounds}`` is the root of ``matrix`` over its scale."""
    steps = [
        f"""s as materialized (select sqrt(sum(v*v)) s from {matrix}),
y0 as materialized (select i, j, v/s v from {matrix}, s),
z0 as materialized (select i, j, case when i = j then 1.0::DOUBLE else 0 end v from {matrix})"""
    ]
    for k in range(rounds):
        steps.append(
            f"""zy{k} as materialized ({product_sql(f'z{k}', f'y{k}')}),
t{k} as materialized (select i, j, (case when i = j then 3.0::DOUBLE else 0 end - v)/2 v from zy{k}),
y{k + 1} as materialized ({product_sql(f'y{k}', f't{k}')}),
z{k + 1} as materialized ({product_sql(f't{k}', f'z{k}')})"""
        )
    return ",\n".join(steps)


@query(
    "frechet_distance",
    f"""with e as materialized ({E}),
mu as (select i, label < 5 side, avg(x) m from e group by all),
c as materialized (select a.label < 5 side, a.i, b.i j, covar_samp(a.x, b.x) v
  from e a join e b on a.vec_id = b.vec_id group by all),
c1 as materialized (select i, j, v from c where side), c2 as materialized (select i, j, v from c where not side),
p as materialized ({product_sql('c1', 'c2')}),
{root_sql('p')}
select round((select sum((a.m-b.m)*(a.m-b.m)) from mu a join mu b on a.i = b.i and a.side and not b.side)
 + (select sum(v) from c where i = j) - 2*sqrt(s)*(select sum(v) from y30 where i = j), 6)+0.0 frechet_distance
from s""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = frechet_distance(*_halves(spark, sf_dir), "embedding")
    return distance.select(r6(F.col("frechet_distance")).alias("frechet_distance"))


@query(
    "frechet_diagonal",
    f"""with m as (select i, label < 5 side, avg(x) mu, var_samp(x) va from ({E}) group by all)
select round(sum((a.mu-b.mu)*(a.mu-b.mu)+(sqrt(a.va)-sqrt(b.va))*(sqrt(a.va)-sqrt(b.va))), 6)+0.0 frechet_diagonal
from m a join m b on a.i = b.i and a.side and not b.side""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = frechet_diagonal(*_halves(spark, sf_dir), "embedding")
    return distance.select(r6(F.col("frechet_diagonal")).alias("frechet_diagonal"))


# Gauss-Jordan elimination of the normal equations: 66 features (constant, state,
# time) against 64 outputs, one pivot per round. The matrix needs no row swaps.
FIT_SQL = f"""with recursive {D},
f as materialized (select vec_id, i, (1-t)*noise+t*x v from d union all select vec_id, 0, 1 from d where i = 1
  union all select vec_id, 65, t from d where i = 1),
y as materialized (select vec_id, 65+i i, x-noise v from d),
g as materialized (select a.i, b.i j, sum(a.v*b.v) + case when a.i = b.i and a.i > 0 then 1.0::DOUBLE else 0 end v
  from f a join (select * from f union all select * from y) b on a.vec_id = b.vec_id group by a.i, b.i),
w as (select 0 k, i, j, v from g
  union all select m.k+1, m.i, m.j,
    case when m.i = m.k then m.v/corner.v else m.v-left_of.v*above.v/corner.v end
  from w m join w corner on corner.i = m.k and corner.j = m.k
    join w left_of on left_of.i = m.i and left_of.j = m.k
    join w above on above.i = m.k and above.j = m.j
  where m.k < 66)
select i::INTEGER feature, (j-66)::INTEGER AS output, round(v, 6)+0.0 weight from w where k = 66 and j >= 66"""


@query("fit_velocity", FIT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drawn(spark, sf_dir).withColumn("time", F.array("time"))
    weights = fit_velocity(rows, ["z_t", "time"], "target", ridge=1.0)
    return weights.select("feature", "output", r6(F.col("weight")).alias("weight"))


@query(
    "evaluate",
    f"""with recursive {D}, g as ({noise_sql('embeddings', 'vec_id', DIM, tag='generate')}),
l as (select vec_id, avg(((x-((1-t)*noise+t*x))*(1+t)-(x-noise))*((x-((1-t)*noise+t*x))*(1+t)-(x-noise))) loss
  from d group by 1),
walk as (select d.vec_id, d.i, x, z, 0 step from d join g on d.vec_id = g.vec_id and d.i = g.i
  union all select vec_id, i, x, z+(x-z)*(1+step/10.0::DOUBLE)/10, step+1 from walk where step < 10)
select (select round(avg(m), 6)+0.0 from (select avg(loss) m from l group by vec_id//128)) mean_loss,
(select round(avg(z), 6)+0.0 from walk where step = 10) generated_mean""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("idx", F.col("vec_id"))
    loss, samples = evaluate(rows, "vec_id", "embedding", DIM, towards, n=10, context=["embedding"])
    mean = samples.select(F.explode("generated").alias("z")).agg(r6(F.avg("z")))
    return loss.select(r6(F.col("mean_loss")).alias("mean_loss"), mean.scalar().alias("generated_mean"))


STEPS_SQL = f"""select run, path, regexp_extract(path, 'checkpoint_step_(\\d+)\\.pt', 1)::BIGINT step
from ({MANIFEST_SQL}) where path like '%/checkpoint_step_%'"""
KEPT_SQL = "row_number() over (partition by run order by step desc, path desc) <= 5 or step % 2500 = 0"


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_manifest(manifest(spark, sf_dir))


@query(
    "latest_checkpoint",
    f"select run, arg_max(path, step) path, max(step) step from ({STEPS_SQL}) group by run",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_checkpoint(checkpoints(spark, sf_dir), ["run"])


@query("retention", f"select run, path, step, {KEPT_SQL} keep from ({STEPS_SQL})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(checkpoints(spark, sf_dir), by=["run"])


@query(
    "retention_deletes",
    f"select run, path, step from (select *, {KEPT_SQL} keep from ({STEPS_SQL})) where not keep",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_deletes(checkpoints(spark, sf_dir), by=["run"])


@query("newest_first", f"{STEPS_SQL} order by step desc, path desc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_first(checkpoints(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a file stream; all its files come at once, so an index orders them all."""
    schema = table(spark, sf_dir, name).schema
    # Spark streams a lone file only by a path with a wildcard.
    return stream_shards(spark, f"{sf_dir}/{name}.parque[t]", schema)


def _through(spark: SparkSession, stream: DataFrame, transform) -> DataFrame:
    sink, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    stream_prepare(stream, transform, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


@query("stream_shards", f"select vec_id, label, round(sum(i*x), 6)+0.0 total from ({E}) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _through(spark, _stream(spark, sf_dir, "embeddings"), lambda df: df)
    return rows.select("vec_id", "label", r6(weighted(F.col("embedding"))).alias("total"))


@query(
    "stream_prepare",
    f"""with {D} select vec_id, label cond, round(avg(((1-t)*noise+t*x-x+noise)*((1-t)*noise+t*x-x+noise)), 6)+0.0 loss
from d group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"vec_id": ("vec_id", "bigint"), "latents": ("embedding", "array<double>"), "cond": ("label", "int")}

    def transform(df: DataFrame) -> DataFrame:
        rows = draw(map_fields(df, fields), "vec_id", "latents", DIM)
        return rows.select("vec_id", "cond", velocity_mse("z_t", "target").alias("loss"))

    rows = _through(spark, _stream(spark, sf_dir, "embeddings"), transform)
    return rows.withColumn("loss", r6(F.col("loss")))


@query(
    "stream_indexed",
    """select doc_id, idx, lpad(idx::VARCHAR, 8, '0') AS key, idx//200 shard from (
  select doc_id, row_number() over (order by lang, doc_id) - 1 idx from documents where n_chars > 100)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, checkpoint = fresh_path(spark, "indexed"), fresh_path(spark, "indexed-checkpoint")
    stream = _stream(spark, sf_dir, "documents")

    def transform(df: DataFrame) -> DataFrame:
        return df.filter("n_chars > 100").select("lang", "doc_id")

    stream_indexed(stream, transform, ["lang", "doc_id"], sink, checkpoint, 200).awaitTermination()
    return scan_indexed(spark, sink).select("doc_id", "idx", "key", F.col("shard").cast("bigint").alias("shard"))
