"""Queries of projections, filters, limits and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import (
    clamp,
    concat_mask,
    layout,
    once,
    quantize_f16,
    scale_latents,
    scale_pixels,
    squeeze,
    tokenize_pad,
)
from vecloom.functions.arrays import doubles, total
from vecloom.operators import (
    cadence,
    drop_blank,
    extract_json,
    map_fields,
    prepare_images,
    require_one_of,
    resume_after,
    split_by_rank,
    split_train_eval,
    take_first,
    take_images,
    zip_columns,
)
from vecloom.plans.catalog import elements_sql, query, r6, table, weighted

E = elements_sql()


@query("map_fields", f"select vec_id, round(sum(i*x), 6)+0.0 latents, label cond from ({E}) group by vec_id, label")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {
        "vec_id": ("vec_id", "bigint"),
        "latents": ("embedding", "array<double>"),
        "cond": ("label", "int"),
    }
    rows = map_fields(table(spark, sf_dir, "embeddings"), fields)
    return rows.withColumn("latents", r6(weighted(F.col("latents"))))


@query(
    "squeeze",
    f"""select vec_id, round(sum(i*x), 6)+0.0 row_vector, round(sum(i*x), 6)+0.0 column_vector
from ({E}) group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        r6(weighted(squeeze(F.array("embedding")))).alias("row_vector"),
        r6(weighted(squeeze(F.transform("embedding", lambda x: F.array(x))))).alias("column_vector"),
    )


@query(
    "quantize_f16",
    f"""select vec_id, i, round(case when x = 0 then 0 else round_even(x/u, 0)*u end, 9)+0.0 x
from (select vec_id, i, x, power(2.0::DOUBLE, greatest(floor(log2(nullif(abs(x), 0))), -14)-10) u from ({E}))""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(once(quantize_f16("embedding"))).alias("at", "h")
    )
    value = F.round(F.col("h").cast("double"), 9) + F.lit(0.0)
    return rows.select("vec_id", (F.col("at") + 1).cast("bigint").alias("i"), value.alias("x"))


@query("extract_prompt", "select event_id, props->>'$.k' k from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_json(table(spark, sf_dir, "events"), "props", "$.k", "k").select("event_id", "k")


@query(
    "scale_pixels",
    """select l_orderkey, l_linenumber, round(l_quantity/256*2-1, 6)+0.0 a,
round((l_extendedprice::DOUBLE % 256)/256*2-1, 6)+0.0 b from lineitem""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.array("l_quantity", F.col("l_extendedprice") % 256)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scale_pixels(pixels).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("p")[0]).alias("a"), r6(F.col("p")[1]).alias("b"))


# One embedding is a gray image of 8 x 8; shrinking it to 4 x 4 widens the kernel to 6 pixels.
RESIZED_SQL = f"""w as (select o, s, wt/sum(wt) over (partition by o) wt from (
  select o, s, case when s+0.5 = c then 1.0::DOUBLE
    when abs(s+0.5-c)/2 >= 3 then 0
    else sin(pi()*(s+0.5-c)/2)/(pi()*(s+0.5-c)/2) * sin(pi()*(s+0.5-c)/6)/(pi()*(s+0.5-c)/6) end wt
  from (select o, s, ((o+0.5)*2)::DOUBLE c from range(4) a(o), range(8) b(s))
  where s >= greatest(floor(c-6+0.5), 0) and s < least(floor(c+6+0.5), 8))),
p as (select vec_id, (i-1)//8 y, (i-1)%8 x, floor((x+1)*127)::DOUBLE v from ({E})),
h as (select vec_id, y, o x, floor(least(greatest(sum(v*wt), 0), 255)+0.5) v from p join w on w.s = p.x group by all),
q as (select vec_id, o y, x, floor(least(greatest(sum(v*wt), 0), 255)+0.5) v from h join w on w.s = h.y group by all)"""


def gray_image(embedding: str) -> Column:
    """An embedding as an image of 8 x 8, as Spark's image source delivers it."""
    byte = F.transform(doubles(embedding), lambda x: F.lpad(F.hex(F.floor((x + 1) * 127)), 2, "0"))
    return F.struct(
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(byte, "")).alias("data"),
    )


@query(
    "prepare_images",
    f"with {RESIZED_SQL} select vec_id, (plane*16+y*4+x)::BIGINT AS pixel, v from q, range(3) c(plane)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray_image("embedding").alias("image"))
    planes = prepare_images(rows, size=4)
    pixels = planes.select("vec_id", F.posexplode(once("pixels")).alias("at", "v"))
    return pixels.select("vec_id", F.col("at").cast("bigint").alias("pixel"), F.col("v").cast("double").alias("v"))


@query(
    "scale_latents",
    f"""select vec_id, round(sum(x*0.18215::DOUBLE), 6)+0.0 scaled, round(sum(x/0.18215::DOUBLE), 6)+0.0 unscaled
from ({E}) group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        r6(total(scale_latents("embedding"))).alias("scaled"),
        r6(total(scale_latents("embedding", inverse=True))).alias("unscaled"),
    )


@query(
    "clamp",
    f"""select vec_id, round(sum(greatest(0, least(1, x))), 6)+0.0 unit,
round(sum(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x))), 6)+0.0 narrow from ({E}) group by vec_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        r6(total(clamp("embedding"))).alias("unit"),
        r6(total(clamp("embedding", -0.1, 0.1))).alias("narrow"),
    )


@query(
    "layout",
    f"""select vec_id, (i-1)%16 token, round(sum(((i-1)//16+1)*x), 6)+0.0 token_sum,
round(sum((((i-1)%16)*4+(i-1)//16+1)*x), 6)+0.0 last_sum, round(sum(i*x), 6)+0.0 first_sum
from ({E}) group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("last", layout("embedding", 4, 16, "channels_last"))
    rows = rows.select(
        "vec_id",
        F.posexplode(layout("embedding", 4, 16, "tokens")).alias("at", "token_vector"),
        "last",
        layout("last", 4, 16, "channels_first").alias("first"),
    )
    at = F.col("at")

    def own(flat: str, position) -> F.Column:
        """Position times element over the four elements of this token."""
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda c: (position(c) + 1) * F.element_at(F.col(flat), (position(c) + 1).cast("int")).cast("double"),
        )
        return r6(total(parts))

    return rows.select(
        "vec_id",
        at.cast("bigint").alias("token"),
        r6(weighted(F.col("token_vector"))).alias("token_sum"),
        own("last", lambda c: at * 4 + c).alias("last_sum"),
        own("first", lambda c: c * 16 + at).alias("first_sum"),
    )


@query(
    "zip_columns",
    """select vec_id, round(embedding[i]::DOUBLE, 6)+0.0 a, round(embedding[i+24]::DOUBLE, 6)+0.0 b
from embeddings, range(1, 41) r(i)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", doubles("embedding").alias("a"), F.slice(doubles("embedding"), 25, 40).alias("b")
    )
    zipped = zip_columns(rows, ["a", "b"], ["vec_id"])
    return zipped.select("vec_id", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query(
    "concat_mask",
    """select doc_id, 192::INTEGER length, (64+least(len(t), 128))::INTEGER ones,
(64+least(len(t), 128))::INTEGER last_one from (
select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') t from documents)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = tokenize_pad("text")["mask"]
    rows = table(spark, sf_dir, "documents").select("doc_id", concat_mask(mask).alias("mask"))
    last = F.array_max(F.transform("mask", lambda m, i: F.when(m == 1, i + 1)))
    return rows.select(
        "doc_id",
        F.size("mask").alias("length"),
        F.aggregate("mask", F.lit(0), lambda acc, m: acc + m).alias("ones"),
        last.alias("last_one"),
    )


@query(
    "drop_blank",
    """select doc_id, lang, md5(body) digest from (
  select doc_id, lang, case lang when 'de' then ' '||chr(10)||chr(9) when 'es' then '' when 'fr' then null
    else text end body from documents)
where regexp_replace(body, '\\s', '', 'g') <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (
        F.when(F.col("lang") == "de", " \n\t")
        .when(F.col("lang") == "es", "")
        .when(F.col("lang") == "fr", F.lit(None))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").withColumn("body", body)
    return drop_blank(rows, "body").select("doc_id", "lang", F.md5("body").alias("digest"))


@query("take_first", "select doc_id, n_chars from documents order by doc_id limit 100")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_first(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 100, "doc_id")


@query("take_images", "select conv_id, turn, role from conversations order by conv_id, turn limit 32")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_images(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 32, "conv_id", "turn")


@query("resume_after", "select doc_id, n_chars from documents where doc_id >= 3*32")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return resume_after(rows, 3, 32, "doc_id")


@query(
    "split_train_eval",
    """select case when doc_id//50 = 0 then 'eval' else 'train' end split, count(*)::BIGINT n,
sum(n_chars)::BIGINT n_chars from documents group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("shard", F.floor(F.col("doc_id") / 50))
    return split_train_eval(rows).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )


@query(
    "split_by_rank",
    """select ((doc_id//50) % 3)::INTEGER rank, count(*)::BIGINT n, sum(n_chars)::BIGINT n_chars
from documents group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("shard", F.floor(F.col("doc_id") / 50))
    ranks = [split_by_rank(rows, r, 3).withColumn("rank", F.lit(r)) for r in range(3)]
    return reduce(DataFrame.unionAll, ranks).groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )


@query(
    "cadence",
    """select o_orderkey step, s % 100 = 0 and s > 0 evaluates, s % 100 = 0 and s > 0 and s % 500 = 0 saves,
(s+1) % 7 = 0 or s = 9999 emits from (select o_orderkey, o_orderkey s from orders)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    return cadence(steps, emit_every=7, last=10_000)


@query(
    "require_one_of",
    """select doc_id, case when body is not null and quality is null and toxic is null then 'single'
when body is null and quality is not null and toxic is not null then 'group' else 'invalid' end input_kind
from (select doc_id, case when lang <> 'en' then text end body from documents) left join labels using (doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("lang") != "en", F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    joined = rows.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return require_one_of(joined, "body", ["quality", "toxic"]).select("doc_id", "input_kind")
