"""Queries of the sources and sinks."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import once, quantize_f16
from vecloom.operators import embed_tokens
from vecloom.operators.feed import sample_key
from vecloom.operators.rows import spread
from vecloom.plans.catalog import elements_sql, query, r6, table, weighted
from vecloom.plans.prepare import SAMPLE_FIELDS, feed, prepare_samples, prepare_shards
from vecloom.plans.shapes import RESIZED_SQL, gray_image
from vecloom.scratch import fresh_path
from vecloom.sources import (
    decode_fields,
    encode_npy,
    expand_shards,
    index_members,
    list_manifest,
    log_metrics,
    lookup_rows,
    read_members,
    read_pairs,
    scan_eval_shard,
    scan_shards,
    tar_sink,
    tar_source,
    write_shards,
)
from vecloom.sources.tars import _open_fs as open_fs

ROWS_PER_SHARD = 100
_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[SparkSession, str], str]) -> str:
    """The path of a table that several queries read; the first of them writes it."""
    slot = (spark.sparkContext.applicationId, sf_dir, kind)
    if slot not in _written:
        _written[slot] = write(spark, sf_dir)
    return _written[slot]


def _write_shards(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as a shard table."""
    path = fresh_path(spark, "shards")
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "idx")
    write_shards(rows, path, samples_per_shard=ROWS_PER_SHARD)
    return path


def _shards(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "shards", _write_shards)


def _write_tars(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as tar shards."""
    path = fresh_path(spark, "tars")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"),
        encode_npy("embedding", "float32").alias("latents"),
        F.encode(F.col("label").cast("string"), "UTF-8").alias("label"),
        F.encode(F.to_json(F.struct("label")), "UTF-8").alias("meta"),
    )
    fields = {"latents.npy": "latents", "label.cls": "label", "json": "meta"}
    tar_sink(rows, path, fields, samples_per_shard=ROWS_PER_SHARD)
    return path


def _tars(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "tars", _write_tars)


@query("read_pairs", "select doc_id, lang, source, n_chars, md5(text) digest from documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_pairs(spark, f"{sf_dir}/documents.parquet")
    return pairs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query(
    "lookup_rows",
    "select doc_id, md5(text) digest from documents where doc_id in (select doc_id from labels)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup_rows(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels").select("doc_id"))
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query(
    "expand_shards",
    """select p_partkey, 'p'||p_partkey||'-'||lpad(k::VARCHAR, 6, '0')||'.tar' AS name
from part, range(1, 1000) r(k) where k <= p_size""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.lpad(F.col("p_size").cast("string"), 5, "0")
    pattern = F.concat(F.lit("p"), F.col("p_partkey"), F.lit("-{000001.."), last, F.lit("}.tar"))
    # A part of few bytes stands for many names.
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", F.explode(expand_shards(pattern)).alias("name"))


@query(
    "write_shards",
    f"""select vec_id//{ROWS_PER_SHARD} shard, count(*)::BIGINT n, min(vec_id) first_idx, max(vec_id) last_idx,
1::BIGINT files from embeddings group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(_write_shards(spark, sf_dir)).withColumn("file", F.input_file_name())
    return rows.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.count_distinct("file").alias("files"),
    )


@query(
    "scan_shards",
    f"""select vec_id idx, label, vec_id//{ROWS_PER_SHARD} shard, round(sum(x), 6)+0.0 total
from ({elements_sql()}) where vec_id//{ROWS_PER_SHARD} >= 1 group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_shards(spark, _shards(spark, sf_dir), 1, 10**9)
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("idx", "label", F.col("shard").cast("bigint").alias("shard"), r6(total).alias("total"))


@query("scan_eval_shard", f"select vec_id idx, label from embeddings where vec_id//{ROWS_PER_SHARD} = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_eval_shard(spark, _shards(spark, sf_dir)).select("idx", "label")


@query(
    "tar_sink",
    f"select (vec_id//{ROWS_PER_SHARD})::INTEGER shard, count(*)::BIGINT n from embeddings group by 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tar_source(spark, _write_tars(spark, sf_dir)).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tar_source",
    f"""select (vec_id//{ROWS_PER_SHARD})::INTEGER shard, lpad(vec_id::VARCHAR, 8, '0') AS key,
3::INTEGER members, (128+4*len(embedding))::INTEGER bytes, '{{"label":'||label||'}}' AS json from embeddings""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tar_source(spark, _tars(spark, sf_dir)).select(
        "shard",
        "key",
        F.size("fields").alias("members"),
        F.octet_length(F.col("fields")["latents.npy"]).alias("bytes"),
        F.decode(F.col("fields")["json"], "UTF-8").alias("json"),
    )


@query(
    "decode_fields",
    f"""select lpad(vec_id::VARCHAR, 8, '0') AS key, label, i, round(x, 6)+0.0 x from ({elements_sql()})""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"latents": ("latents.npy", "array<float>"), "label": ("label.cls", "int")}
    rows = decode_fields(tar_source(spark, _tars(spark, sf_dir)), spec)
    return rows.select("key", "label", F.posexplode(once("latents")).alias("at", "v")).select(
        "key", "label", (F.col("at") + 1).cast("bigint").alias("i"), r6(F.col("v").cast("double")).alias("x")
    )


@query(
    "log_metrics",
    """select event_id step, 'train/loss' AS name, value from events where value is not null
union all select event_id, 'train/user_id', user_id::DOUBLE from events where user_id is not null""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "metrics")
    rows = table(spark, sf_dir, "events").withColumnRenamed("value", "loss")
    log_metrics(rows, path, "event_id", ["loss", "user_id"], "train/")
    return spark.read.parquet(path)


MANIFEST_SQL = """select case when o_custkey % 10 <> 0 then o_custkey end run, 'run-'||o_custkey||'/'||
case when o_orderstatus = 'P' then 'best_' else 'checkpoint_step_' end||o_orderkey||'.pt' AS path from orders"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of checkpoint files, one run per customer; some have other names, and some runs none."""
    stem = F.when(F.col("o_orderstatus") == "P", "best_").otherwise("checkpoint_step_")
    path = F.concat(F.lit("run-"), F.col("o_custkey"), F.lit("/"), stem, F.col("o_orderkey"), F.lit(".pt"))
    return table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("run"), path.alias("path"))


def _empty_files(files: pafs.FileSystem, base: str) -> Callable[[str], None]:
    """Makes an empty file at a path.

    A local file system has a limited number of files, whatever their size, but any number
    of names for one: there the empty files are names of one in ``base``, and of a new one
    where it takes no more.
    """
    seed, named = "", isinstance(files, pafs.LocalFileSystem)

    def make(path: str) -> None:
        nonlocal seed, named
        for fresh in (False, True) if seed else (True,):
            if not named:
                break
            if fresh:
                seed = f"{base}/empty-{uuid.uuid4().hex}"
                files.create_dir(base, recursive=True)
                files.open_output_stream(seed).close()
            try:
                return os.link(seed, path)
            except FileExistsError:
                return None
            except FileNotFoundError:
                raise
            except OSError:
                # Not even the first name beside its own: this file system gives none.
                named = not fresh
        files.open_output_stream(path).close()

    return make


def _write_empty(names: DataFrame, root: str) -> None:
    """An empty file for each path below ``root``, made by tasks; a folder's files by one, as tasks wait for each other in it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(root)
        make = _empty_files(files, base)
        for one in batches:
            for name in one.column(0).to_pylist():
                path = f"{base}/{name}"
                try:
                    make(path)
                except FileNotFoundError:
                    files.create_dir(posixpath.dirname(path), recursive=True)
                    make(path)
            yield one

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.select("path").filter("path is not null").repartition(tasks, F.regexp_extract("path", "^(.*)/", 1))
    dealt.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


@query(
    "list_manifest",
    f"""select run, path, regexp_extract(path, 'checkpoint_step_(\\d+)\\.pt', 1)::BIGINT step
from ({MANIFEST_SQL}) where path like '%/checkpoint_step_%'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "runs")
    names = manifest(spark, sf_dir)
    _write_empty(names, root)
    place = F.concat(F.lit(f"{root}/"), F.regexp_extract("path", "^(.*)/", 1))
    folders = names.select("run", place.alias("folder")).distinct()
    found = list_manifest(spark, folders)
    return found.select("run", F.regexp_extract("path", r"(run-[^/]*/[^/]*)$", 1).alias("path"), "step")


TOKENS = 4


def _write_tensors(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as 4 x 16 tensors of half precision in tar shards."""
    path = fresh_path(spark, "tensors")
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("embedding", r * 16 + 1, 16))
    rows = table(spark, sf_dir, "embeddings").withColumn("tensor", quantize_f16(nested, depth=2))
    rows = rows.select(F.col("vec_id").alias("idx"), encode_npy("tensor", depth=2).alias("tensor"))
    tar_sink(rows, path, {"tensor.npy": "tensor"}, samples_per_shard=ROWS_PER_SHARD)
    return path


@query(
    "tensor_fields",
    f"""select lpad(vec_id::VARCHAR, 8, '0') AS key, ((i-1)//16)::BIGINT AS line, ((i-1)%16)::BIGINT AS place,
round(case when x = 0 then 0 else round_even(x/u, 0)*u end, 9)+0.0 x
from (select vec_id, i, x, power(2.0::DOUBLE, greatest(floor(log2(nullif(abs(x), 0))), -14)-10) u from ({elements_sql()}))""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _once(spark, sf_dir, "tensors", _write_tensors)
    rows = decode_fields(tar_source(spark, path), {"tensor": ("tensor.npy", "array<array<float>>")})
    lines = rows.select("key", F.posexplode(once("tensor")).alias("line", "v"))
    elements = lines.select("key", F.col("line").cast("bigint").alias("line"), F.posexplode("v").alias("place", "x"))
    value = F.round(F.col("x").cast("double"), 9) + F.lit(0.0)
    return elements.select("key", "line", F.col("place").cast("bigint").alias("place"), value.alias("x"))


@query(
    "tar_members",
    f"""select (vec_id//{ROWS_PER_SHARD})::INTEGER shard, lpad(vec_id::VARCHAR, 8, '0') AS key, label
from embeddings where vec_id in (select doc_id from labels)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = index_members(spark, _tars(spark, sf_dir)).filter("extension = 'label.cls'")
    wanted = table(spark, sf_dir, "labels").select(sample_key(F.col("doc_id")).alias("key"))
    found = read_members(lookup_rows(members, "key", wanted))
    return decode_fields(found, {"label": ("label.cls", "int")}).select("shard", "key", "label")


def _pooling() -> Callable[[np.ndarray], np.ndarray]:
    """An image model that needs no weights: the mean of the three planes."""
    return lambda images: images.reshape(len(images), 3, -1).mean(axis=1)


def _spelling() -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A text model that needs no weights: length and number of ``e`` of the first words."""

    def predict(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        vectors, mask = np.zeros((len(texts), TOKENS, 2)), np.zeros((len(texts), TOKENS), int)
        for i, text in enumerate(texts):
            for j, word in enumerate(re.findall(r"[^ ]+", text)[:TOKENS]):
                vectors[i, j], mask[i, j] = (len(word), word.count("e")), 1
        return vectors, mask

    return predict


SPELLED_SQL = f"""select doc_id, j-1 AS place, coalesce(len(w[j]), 0) n, coalesce(len(w[j])-len(replace(w[j], 'e', '')), 0) e, w[j] is not null there
from (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') w from documents), range(1, {TOKENS + 1}) r(j)"""


@query(
    "embed_tokens",
    f"""select doc_id, place::BIGINT place, n::DOUBLE n, e::DOUBLE e, there::INTEGER mask from ({SPELLED_SQL})""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _spelling)
    tokens = rows.select("doc_id", F.posexplode(F.arrays_zip("embeds", "mask")).alias("place", "t"))
    numbers = [F.col("t.embeds")[k].cast("double").alias(c) for k, c in enumerate(("n", "e"))]
    return tokens.select("doc_id", F.col("place").cast("bigint").alias("place"), *numbers, F.col("t.mask").alias("mask"))


def _write_samples(spark: SparkSession, sf_dir: str) -> str:
    """Embeddings as gray images with documents as their captions, prepared."""
    path = fresh_path(spark, "samples")
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), gray_image("embedding").alias("image"))
    pairs = images.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    prepare_samples(pairs, "image", "text", ["doc_id"], path, _pooling, _spelling, size=4, samples_per_shard=ROWS_PER_SHARD)
    return path


def _samples(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "samples", _write_samples)


F16_SQL = "(case when {x} = 0 then 0 else round_even({x}/power(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14)-10), 0)*power(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14)-10) end)"

# Samples with their index, latents and vectors; the pictures are those of ``prepare_images``.
SAMPLES_SQL = f"""
{RESIZED_SQL},
k as (select vec_id, row_number() over (order by vec_id) - 1 idx from embeddings join documents on doc_id = vec_id where regexp_matches(text, '\\S')),
l as (select vec_id, y*4+x AS cell, (v/256*2-1)::FLOAT::DOUBLE*0.18215::DOUBLE x from q),
t as ({SPELLED_SQL}),
a as (select idx, sum((cell+1)*{F16_SQL.format(x='l.x')}) latents from k join l using (vec_id) group by idx),
b as (select idx, sum((place+1)*(n+2*e)) embeds, sum(there::BIGINT) AS mask from k join t on doc_id = vec_id group by idx)
"""


@query(
    "prepare_samples",
    f"""with {SAMPLES_SQL} select lpad(idx::VARCHAR, 8, '0') AS key, (idx//{ROWS_PER_SHARD})::INTEGER shard, round(latents, 6)+0.0 latents,
round(embeds::DOUBLE, 6)+0.0 embeds, mask::BIGINT mask from a join b using (idx)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_fields(tar_source(spark, _samples(spark, sf_dir)), SAMPLE_FIELDS)
    embeds = F.transform("embeds", lambda v: v[0].cast("double") + 2 * v[1])
    return rows.select(
        "key",
        "shard",
        r6(weighted(F.col("latents"))).alias("latents"),
        r6(weighted(embeds)).alias("embeds"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("mask"),
    )


# One reader of three gets every third archive of the seeded order, and passes over one batch of 16.
@query(
    "feed",
    f"""with s as (select distinct vec_id//{ROWS_PER_SHARD} shard from embeddings),
o as (select shard, row_number() over (order by ('0x'||substr(md5('5:shard:'||shard),1,8))::BIGINT, shard) - 1 AS place from s),
m as (select vec_id, label, row_number() over (order by ('0x'||substr(md5('5:2:'||shard||':'||lpad(vec_id::VARCHAR, 8, '0')),1,8))::BIGINT, shard, vec_id) - 1 pos
  from embeddings join o on shard = vec_id//{ROWS_PER_SHARD} where place % 3 = 1)
select pos//16 batch_id, count(*)::INTEGER n, string_agg(pos||':'||label, ',' order by pos) samples from m
where pos < 150 and pos >= 16 group by 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"cond": ("label.cls", "int"), "v": ("latents.npy", "array<float>")}
    names = {"label": ("cond", "int"), "x": ("v", "array<float>")}
    found = feed(spark, _tars(spark, sf_dir), spec, names, 16, seed=5, epoch=2, rank=1, world=3, limit=150, step=1)
    line = F.transform("samples", lambda s: F.concat(s["pos"].cast("string"), F.lit(":"), s["label"].cast("string")))
    return found.select("batch_id", "n", F.array_join(line, ",").alias("samples"))


@query(
    "prepare_shards",
    """with w as (select doc_id, unnest(list_slice(t, 1, 128)) w from (
  select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') t from documents)),
h as (select doc_id, ('0x'||substr(md5(w),1,8))::BIGINT % 32000 + 1 id from w),
b as (select doc_id, id % 64 bucket, sum(case when id//64 % 2 = 0 then 1 else -1 end) c from h group by all),
k as (select doc_id, row_number() over (order by doc_id) - 1 idx from documents where regexp_matches(text, '\\S')),
n as (select doc_id, least(len(t), 128)::BIGINT n from (
  select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') t from documents))
select k.doc_id, idx::BIGINT idx, lpad(idx::VARCHAR, 8, '0') AS key, (idx//250)::BIGINT shard, any_value(n.n) mask_sum,
  coalesce(sum((bucket+1)*c), 0)::DOUBLE embed_sum
from k join n on k.doc_id = n.doc_id left join b on k.doc_id = b.doc_id group by all""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "prepared")
    prepare_shards(table(spark, sf_dir, "documents"), "text", ["doc_id"], path, 64, 250)
    rows = spark.read.parquet(path)
    at = F.transform("embeds", lambda x, i: (i + 1) * x.cast("double"))
    return rows.select(
        "doc_id",
        "idx",
        "key",
        F.col("shard").cast("bigint").alias("shard"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("mask_sum"),
        F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x).alias("embed_sum"),
    )
