"""Captions and images to latents, text vectors and shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import quantize_f16, scale_latents, scale_pixels
from vecloom.operators import (
    drop_blank,
    embed_images,
    embed_text,
    embed_tokens,
    global_index,
    prepare_images,
    resume_after,
    shuffle_samples,
    shuffle_shards,
    split_by_rank,
)
from vecloom.operators.feed import SAMPLES_PER_SHARD, batch
from vecloom.operators.images import IMAGE_SIZE
from vecloom.operators.vectors import map_fields
from vecloom.sources import decode_fields, encode_npy, tar_sink, tar_source, write_shards


def prepare(pairs: DataFrame, text: str, dim: int, keep: Sequence[str]) -> DataFrame:
    """Rows with a caption, with its vector in half precision and its mask."""
    embedded = embed_text(drop_blank(pairs, text), text, dim=dim)
    return embedded.select(*keep, quantize_f16("embeds").alias("embeds"), "mask")


def prepare_shards(
    pairs: DataFrame,
    text: str,
    order: Sequence[str],
    path: str,
    dim: int = 512,
    samples_per_shard: int = SAMPLES_PER_SHARD,
) -> None:
    """Index the captions in ``order``, embed them and write them as shards.

    Only the columns of ``order`` decide the ranges of the index; they should identify a
    caption. Vectors are made after the rows are numbered, and only these go to the shards.
    """
    indexed = global_index(drop_blank(pairs.select(*order, text), text), *order, ties=[])
    keep = [c for c in indexed.columns if c != text]
    write_shards(prepare(indexed, text, dim, keep), path, samples_per_shard=samples_per_shard)


def prepare_samples(
    pairs: DataFrame,
    image: str,
    text: str,
    order: Sequence[str],
    path: str,
    encode_images: Callable,
    encode_text: Callable,
    size: int = IMAGE_SIZE,
    samples_per_shard: int = SAMPLES_PER_SHARD,
    mode: str = "append",
) -> None:
    """Images and captions to training samples in tar shards: latents, token vectors and the mask.

    Rows without an image or with a blank caption are left out, the others indexed in
    ``order``. Images are resized, brought to [-1, 1) and go through ``encode_images``,
    which loads a model from images (n x 3 x size x size) to flat latents; these are
    scaled. ``encode_text`` loads one for ``embed_tokens``. Both kinds of vectors are
    kept in half precision, the latter with their shape.
    """
    whole = drop_blank(pairs.select(*order, image, text), text).filter(F.col(image).isNotNull())
    indexed = global_index(whole, *order, ties=[])
    resized = prepare_images(indexed, image, size, name="_pixels").withColumn("_pixels", scale_pixels("_pixels"))
    seen = embed_images(resized, "_pixels", encode_images, (3, size, size), name="_latents")
    read = embed_tokens(seen, text, encode_text, name="_embeds", mask="_mask")
    samples = read.select(
        "idx",
        encode_npy(quantize_f16(scale_latents("_latents"))).alias("latents"),
        encode_npy(quantize_f16("_embeds", depth=2), depth=2).alias("embeds"),
        encode_npy("_mask", "int32").alias("mask"),
    )
    fields = {"latents.npy": "latents", "embeds.npy": "embeds", "mask.npy": "mask"}
    tar_sink(samples, path, fields, samples_per_shard=samples_per_shard, mode=mode)


# What a sample's members decode to.
SAMPLE_FIELDS = {
    "latents": ("latents.npy", "array<float>"),
    "embeds": ("embeds.npy", "array<array<float>>"),
    "mask": ("mask.npy", "array<int>"),
}


def feed(
    spark: SparkSession,
    path: str,
    fields: dict[str, tuple[str, str]],
    names: dict[str, tuple[str, str]],
    batch_size: int,
    seed: int = 0,
    epoch: int = 0,
    rank: int = 0,
    world: int = 1,
    limit: int | None = None,
    step: int = 0,
) -> DataFrame:
    """The batches that one of ``world`` readers of tar shards gets in an epoch.

    The archives are put in a seeded order and every ``world``-th is this reader's; its
    samples are decoded by ``fields``, shuffled by seed and epoch, cut to ``limit``,
    renamed by ``names`` and grouped. ``step`` batches are passed over, as after a stop.
    """
    rows = tar_source(spark, path)
    order = shuffle_shards(rows.select("shard").distinct(), seed, "shard")
    own = split_by_rank(order, rank, world, "shard_pos").select(F.col("shard").alias("_own"))
    mine = rows.join(F.broadcast(own), rows["shard"].eqNullSafe(F.col("_own")), "left_semi")
    placed = shuffle_samples(mine.select("shard", "key"), ["shard", "key"], seed, epoch)
    if limit is not None:
        placed = placed.filter(F.col("pos") < limit)
    placed = resume_after(placed, step, batch_size, "pos").withColumnRenamed("shard", "_shard").withColumnRenamed("key", "_key")
    here = rows["shard"].eqNullSafe(placed["_shard"]) & (rows["key"] == placed["_key"])
    decoded = decode_fields(rows.join(placed, here).drop("_shard", "_key"), fields)
    renamed = map_fields(decoded, {"pos": ("pos", "bigint"), **names})
    return batch(renamed, batch_size, "pos")
