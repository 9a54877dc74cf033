"""Seeded draws that depend on the row's key only, never on partitions or retries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.arrow import to_lists, vector_udf

# The multipliers of the SplitMix64 finaliser (Steele et al., 2014).
MIX_FIRST = 0xBF58476D1CE4E5B9
MIX_SECOND = 0x94D049BB133111EB
WORD = 4294967296.0

# Stands for a null in a key that ranks rows.
NULL_KEY = "\x00null"


def keyed(seed: int | Column, tag: str | int | Column, *key: Column) -> Column:
    """``md5(seed:tag:key)`` as a hex string; null for a null key."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in (seed, tag, *key)]
    texts = [F.lit(":") if i % 2 else parts[i // 2].cast("string") for i in range(2 * len(parts) - 1)]
    return F.md5(F.concat(*texts))


def hex_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def hash_word(seed: int | Column, tag: str | int | Column, *key: Column) -> Column:
    """A 32-bit number, uniform over keys."""
    return hex_number(keyed(seed, tag, *key), 1, 8)


def rank_word(seed: int | Column, tag: str | int | Column, *key: Column) -> Column:
    """The same for ranking: a null in the key counts as a value of its own, so every row has a number."""
    present = [F.coalesce(k.cast("string"), F.lit(NULL_KEY)) for k in key]
    return hash_word(seed, tag, *present)


def sample_time(key: Column, seed: int = 0, tag: str = "time") -> Column:
    """Uniform in [0, 1)."""
    return hash_word(seed, tag, key) / WORD


def counter(key: Column, seed: int, tag: str) -> tuple[Column, Column]:
    """Start and stride of the key's stream of random words."""
    digest = keyed(seed, tag, key)
    return hex_number(digest, 1, 15), hex_number(digest, 16, 15)


def normals(start: np.ndarray, stride: np.ndarray, dim: int) -> np.ndarray:
    """``dim`` standard normal numbers for each stream.

    A SplitMix64 counter with an odd stride makes the 64-bit words; Box-Muller
    turns each word into two normals.
    """
    pairs = (dim + 1) // 2
    at = np.arange(1, pairs + 1, dtype=np.uint64)
    step = stride.astype(np.uint64) * np.uint64(2) + np.uint64(1)
    x = start.astype(np.uint64)[:, None] + at[None, :] * step[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_SECOND)
    x ^= x >> np.uint64(31)
    radius = np.sqrt(-2.0 * np.log(((x >> np.uint64(32)) + 0.5) / WORD))
    angle = (2.0 * np.pi) * (((x & np.uint64(0xFFFFFFFF)) + 0.5) / WORD)
    both = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2)
    return both.reshape(len(start), 2 * pairs)[:, :dim]


def sample_noise(key: Column, dim: int, seed: int = 0, tag: str = "noise") -> Column:
    """``dim`` standard normal numbers for each key; one md5 a row, then numpy."""

    @vector_udf("array<double>")
    def draw(start: pa.Array, stride: pa.Array) -> pa.Array:
        present = np.asarray(start.is_valid())
        numbers = normals(np.asarray(start.drop_null()), np.asarray(stride.drop_null()), dim)
        return to_lists(numbers, present, pa.float64())

    return draw(*counter(key, seed, tag))
