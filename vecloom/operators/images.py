"""Resizing images, as Spark's image source delivers them, to planes of pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrays import doubles
from vecloom.functions.arrow import to_lists, to_matrix, vector_udf

# Training size and the reach of the Lanczos kernel.
IMAGE_SIZE = 64
LANCZOS_REACH = 3.0

# Numbers of pixels held at once.
MAX_PIXELS = 1 << 24


def resize_weights(size: int, target: int, method: str) -> np.ndarray:
    """Matrix of ``target`` x ``size`` that resamples one axis."""
    ratio = size / target
    centers = (np.arange(target) + 0.5) * ratio
    if method == "lanczos":
        # Shrinking widens the kernel, so that every source pixel counts.
        stretch = max(ratio, 1.0)
        reach = LANCZOS_REACH * stretch
        first = np.maximum(np.floor(centers - reach + 0.5), 0)
        end = np.minimum(np.floor(centers + reach + 0.5), size)
        pixels = np.arange(size)[None, :]
        offset = (pixels + 0.5 - centers[:, None]) / stretch
        weights = np.sinc(offset) * np.sinc(offset / LANCZOS_REACH) * (np.abs(offset) < LANCZOS_REACH)
        weights = weights * ((pixels >= first[:, None]) & (pixels < end[:, None]))
        return weights / weights.sum(axis=1, keepdims=True)
    if method == "bilinear":
        # Half-pixel centers, no smoothing when shrinking.
        place = np.clip(centers - 0.5, 0.0, None)
        left = np.minimum(place.astype(int), size - 1)
        right = np.minimum(left + 1, size - 1)
        weights = np.zeros((target, size))
        np.add.at(weights, (np.arange(target), left), 1.0 - (place - left))
        np.add.at(weights, (np.arange(target), right), place - left)
        return weights
    raise ValueError(f"unknown method {method!r}")


def _to_byte(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values, 0.0, 255.0) + 0.5)


def _resizer(target: int, method: str) -> Callable[[np.ndarray], np.ndarray]:
    """Rows first, then columns; Lanczos keeps whole bytes after each pass."""
    after = _to_byte if method == "lanczos" else np.asarray
    weights = lru_cache(lambda size: resize_weights(size, target, method))

    def resize(planes: np.ndarray) -> np.ndarray:
        wide = after(planes @ weights(planes.shape[2]).T)
        return after(weights(planes.shape[1]) @ wide)

    return resize


def _rgb_planes(data: list[bytes], height: int, width: int, channels: int) -> np.ndarray:
    """Channel-first red, green, blue of equally large images. The image source stores blue, green, red (, alpha)."""
    pixels = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), height, width, channels)
    if channels == 1:
        pixels = np.repeat(pixels, 3, axis=3)
    return pixels[..., 2::-1].transpose(0, 3, 1, 2).astype(np.float64)


def prepare_images(
    df: DataFrame, image: str = "image", size: int = IMAGE_SIZE, method: str = "lanczos", name: str = "pixels"
) -> DataFrame:
    """Add the image as RGB of ``size`` x ``size``: a flat, channel-first array of floats.

    Images of one size are resized together, at most ``MAX_PIXELS`` numbers of them or of
    their results at a time, so a batch of small images that grow does not fill a task.
    """

    @F.arrow_udf("array<float>")
    def resize(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fit = _resizer(size, method)
        rows = max(1, MAX_PIXELS // (3 * size * size))
        for batch in batches:
            for first in range(0, len(batch[0]), rows):
                yield resize_some(fit, *(a.slice(first, rows).to_pylist() for a in batch))

    def resize_some(fit: Callable, heights: list, widths: list, channels: list, data: list) -> pa.Array:
        groups: dict[tuple, list[int]] = {}
        for i, shape in enumerate(zip(heights, widths, channels)):
            if data[i] is not None:
                groups.setdefault(shape, []).append(i)
        out = np.zeros((len(data), 3 * size * size), np.float32)
        for (h, w, c), own in groups.items():
            together = max(1, MAX_PIXELS // (3 * max(h, size) * max(w, size)))
            for at in (own[i : i + together] for i in range(0, len(own), together)):
                planes = _rgb_planes([data[i] for i in at], h, w, c).reshape(-1, h, w)
                out[at] = fit(planes).reshape(len(at), -1)
        present = np.array([d is not None for d in data])
        return to_lists(out[present], present, pa.float32())

    fields = [F.col(f"{image}.{f}") for f in ("height", "width", "nChannels", "data")]
    return df.withColumn(name, resize(*fields))


def resize_planes(col: Column, channels: int, size: int, target: int, method: str = "bilinear") -> Column:
    """Resize flat, channel-first square images that already are arrays, a whole batch at a time."""
    @vector_udf("array<double>")
    def resize(images: pa.Array) -> pa.Array:
        matrix, present = to_matrix(images, channels * size * size)
        if not len(matrix):
            return pa.nulls(len(present), pa.list_(pa.float64()))
        planes = matrix.reshape(len(matrix) * channels, size, size)
        resized = _resizer(target, method)(planes)
        return to_lists(resized.reshape(len(matrix), -1), present, pa.float64())

    return resize(doubles(col))
