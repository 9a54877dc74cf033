"""User models and user functions over rows, and a linear model that learns the velocity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.arrow import tensor_lists
from vecloom.functions.text import MAX_LENGTH, hash_embed, tokenize_pad
from vecloom.operators.sampling import VelocityField
from vecloom.operators.stats import moment_states, whole_moments

# Rows handed to a model at once, and length of a text vector.
MODEL_BATCH = 32
TEXT_DIM = 512


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """A user function per row, fed by Arrow batches."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([fn(row) for row in frame.to_dict("records")], columns=names)

    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).names
    return df.mapInPandas(apply, schema)


def _model(make_predict_fn: Callable, batch_size: int, **shapes):
    """A user's model as a function of columns, run once for a row."""
    vector = T.ArrayType(T.FloatType())
    udf = predict_batch_udf(make_predict_fn, return_type=vector, batch_size=batch_size, **shapes)
    return udf.asNondeterministic()


def embed_text(
    df: DataFrame,
    col: str,
    make_predict_fn: Callable | None = None,
    batch_size: int = MODEL_BATCH,
    dim: int = TEXT_DIM,
    max_length: int = MAX_LENGTH,
    name: str = "embeds",
) -> DataFrame:
    """Add a text vector and ``mask``.

    ``make_predict_fn`` loads a user's model once in each Python worker; the mask is that
    of the default tokens. For a model with tokens of its own see ``embed_tokens``.
    Without a model the vector holds signed counts of hashed tokens.
    """
    tokens = df.withColumn("_tokens", tokenize_pad(col, max_length))
    if make_predict_fn is None:
        vector = hash_embed(F.col("_tokens.ids"), dim)
    else:
        vector = _model(make_predict_fn, batch_size)(F.col(col))
    return tokens.withColumn(name, vector).withColumn("mask", F.col("_tokens.mask")).drop("_tokens")


def embed_tokens(
    df: DataFrame,
    col: str,
    make_predict_fn: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]],
    batch_size: int = MODEL_BATCH,
    name: str = "embeds",
    mask: str = "mask",
) -> DataFrame:
    """Add the vectors of a text's tokens and the mask, both as the model's own tokenizer has them.

    ``make_predict_fn`` loads the model once in a task; called with texts it gives
    vectors (texts x tokens x dim) and the mask (texts x tokens). The number of tokens
    may differ between calls. A null text has neither. ``batch_size`` texts go to the
    model at once, and their vectors leave the task before the next ones are made.
    """
    kind = f"struct<{name}: array<array<float>>, {mask}: array<int>>"

    @F.arrow_udf(kind)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predict_fn()
        for batch in batches:
            for first in range(0, len(batch), batch_size):
                texts = batch.slice(first, batch_size)
                given = [t for t in texts.to_pylist() if t is not None]
                vectors, masks = predict(given) if given else (np.zeros((0, 0, 0)), np.zeros((0, 0)))
                if len(vectors) != len(given) or vectors.shape[:2] != masks.shape:
                    raise ValueError(f"{len(given)} texts gave vectors {vectors.shape} and a mask {masks.shape}")
                there, spread, masked = np.asarray(texts.is_valid()), iter(vectors), iter(masks)
                lists = [
                    tensor_lists([next(spread) if t else None for t in there], 2, pa.float32()),
                    tensor_lists([next(masked) if t else None for t in there], 1, pa.int32()),
                ]
                yield pa.StructArray.from_arrays(lists, [name, mask])

    embedded = df.withColumn("_embedded", embed.asNondeterministic()(F.col(col)))
    return embedded.withColumn(name, F.col(f"_embedded.{name}")).withColumn(mask, F.col(f"_embedded.{mask}")).drop("_embedded")


def embed_images(
    df: DataFrame,
    col: str,
    make_predict_fn: Callable,
    shape: Sequence[int],
    batch_size: int = MODEL_BATCH,
    name: str = "features",
) -> DataFrame:
    """Add a user's model's vector of a flat image column of the given shape."""
    model = _model(make_predict_fn, batch_size, input_tensor_shapes=[list(shape)])
    return df.withColumn(name, model(F.col(col).cast("array<float>")))


def fit_velocity(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    ridge: float = 0.0,
    partials: int | None = None,
) -> DataFrame:
    """Least-squares weights from array columns, and a constant without penalty, to the target vector.

    The moments of features and target together decide them. One row per weight: ``feature`` 0 is the constant, ``output`` counts from 0.
    """
    states = moment_states(df, [*features, target], partials=partials)
    known = len(features)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, m = whole_moments(batches)
        p = sum(widths[:known])
        penalty = np.eye(p) * ridge
        slopes = np.linalg.solve(m.products[:p, :p] + penalty, m.products[:p, p:])
        weights = np.vstack([m.mean[p:] - m.mean[:p] @ slopes, slopes])
        places = np.indices(weights.shape, dtype=np.int32).reshape(2, -1)
        arrays = [pa.array(places[0]), pa.array(places[1]), pa.array(weights.reshape(-1))]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "output", "weight"])

    return states.groupBy().applyInArrow(solve, "feature int, output int, weight double")


def linear_field(weights: Iterable, n_features: int, n_outputs: int) -> VelocityField:
    """The velocity field of collected weights; features are the state, then the time."""
    w = np.zeros((n_features, n_outputs))
    for row in weights:
        w[row["feature"], row["output"]] = row["weight"]

    def field(z: np.ndarray, t: float | np.ndarray, *context: np.ndarray) -> np.ndarray:
        times = np.broadcast_to(np.asarray(t, dtype=np.float64), (len(z), 1))
        return np.concatenate([np.ones((len(z), 1)), z, times, *context], axis=1) @ w

    return field
