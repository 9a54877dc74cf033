"""Euler integration of a velocity field from noise (t = 0) towards data (t = 1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrays import doubles
from vecloom.functions.arrow import list_offsets, scatter, to_lists, to_matrix, user_udf
from vecloom.functions.draws import counter, normals, sample_time

# Inference steps, and steps between two snapshots.
INFERENCE_STEPS = 50
SNAPSHOT_EVERY = 5

# v(z, t, *context): arrays of one row per sample in, velocities of z's shape out.
VelocityField = Callable[..., np.ndarray]


def _rows_with_all(columns: Sequence[pa.Array]) -> np.ndarray:
    present = np.ones(len(columns[0]), dtype=bool)
    for column in columns:
        present &= np.asarray(column.is_valid())
    return present


def _walk(v_fn: VelocityField, n: int, z: np.ndarray, context: list[np.ndarray]):
    for i in range(n):
        z = z + v_fn(z, i / n, *context) / n
        yield i, z


def velocity_at(
    z: Column, t: Column, v_fn: VelocityField, context: Sequence[Column] = ()
) -> Column:
    """A velocity field applied to a column of states, each at its own time."""

    @user_udf("array<double>")
    def velocity(times: pa.Array, *columns: pa.Array) -> pa.Array:
        present = _rows_with_all([times, *columns])
        if not present.any():
            return pa.nulls(len(present), pa.list_(pa.float64()))
        keep = pa.array(present)
        state, *rest = [to_matrix(c.filter(keep))[0] for c in columns]
        at = times.filter(keep).to_numpy(zero_copy_only=False)[:, None]
        return to_lists(v_fn(state, at, *rest), present, pa.float64())

    return velocity(t, doubles(z), *[doubles(c) for c in context])


def velocity_loss(
    key: Column,
    x: Column,
    dim: int,
    v_fn: VelocityField,
    seed: int = 0,
    context: Sequence[Column] = (),
) -> Column:
    """Squared error of a velocity field at the key's drawn noise and time.

    The same as ``sample_noise``, ``sample_time``, ``interpolate``,
    ``target_velocity``, ``velocity_at`` and ``velocity_mse`` one after another,
    but a vector goes to Python once and only a number comes back.
    """

    @F.arrow_udf("double")
    def loss(start: pa.Array, stride: pa.Array, times: pa.Array, *columns: pa.Array) -> pa.Array:
        present = _rows_with_all([start, *columns])
        if not present.any():
            return pa.nulls(len(present), pa.float64())
        keep = pa.array(present)
        data, *rest = [to_matrix(c.filter(keep))[0] for c in columns]
        t = times.filter(keep).to_numpy(zero_copy_only=False)[:, None]
        noise = normals(np.asarray(start.filter(keep)), np.asarray(stride.filter(keep)), dim)
        miss = v_fn((1.0 - t) * noise + t * data, t, *rest) - (data - noise)
        return scatter((miss * miss).mean(axis=1), present)

    drawn = (*counter(key, seed, "noise"), sample_time(key, seed))
    return loss(*drawn, doubles(x), *[doubles(c) for c in context])


def euler_sample(
    z: Column, v_fn: VelocityField, n: int = INFERENCE_STEPS, context: Sequence[Column] = ()
) -> Column:
    """``z`` after ``n`` Euler steps. ``v_fn`` works on a whole Arrow batch of vectors."""

    @user_udf("array<double>")
    def sample(*columns: pa.Array) -> pa.Array:
        present = _rows_with_all(columns)
        if not present.any():
            return pa.nulls(len(present), pa.list_(pa.float64()))
        state, *rest = [to_matrix(c.filter(pa.array(present)))[0] for c in columns]
        for _, state in _walk(v_fn, n, state, rest):
            pass
        return to_lists(state, present, pa.float64())

    return sample(doubles(z), *[doubles(c) for c in context])


def euler_snapshots(
    df: DataFrame,
    z: str,
    v_fn: VelocityField,
    n: int = INFERENCE_STEPS,
    every: int = SNAPSHOT_EVERY,
    context: Sequence[str] = (),
) -> DataFrame:
    """One row per sample and snapshot: the state after every ``every`` steps and after the last."""
    kept = [i for i in range(n) if (i + 1) % every == 0 or i == n - 1]

    @user_udf("array<array<double>>")
    def history(*columns: pa.Array) -> pa.Array:
        present = _rows_with_all(columns)
        if not present.any():
            return pa.nulls(len(present), pa.list_(pa.list_(pa.float64())))
        state, *rest = [to_matrix(c.filter(pa.array(present)))[0] for c in columns]
        states = [s for i, s in _walk(v_fn, n, state, rest) if i in kept]
        dim = state.shape[1]
        inner = np.stack(states, axis=1).reshape(-1, dim)
        vectors = to_lists(inner, np.ones(len(inner), dtype=bool), pa.float64())
        ends = np.cumsum(present) * len(kept)
        return pa.ListArray.from_arrays(list_offsets(ends), vectors, mask=pa.array(~present))

    names = [c for c in df.columns if c != z]
    steps = F.lit([i + 1 for i in kept])
    vectors = df.withColumn("_history", history(doubles(z), *[doubles(c) for c in context]))
    return vectors.select(*names, F.posexplode("_history").alias("_at", z)).select(
        *names, F.element_at(steps, F.col("_at") + 1).alias("step"), z
    )


def euler_fold(z: Column, v_col: Callable[[Column, Column], Column], n: int = INFERENCE_STEPS) -> Column:
    """The same for a field given as a column expression ``v_col(z, t)``.

    Lambdas are interpreted, so a field that numpy can express is faster in ``euler_sample``.
    """
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        doubles(z),
        lambda state, i: F.zip_with(state, v_col(state, i / F.lit(float(n))), lambda a, v: a + v / n),
    )
