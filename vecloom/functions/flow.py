"""Interpolation between noise and data, velocity targets, and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.arrays import doubles, total

# The schedule's defaults and the base of the time frequencies.
BASE_RATE = 5e-4
WARMUP_RATIO = 0.05
DECAY_RATIO = 0.1
FREQUENCY_BASE = 10000.0


def interpolate(noise: Column | str, x: Column | str, t: Column) -> Column:
    return F.zip_with(doubles(noise), doubles(x), lambda n, v: (1 - t) * n + t * v)


def target_velocity(x: Column | str, noise: Column | str) -> Column:
    return F.zip_with(doubles(x), doubles(noise), lambda v, n: v - n)


def recover_latent(z_t: Column | str, velocity: Column | str, t: Column) -> Column:
    return F.zip_with(doubles(z_t), doubles(velocity), lambda z, v: z + (1 - t) * v)


def velocity_mse(predicted: Column | str, target: Column | str) -> Column:
    """Mean squared difference of two vectors."""
    squares = F.zip_with(doubles(predicted), doubles(target), lambda p, v: (p - v) * (p - v))
    return F.try_divide(total(squares), F.size(doubles(target)))


def time_embedding(t: Column, dim: int = 256) -> Column:
    """Sines, then cosines, of ``t`` at geometrically falling frequencies."""
    half = dim // 2
    if half < 2:
        raise ValueError("time_embedding needs a dimension of at least 4")
    decay = math.log(FREQUENCY_BASE) / (half - 1)
    frequencies = F.lit([math.exp(-decay * i) for i in range(half)])
    return F.concat(
        F.transform(frequencies, lambda f: F.sin(t * f)),
        F.transform(frequencies, lambda f: F.cos(t * f)),
    )


def lr_schedule(
    step: Column,
    total_steps: int,
    base: float = BASE_RATE,
    warmup_ratio: float = WARMUP_RATIO,
    decay_ratio: float = DECAY_RATIO,
) -> Column:
    """Learning rate used at ``step``: linear warm-up, then cosine to the floor."""
    warmup = int(warmup_ratio * total_steps)
    floor = base * decay_ratio
    progress = (step - warmup) / F.lit(float(max(total_steps - warmup, 1)))
    cosine = floor + (base - floor) * (1 + F.cos(math.pi * progress)) / 2
    if warmup == 0:
        return cosine
    ramp = decay_ratio + (1 - decay_ratio) * step / F.lit(float(warmup))
    return F.when(step < warmup, base * ramp).otherwise(cosine)
