"""Vector functions: hand values, edge values and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import (
    clamp,
    concat_mask,
    interpolate,
    layer_norm,
    layout,
    linear_project,
    lr_schedule,
    quantize_f16,
    recover_latent,
    sample_noise,
    sample_time,
    scale_latents,
    scale_pixels,
    squeeze,
    target_velocity,
    time_embedding,
    tokenize_pad,
    velocity_mse,
)
from vecloom.operators import clip_norm, zip_columns

VECTOR = "v array<double>"


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def values(spark, rows, column):
    return [r[0] for r in one(spark, [(r,) for r in rows], VECTOR, column)]


def test_scale_pixels(spark):
    assert values(spark, [[0.0, 128.0, 255.0], None, []], scale_pixels("v")) == [
        [-1.0, 0.0, 0.9921875],
        None,
        [],
    ]


def test_scale_latents_has_an_inverse(spark):
    (back,) = values(spark, [[1.0, -2.5]], scale_latents(scale_latents("v"), inverse=True))
    assert back == pytest.approx([1.0, -2.5])


def test_clamp_keeps_nulls_and_nan(spark):
    (row,) = values(spark, [[-1.0, 0.25, 2.0, None, math.nan]], clamp("v"))
    assert row[:4] == [0.0, 0.25, 1.0, None] and math.isnan(row[4])


def test_quantize_f16_equals_numpy(spark):
    rng = np.random.default_rng(5)
    tricky = [0.0, -0.0, 1e-9, 5.96e-8, 6.1e-5, 65503.0, 65519.99, 65520.0, -70000.0, 2049.0, 2051.0, 1 / 3]
    sample = np.concatenate([tricky, rng.normal(size=2000), rng.normal(size=500) * 1e-6, rng.normal(size=500) * 3e4])
    (row,) = values(spark, [sample.tolist()], quantize_f16("v"))
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(row), sample.astype(np.float16).astype(np.float64))
    (twice,) = values(spark, [row], quantize_f16("v"))
    assert twice == row


def test_quantize_f16_special_values(spark):
    (row,) = values(spark, [[math.nan, math.inf, -math.inf, None]], quantize_f16("v"))
    assert math.isnan(row[0]) and row[1:] == [math.inf, -math.inf, None]


def test_squeeze(spark):
    schema = "v array<array<double>>"
    rows = [([[1.0, 2.0]],), ([[1.0], [2.0], [3.0]],), (None,)]
    assert [r[0] for r in one(spark, rows, schema, squeeze("v"))] == [[1.0, 2.0], [1.0, 2.0, 3.0], None]
    with pytest.raises(Exception, match="squeeze"):
        one(spark, [([[1.0, 2.0], [3.0, 4.0]],)], schema, squeeze("v"))


def test_layout(spark):
    flat = [float(i) for i in range(6)]  # two channels of three tokens
    assert values(spark, [flat], layout("v", 2, 3, "channels_last")) == [[0, 3, 1, 4, 2, 5]]
    assert values(spark, [flat], layout("v", 2, 3, "tokens")) == [[[0, 3], [1, 4], [2, 5]]]
    both = layout(layout("v", 2, 3, "channels_last"), 2, 3, "channels_first")
    assert values(spark, [flat], both) == [flat]


def test_concat_mask(spark):
    (row,) = one(spark, [([1, 0],)], "m array<int>", concat_mask("m", 3))
    assert row[0] == [1, 1, 1, 1, 0]


def test_zip_columns_stops_at_the_shortest(spark):
    rows = [(1, [1.0, 2.0, 3.0], [4.0, 5.0]), (2, [], [1.0]), (3, None, [1.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    # The row with a null array stays, as a row of nulls.
    assert sorted(map(tuple, zip_columns(df, ["a", "b"], ["id"]).collect())) == [(1, 1.0, 4.0), (1, 2.0, 5.0), (3, None, None)]


def test_layer_norm(spark):
    (row, constant, missing) = values(spark, [[1.0, 2.0, 3.0, 4.0], [7.0, 7.0], None], layer_norm("v"))
    x = np.array([1.0, 2.0, 3.0, 4.0])
    assert row == pytest.approx((x - x.mean()) / np.sqrt(x.var() + 1e-5))
    assert constant == [0.0, 0.0] and missing is None


def test_linear_project_and_its_limits(spark):
    weight = np.arange(6.0).reshape(2, 3)
    got = values(spark, [[1.0, 2.0, 3.0], None], linear_project("v", weight, [10.0, 20.0], [0.5, 0.5]))
    assert got == [[18.5, 46.5], None]
    with pytest.raises(Exception, match="same length"):
        values(spark, [[1.0, 2.0]], linear_project("v", weight))
    with pytest.raises(ValueError, match="too many"):
        linear_project("v", np.zeros((5000, 5000)))


def test_interpolation_ends_at_noise_and_data(spark):
    schema = "x array<double>, n array<double>"
    row = ([1.0, 2.0], [-3.0, 5.0])
    at = lambda t: interpolate("n", "x", F.lit(t))
    target = target_velocity("x", "n")
    (got,) = one(
        spark, [row], schema, at(0.0), at(1.0), target,
        recover_latent(at(0.3), target, F.lit(0.3)), velocity_mse(target, "n"), velocity_mse(F.array(), F.array()),
    )
    assert got[0] == row[1] and got[1] == row[0] and got[2] == [4.0, -3.0]
    assert got[3] == pytest.approx(row[0])
    assert got[4] == pytest.approx((49 + 64) / 2) and got[5] is None


def test_time_embedding(spark):
    (row,) = values(spark, [[0.5]], time_embedding(F.col("v")[0], 8))
    frequencies = np.exp(-np.log(10000.0) * np.arange(4) / 3)
    assert row == pytest.approx(np.concatenate([np.sin(0.5 * frequencies), np.cos(0.5 * frequencies)]))
    with pytest.raises(ValueError):
        time_embedding(F.lit(0.5), 2)


def test_lr_schedule(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 25, 50, 525, 1000)], "s int")
    rates = [r[0] for r in steps.orderBy("s").select(lr_schedule(F.col("s"), 1000)).collect()]
    assert rates == pytest.approx([5e-5, 2.75e-4, 5e-4, 2.75e-4, 5e-5])
    no_warmup = spark.range(1).select(lr_schedule(F.col("id"), 10)).head()[0]
    assert no_warmup == pytest.approx(5e-4)


def test_draws_look_normal_and_uniform(spark):
    keys = spark.range(4000)
    noise = np.array([r[0] for r in keys.select(sample_noise(F.col("id"), 33)).collect()])
    assert noise.shape == (4000, 33)
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 1) < 0.01
    assert abs((noise**3).mean()) < 0.03 and abs((noise**4).mean() - 3) < 0.1
    between = np.corrcoef(noise, rowvar=False) - np.eye(33)
    assert np.abs(between).max() < 0.08
    times = np.array([r[0] for r in keys.select(sample_time(F.col("id"))).collect()])
    assert times.min() >= 0 and times.max() < 1
    assert abs(times.mean() - 0.5) < 0.02 and abs(times.var() - 1 / 12) < 0.005


def test_draws_depend_on_key_and_seed_only(spark):
    def draw(df, seed):
        return dict(df.select("id", F.xxhash64(sample_noise(F.col("id"), 5, seed))).collect())

    a = draw(spark.range(0, 100, 1, 1), 0)
    assert a == draw(spark.range(0, 100, 1, 7).repartition(3), 0)
    assert not set(a.values()) & set(draw(spark.range(100), 1).values())
    missing = spark.sql("select cast(null as bigint) k")
    assert missing.select(sample_noise(F.col("k"), 3), sample_time(F.col("k"))).head() == (None, None)


def test_tokenize_pad(spark):
    rows = [("  Two\twords\n",), ("",), (None,), (" ".join(["a"] * 9),)]
    got = [r[0] for r in one(spark, rows, "t string", tokenize_pad("t", 4))]
    assert [g and g["mask"] for g in got] == [[1, 1, 0, 0], [0, 0, 0, 0], None, [1, 1, 1, 1]]
    assert [g and g["n_tokens"] for g in got] == [2, 0, None, 9]
    assert got[0]["ids"][2:] == [0, 0] and min(got[0]["ids"][:2]) > 0
    assert len(set(got[3]["ids"])) == 1


def test_clip_norm(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [0.3, 0.4])], "g int, v array<double>")
    whole = clip_norm(df, "v", 1.0)
    assert whole.select("norm").head()[0] == pytest.approx(math.sqrt(25.25))
    flat = np.array([r.v for r in whole.collect()])
    assert np.linalg.norm(flat) == pytest.approx(1.0, abs=1e-6)
    by = {(r.g, round(r.norm, 6)) for r in clip_norm(df, "v", 1.0, ["g"]).collect()}
    assert by == {(1, 5.0), (2, 0.5)}
    kept = clip_norm(df, "v", 1.0, ["g"]).filter("g = 2").head().v
    assert kept == [0.3, 0.4]
