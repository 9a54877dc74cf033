"""Statistics, sampling, models and images against numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.functions import quantize_f16, sample_noise
from vecloom.operators import (
    embed_images,
    embed_text,
    embed_tokens,
    euler_fold,
    euler_sample,
    euler_snapshots,
    evaluate,
    fit_velocity,
    frechet_diagonal,
    frechet_distance,
    linear_field,
    map_rows,
    mean_vector,
    prepare_images,
    resize_planes,
    tensor_stats,
    vector_moments,
)
from vecloom.operators import stats
from vecloom.operators.images import resize_weights


@pytest.fixture(scope="module")
def vectors(spark):
    """A thousand vectors; group 0 holds two thirds of them."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1000, 6)) @ rng.normal(size=(6, 6)) + 1000.0
    groups = [0 if i % 3 else i % 7 + 1 for i in range(1000)]
    rows = [(i, g, v.tolist()) for i, (g, v) in enumerate(zip(groups, data))]
    return spark.createDataFrame(rows, "id int, g int, v array<double>").repartition(9), data, np.array(groups)


def test_vector_moments(vectors):
    df, data, _ = vectors
    (row,) = vector_moments(df, "v").collect()
    assert row.n == 1000
    assert np.allclose(row.mean, data.mean(axis=0), atol=1e-10)
    assert np.allclose(row.cov, np.cov(data, rowvar=False), rtol=1e-9)


@pytest.mark.parametrize("held", [stats.MAX_HELD, 60])
def test_vector_moments_by_group(vectors, monkeypatch, held):
    monkeypatch.setattr(stats, "MAX_HELD", held)
    df, data, groups = vectors
    got = {r.g: r for r in vector_moments(df, "v", ["g"], partials=3).collect()}
    assert got.keys() == set(groups)
    for g, row in got.items():
        part = data[groups == g]
        assert row.n == len(part)
        assert np.allclose(row.cov, np.cov(part, rowvar=False), rtol=1e-8)


def test_moments_of_nothing_and_of_nulls(spark, vectors):
    df, _, _ = vectors
    assert vector_moments(df.limit(0), "v").count() == 0
    extra = df.unionByName(spark.sql("select -1 id, 0 g, cast(null as array<double>) v"))
    assert vector_moments(extra, "v").head().n == 1000


def test_moments_with_null_groups(spark):
    rows = [(None, [1.0]), (None, [3.0]), ("a", [5.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    assert {(r.g, r.n, r.mean[0]) for r in vector_moments(df, "v", ["g"]).collect()} == {(None, 2, 2.0), ("a", 1, 5.0)}


def test_blocks_and_merges_of_tasks(vectors, monkeypatch):
    df, data, groups = vectors
    monkeypatch.setattr(stats, "MERGED", 2)
    states = stats.moment_states(df, ["v"], ["g"], side=4)
    assert states.filter("g = 0").select("i", "j").distinct().count() == 3
    assert states.filter("g = 0").groupBy("i", "j").count().filter("count > 1").count() == 3
    assert "Generate" not in states._jdf.queryExecution().optimizedPlan().toString()

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, m = stats.whole_moments(batches, 4)
        yield pa.RecordBatch.from_arrays([pa.array([widths]), pa.array([(m.products / (m.n - 1)).reshape(-1)])], ["w", "c"])

    row = states.filter("g = 0").groupBy().applyInArrow(wide, "w array<bigint>, c array<double>").head()
    assert row.w == [6] and np.allclose(np.reshape(row.c, (6, 6)), np.cov(data[groups == 0], rowvar=False), rtol=1e-9)


def test_wide_vectors(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(12, 4200))
    df = spark.createDataFrame([(v.tolist(),) for v in data], "v array<double>").repartition(3)
    row = vector_moments(df, "v").select("n", "mean", F.slice("cov", 4100, 2).alias("some")).head()
    assert row.n == 12 and np.allclose(row["mean"], data.mean(axis=0))
    assert np.allclose(row.some, np.cov(data[:, 4099:4101], data, rowvar=False)[:2, 2:])


def test_moments_run_nothing_beforehand(spark, vectors):
    df = vectors[0].withColumn("v", F.when(F.raise_error(F.lit("ran")).isNull(), F.col("v")))
    for build in (lambda: vector_moments(df, "v"), lambda: frechet_distance(df, df, "v"), lambda: fit_velocity(df, ["v"], "v")):
        with pytest.raises(Exception, match="ran"):
            build().collect()


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(4000, 3)) + 1e8
    df = spark.createDataFrame([(i % 40, v.tolist()) for i, v in enumerate(data)], "g int, v array<double>").repartition(16)
    assert np.allclose(vector_moments(df, "v").head().cov, np.cov(data, rowvar=False), rtol=1e-6, atol=1e-6)
    row = tensor_stats(df, ["v"]).head()
    assert row["std"] == pytest.approx(data.std(ddof=1), rel=1e-6) and row["mean"] == pytest.approx(data.mean(), rel=1e-14)


def general_frechet(a: np.ndarray, b: np.ndarray) -> float:
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    roots = np.sqrt(np.linalg.eigvals(s1 @ s2).astype(complex)).real.sum()
    return ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * roots


def test_frechet_distance(vectors):
    df, data, groups = vectors
    one, two = df.filter("g = 0"), df.filter("g > 0")
    got = frechet_distance(one, two, "v").head()[0]
    assert got == pytest.approx(general_frechet(data[groups == 0], data[groups > 0]), rel=1e-6)
    assert frechet_distance(two, one, "v").head()[0] == pytest.approx(got, rel=1e-9)
    assert frechet_distance(one, one, "v").head()[0] == pytest.approx(0.0, abs=1e-7)
    assert frechet_distance(one, two.limit(0), "v").head()[0] is None


def test_frechet_diagonal(vectors):
    df, data, groups = vectors
    a, b = data[groups == 0], data[groups > 0]
    expected = ((a.mean(0) - b.mean(0)) ** 2).sum() + ((a.std(0, ddof=1) - b.std(0, ddof=1)) ** 2).sum()
    assert frechet_diagonal(df.filter("g = 0"), df.filter("g > 0"), "v").head()[0] == pytest.approx(expected)


def test_tensor_stats(spark):
    rows = [(1, [1.0, 2.0], [5.0]), (1, [4.0], None), (2, [7.0], [1.0])]
    df = spark.createDataFrame(rows, "g int, a array<double>, b array<double>")
    got = {(r.g, r.tensor): (r["min"], r["mean"], r["max"], r["std"]) for r in tensor_stats(df, ["a", "b"], ["g"]).collect()}
    assert got[1, "a"] == pytest.approx((1.0, 7 / 3, 4.0, np.std([1, 2, 4], ddof=1)))
    assert got[1, "b"] == (5.0, 5.0, 5.0, None) and got[2, "a"][:3] == (7.0, 7.0, 7.0)


def test_tensor_stats_of_odd_arrays(spark):
    nan = float("nan")
    rows = [(None, [1.0, None, 3.0]), (None, []), (1, [nan, 2.0]), (1, None), (2, None), (3, [nan])]
    df = spark.createDataFrame(rows, "g int, a array<double>").repartition(3)
    stat = tensor_stats(df, ["a"], ["g"])
    got = {r.g: (r["min"], r["mean"], r["max"], r["std"]) for r in stat.collect()}
    assert set(got) == {None, 1, 3} and got[None] == pytest.approx((1.0, 2.0, 3.0, 2**0.5))
    assert got[1][0] == 2.0 and all(np.isnan(x) for x in got[1][1:]) and np.isnan(got[3][0]) and got[3][3] is None
    assert tensor_stats(df.limit(0), ["a"], ["g"]).count() == tensor_stats(df.limit(0), ["a"]).count() == 0
    assert "Generate" not in stat._jdf.queryExecution().optimizedPlan().toString()


def test_mean_vector(vectors):
    df, data, groups = vectors
    for row in mean_vector(df, "v", ["g"]).collect():
        assert np.allclose(row.mean_vector, data[groups == row.g].mean(axis=0))
    assert np.allclose(mean_vector(df, "v").head()[0], data.mean(axis=0))


def ideal(z, t, x):
    return (x - z) / (1.0 - t)


def test_euler_ends_at_the_data(vectors):
    df, data, _ = vectors
    start = df.withColumn("z", sample_noise(F.col("id"), 6))
    ends = start.select("id", euler_sample(F.col("z"), ideal, 50, [F.col("v")]).alias("z")).collect()
    assert np.allclose([r.z for r in sorted(ends)], data, atol=1e-9)
    by_column = euler_fold(
        F.col("z"), lambda z, t: F.zip_with("v", z, lambda x, a: (x - a) / (1.0 - t)), 10
    )
    folded = start.select("id", by_column.alias("z")).collect()
    assert np.allclose([r.z for r in sorted(folded)], data, atol=1e-9)


def test_euler_snapshots(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0])], "id int, z array<double>")
    shots = euler_snapshots(df, "z", lambda z, t: np.ones_like(z), n=7, every=3).collect()
    assert {(r.id, r.step) for r in shots} == {(i, s) for i in (1, 3) for s in (3, 6, 7)}
    assert {r.step: r.z[0] for r in shots if r.id == 1} == pytest.approx({3: 3 / 7, 6: 6 / 7, 7: 1.0})


def test_evaluate(spark, vectors):
    rows = vectors[0].withColumn("idx", F.col("id"))
    loss, samples = evaluate(rows, "id", "v", 6, ideal, n=5, context=["v"])
    assert loss.head()[0] == pytest.approx(0.0, abs=1e-9)
    assert samples.count() == 1000 and len(samples.head().generated) == 6
    empty, none = evaluate(rows.limit(0), "id", "v", 6, ideal, context=["v"])
    assert empty.head()[0] is None and none.count() == 0


def test_fit_velocity_finds_a_linear_field(spark):
    rng = np.random.default_rng(1)
    z, t = rng.normal(size=(300, 3)), rng.uniform(size=(300, 1))
    weights = rng.normal(size=(5, 3))
    target = np.concatenate([np.ones((300, 1)), z, t], axis=1) @ weights
    rows = [(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(z, t, target)]
    df = spark.createDataFrame(rows, "z array<double>, t array<double>, y array<double>").repartition(5)
    found = fit_velocity(df, ["z", "t"], "y").collect()
    assert len(found) == 15
    field = linear_field(found, 5, 3)
    assert np.allclose(field(z, t), target)
    assert np.allclose(field(z, 0.25), field(z, np.full((300, 1), 0.25)))
    assert fit_velocity(df.limit(0), ["z", "t"], "y").count() == 0


def test_map_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    got = map_rows(df, lambda r: {"n": r["id"] * 2, "t": r["t"].upper()}, "t string, n int").collect()
    assert sorted(map(tuple, got)) == [("A", 2), ("B", 4)]


def text_model():
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)


def image_model():
    return lambda images: images.reshape(len(images), -1).sum(axis=1, keepdims=True)


def test_user_models(spark):
    df = spark.createDataFrame([("a b", [1.0, 2.0, 3.0, 4.0])], "t string, v array<double>")
    row = embed_text(df, "t", text_model).head()
    assert row.embeds == [3.0, 1.0] and sum(row["mask"]) == 2
    assert embed_images(df, "v", image_model, (2, 2)).head().features == [10.0]


def token_model():
    def predict(texts):
        tokens = max(len(t) for t in texts)
        mask = np.array([[1] * len(t) + [0] * (tokens - len(t)) for t in texts])
        return np.array([[[ord(c), i] for i, c in enumerate(t.ljust(tokens))] for t in texts], float), mask

    return predict


def test_vectors_of_tokens_with_the_model_s_own_mask(spark):
    rows = [(i, t) for i, t in enumerate(["abcd", "x", None, "yz", ""])]
    df = spark.createDataFrame(rows, "mask int, t string").coalesce(1)
    got = {r["mask"]: r for r in embed_tokens(df, "t", token_model, batch_size=3, mask="own").collect()}
    assert got[0].embeds == [[97.0, 0.0], [98.0, 1.0], [99.0, 2.0], [100.0, 3.0]] and got[0].own == [1, 1, 1, 1]
    assert got[1].own == [1, 0, 0, 0] and got[3].own == [1, 1] and got[4].own == [0, 0]
    assert got[2].embeds is None and got[2].own is None
    assert embed_tokens(df.limit(0), "t", token_model).count() == 0

    def wrong():
        return lambda texts: (np.zeros((len(texts), 2, 3)), np.zeros((len(texts), 4)))

    with pytest.raises(Exception, match="gave vectors"):
        embed_tokens(df, "t", wrong).collect()


def test_default_text_vector(spark):
    df = spark.createDataFrame([("a a b",), ("",), (None,)], "t string")
    rows = [r.embeds for r in embed_text(df, "t", dim=16).collect()]
    assert sorted(abs(x) for x in rows[0] if x) in ([1.0, 2.0], [1.0], [3.0])
    assert rows[1] == [0.0] * 16 and rows[2] is None


def brute_lanczos(size, target, o):
    """Weights of one output pixel by the textbook formula."""
    ratio = size / target
    stretch = max(ratio, 1.0)
    center = (o + 0.5) * ratio
    weights = []
    for s in range(size):
        x = (s + 0.5 - center) / stretch
        weights.append(np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0.0)
    return np.array(weights) / sum(weights)


@pytest.mark.parametrize("size,target", [(8, 4), (5, 9), (7, 7), (100, 64)])
def test_lanczos_weights(size, target):
    for o in range(target):
        assert np.allclose(resize_weights(size, target, "lanczos")[o], brute_lanczos(size, target, o), atol=1e-12)


def test_bilinear_weights():
    assert np.allclose(resize_weights(2, 4, "bilinear"), [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]])
    assert np.allclose(resize_weights(4, 2, "bilinear"), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])


def test_prepare_images(spark, tmp_path):
    from tests.png import write_png

    rng = np.random.default_rng(2)
    photo = rng.integers(0, 256, size=(20, 30, 3), dtype=np.uint8)
    flat = np.full((9, 9, 3), (200, 100, 50), dtype=np.uint8)
    gray = np.full((4, 4, 1), 77, dtype=np.uint8)
    for name, pixels in (("photo", photo), ("flat", flat), ("gray", gray)):
        write_png(tmp_path / f"{name}.png", pixels)
    images = spark.read.format("image").load(str(tmp_path))
    rows = prepare_images(images, size=8).select("image.origin", "pixels").collect()
    got = {r.origin.rpartition("/")[2][:-4]: np.array(r.pixels).reshape(3, 8, 8) for r in rows}
    assert (got["flat"] == np.array([200, 100, 50])[:, None, None]).all()
    assert (got["gray"] == 77).all()
    planes = photo.transpose(2, 0, 1).astype(float)
    across = np.stack([brute_lanczos(30, 8, o) for o in range(8)])
    down = np.stack([brute_lanczos(20, 8, o) for o in range(8)])
    byte = lambda x: np.floor(np.clip(x, 0, 255) + 0.5)
    expected = byte(np.einsum("os,csx->cox", down, byte(planes @ across.T)))
    assert (got["photo"] == expected).all()


def test_many_images_that_grow(spark, monkeypatch):
    from vecloom.operators import images

    monkeypatch.setattr(images, "MAX_PIXELS", 5000)
    kind = "id int, image struct<height: int, width: int, nChannels: int, data: binary>"
    rows = [(i, None if i % 7 == 0 else (2 + i % 3, 3, 1, bytes([i % 256]) * (3 * (2 + i % 3)))) for i in range(60)]
    got = prepare_images(spark.createDataFrame(rows, kind).coalesce(1), size=30).collect()
    assert len(got) == 60
    for r in got:
        assert r.pixels is None if r.id % 7 == 0 else set(r.pixels) == {float(r.id)} and len(r.pixels) == 2700


def test_resize_planes(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],), (None,)], "v array<double>")
    rows = [r[0] for r in df.select(resize_planes(F.col("v"), 1, 2, 4)).collect()]
    line = np.array([0, 0.25, 0.75, 1])
    assert np.allclose(np.array(rows[0]).reshape(4, 4), line[None, :] + 2 * line[:, None]) and rows[1] is None


def test_quantized_vectors_survive_a_round_trip(spark, vectors):
    df = vectors[0].select(quantize_f16("v").alias("h"))
    assert df.filter(F.col("h") != quantize_f16("h")).count() == 0
