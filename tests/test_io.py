"""Sources, sinks and streams."""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import scratch
from vecloom.functions import once, quantize_f16, velocity_mse
from vecloom.plans.prepare import SAMPLE_FIELDS, feed, prepare_samples, prepare_shards
from vecloom.sources import (
    decode_fields,
    encode_npy,
    expand_braces,
    expand_shards,
    index_members,
    list_files,
    list_manifest,
    log_metrics,
    lookup_rows,
    read_members,
    scan_eval_shard,
    scan_shards,
    tar_sink,
    tar_source,
    write_shards,
)
from vecloom.sources import tars
from vecloom.streaming import scan_indexed, stream_indexed, stream_prepare, stream_shards


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(25).select(
        F.col("id").alias("idx"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i + F.col("id") / 4).alias("v")
    )


@pytest.mark.parametrize(
    "pattern,expected",
    [
        ("a-{000001..000003}.tar", ["a-000001.tar", "a-000002.tar", "a-000003.tar"]),
        ("a-{8..11}", ["a-8", "a-9", "a-10", "a-11"]),
        ("a-{000009..00010}", ["a-000009", "a-000010"]),
        ("a-{3..1}", ["a-3", "a-2", "a-1"]),
        ("a-{0..1}", ["a-0", "a-1"]),
        ("plain.tar", ["plain.tar"]),
    ],
)
def test_expand_shards(spark, pattern, expected):
    assert expand_braces(pattern) == expected
    assert spark.range(1).select(expand_shards(F.lit(pattern))).head()[0] == expected


def test_shards_round_trip(spark, samples, tmp_path):
    root = str(tmp_path / "shards")
    write_shards(samples.repartition(4), root, samples_per_shard=10)
    assert {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "shards").glob("shard=*")} == {
        "shard=0": 1, "shard=1": 1, "shard=2": 1,
    }
    train = scan_shards(spark, root, 1, 2)
    assert sorted(r.idx for r in train.collect()) == list(range(10, 25))
    assert [r.idx for r in scan_eval_shard(spark, root).collect()] == list(range(10))
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_write_shards_indexes_rows_without_one(spark, tmp_path):
    rows = spark.range(7).select((100 - F.col("id")).alias("k"))
    write_shards(rows, str(tmp_path / "s"), ["k"], samples_per_shard=3)
    got = spark.read.parquet(str(tmp_path / "s")).orderBy("idx").collect()
    assert [(r.idx, r.k, r.shard) for r in got] == [(i, 94 + i, i // 3) for i in range(7)]


def test_lookup_rows(spark, samples):
    assert sorted(r.idx for r in lookup_rows(samples, "idx", [3, 5, 99]).collect()) == [3, 5]
    ids = spark.createDataFrame([(3,), (3,), (7,)], "n bigint")
    assert sorted(r.idx for r in lookup_rows(samples, "idx", ids).collect()) == [3, 7]
    with pytest.raises(ValueError):
        lookup_rows(samples, "idx", range(5000))


@pytest.fixture(scope="module")
def tar_folder(spark, samples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tars") / "out")
    rows = samples.select(
        "idx",
        encode_npy("v").alias("latents"),
        F.when(F.col("idx") != 4, F.encode(F.col("idx").cast("string"), "UTF-8")).alias("label"),
    )
    tar_sink(rows, path, {"latents.npy": "latents", "label.cls": "label"}, samples_per_shard=10)
    return path


def test_tar_round_trip(spark, samples, tar_folder):
    source = tar_source(spark, tar_folder)
    assert {(r.shard, r["count"]) for r in source.groupBy("shard").count().collect()} == {(0, 10), (1, 10), (2, 5)}
    spec = {"v": ("latents.npy", "array<float>"), "label": ("label.cls", "int")}
    got = sorted(decode_fields(source, spec).collect(), key=lambda r: r.key)
    assert [r.key for r in got] == [f"{i:08d}" for i in range(25)]
    assert [r.v for r in got] == [r.v for r in samples.orderBy("idx").collect()]
    assert [r.label for r in got] == [i if i != 4 else None for i in range(25)]


def test_tar_paths(spark, tar_folder):
    assert tar_source(spark, f"{tar_folder}/shard-{{000001..000002}}.tar").count() == 15
    assert tar_source(spark, f"{tar_folder}/*-00000?.tar").count() == 25
    assert tar_source(spark, f"{tar_folder}/shard-000000.tar").count() == 10
    assert tar_source(spark, f"file:{tar_folder}").count() == tar_source(spark, f"file://{tar_folder}").count() == 25


def test_tar_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(6).select(F.col("id").alias("idx"), F.encode(F.lit("x"), "UTF-8").alias("x"))
    tar_sink(rows, path, {"txt": "x"}, samples_per_shard=2)
    with pytest.raises(Exception, match="overwrite"):
        tar_sink(rows, path, {"txt": "x"}, samples_per_shard=2)
    tar_sink(rows.filter("idx < 3"), path, {"txt": "x"}, samples_per_shard=2, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "t").glob("*.tar")) == ["shard-000000.tar", "shard-000001.tar"]
    assert tar_source(spark, path).count() == 3


def add(tar, name, content=b"x"):
    info = tarfile.TarInfo(name)
    info.size = len(content)
    tar.addfile(info, io.BytesIO(content))


def test_tar_grouping_rule(spark, tmp_path):
    with tarfile.open(tmp_path / "a-7.tar", "w") as tar:
        for name in ("d/a.JPG", "d/a.seg.png", "e/a.jpg", "README", "d/a.jpg"):
            add(tar, name)
    rows = tar_source(spark, str(tmp_path)).collect()
    assert [(r.shard, r.key, sorted(r.fields)) for r in rows] == [
        (7, "d/a", ["jpg", "seg.png"]), (7, "e/a", ["jpg"]), (7, "d/a", ["jpg"]),
    ]


def test_decode_two_levels_and_refuse_pickles(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6, dtype=np.float16).reshape(2, 3))
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        add(tar, "0.embeds.npy", buffer.getvalue())
        add(tar, "0.json", b'{"prompt": "a cat"}')
    source = tar_source(spark, str(tmp_path))
    spec = {"embeds": ("embeds.npy", "array<array<float>>"), "meta": ("json", "string"), "none": ("x.npy", "array<float>")}
    row = decode_fields(source, spec).head()
    assert row.embeds == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]] and row.none is None
    assert row.meta == '{"prompt": "a cat"}' and row.shard is None
    with pytest.raises(ValueError):
        decode_fields(source, {"x": ("latents.pyd", "array<float>")})
    pickled = io.BytesIO()
    np.save(pickled, np.array([{}], dtype=object), allow_pickle=True)
    with tarfile.open(tmp_path / "b.tar", "w") as tar:
        add(tar, "0.embeds.npy", pickled.getvalue())
    with pytest.raises(Exception, match="allow_pickle"):
        decode_fields(tar_source(spark, str(tmp_path / "b.tar")), {"e": ("embeds.npy", "array<float>")}).collect()


def test_log_metrics_appends(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 3)], "step int, loss double, norm int")
    log_metrics(rows, path, "step", ["loss", "norm"], "train/")
    log_metrics(rows.limit(0), path, "step", ["loss"])
    got = {tuple(r) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "train/loss", 0.5), (2, "train/loss", 0.25), (2, "train/norm", 3.0)}


def test_list_manifest(spark, tmp_path):
    for name in ("checkpoint_step_10.pt", "checkpoint_step_9.pt", "checkpoint_step_x.pt", "other.pt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.step for r in list_manifest(spark, str(tmp_path)).collect()) == [9, 10]


def test_prepare_shards(spark, tmp_path):
    rows = [(i, f"caption {i}" if i % 4 else " ") for i in range(20)]
    prepare_shards(spark.createDataFrame(rows, "id int, t string"), "t", ["id"], str(tmp_path / "p"), 16, 6)
    got = spark.read.parquet(str(tmp_path / "p")).orderBy("idx").collect()
    assert [r.id for r in got] == [i for i in range(20) if i % 4]
    assert [r.shard for r in got] == [i // 6 for i in range(15)]
    assert all(sum(r["mask"]) == 2 and len(r.embeds) == 16 for r in got)


def test_stream_equals_batch_and_restarts(spark, samples, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    samples.repartition(3).write.parquet(source)

    def transform(df):
        return df.select("idx", velocity_mse("v", F.array_repeat(F.lit(0.0), 4)).alias("loss"))

    def run():
        stream = stream_shards(spark, source, samples.schema, max_files=1)
        stream_prepare(stream, transform, sink, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(sink).collect()))

    first = run()
    assert first == sorted(map(tuple, transform(samples).collect()))
    assert run() == first
    samples.limit(2).withColumn("idx", F.lit(99).cast("bigint")).coalesce(1).write.mode("append").parquet(source)
    assert len(run()) == len(first) + 2


def test_scratch_folder_is_the_named_one(spark, tmp_path_factory):
    assert scratch.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["float16", "float64", ">f4", "int8"])
def test_decode_any_plain_npy(spark, tmp_path, order, dtype):
    array = np.array([[1, -2, 3], [4, 5, 6]], dtype=dtype, order=order)
    buffer = io.BytesIO()
    np.save(buffer, array)
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        add(tar, "0.x.npy", buffer.getvalue())
    row = decode_fields(tar_source(spark, str(tmp_path)), {"x": ("x.npy", "array<double>")}).head()
    assert row.x == [1.0, -2.0, 3.0, 4.0, 5.0, 6.0]


def test_encoded_arrays_are_npy_files(spark):
    rows = spark.createDataFrame([([1.5, 2.0],), ([],), (None,), ([3.0],)], "v array<double>")
    got = [r[0] for r in rows.select(encode_npy("v")).collect()]
    arrays = [None if b is None else np.load(io.BytesIO(b)) for b in got]
    assert arrays[2] is None and all(a.dtype == np.float16 for a in arrays if a is not None)
    assert [None if a is None else a.tolist() for a in arrays] == [[1.5, 2.0], [], None, [3.0]]


def archived(spark, shard, *keys):
    """What a task is given for a shard."""
    fields = F.create_map(F.lit("txt"), F.encode(F.lit("x"), "UTF-8"))
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select(F.lit(shard).alias("shard"), "key", fields.alias("fields"))
    return rows.toArrow().to_batches()


def test_a_write_that_stops_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select(F.col("id").alias("idx"), F.encode(F.lit("x"), "UTF-8").alias("x"))
    # The task is done, its archive is in place, and the commit never comes.
    tars.TarWriter(path, False).write(iter(archived(spark, 7, "a", "b")))
    assert (tmp_path / "t" / "shard-000007.tar").exists() and tar_source(spark, path).count() == 0
    with pytest.raises(Exception, match="not among the archives"):
        tar_source(spark, f"{path}/shard-000007.tar").count()
    tar_sink(rows, path, {"txt": "x"}, samples_per_shard=10)
    assert tar_source(spark, path).count() == 40
    more = rows.withColumn("idx", F.col("idx") + 70)
    tar_sink(more, path, {"txt": "x"}, samples_per_shard=10)
    assert tar_source(spark, path).count() == 80 and tar_source(spark, f"{path}/shard-{{000002..000003}}.tar").count() == 20
    with pytest.raises(Exception, match="overwrite"):
        tar_sink(more, path, {"txt": "x"}, samples_per_shard=10)
    assert tar_source(spark, path).count() == 80
    # Overwriting takes the old archives out of sight before it starts.
    writer = tars.TarWriter(path, True)
    done = writer.write(iter(archived(spark, 3, "a")))
    assert tar_source(spark, path).count() == 0
    writer.commit([done, None])
    assert tar_source(spark, path).count() == 1 and [p.name for p in (tmp_path / "t").glob("*.tar")] == ["shard-000003.tar"]
    writer = tars.TarWriter(path, False)
    done = [writer.write(iter(archived(spark, 5, "a"))) for _ in range(2)]
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit(done)
    writer.abort(done)
    assert tar_source(spark, path).count() == 1 and not list((tmp_path / "t").glob("*.part"))


def test_archives_of_others_are_read_and_kept(spark, tmp_path):
    with tarfile.open(tmp_path / "other-3.tar", "w") as tar:
        add(tar, "a.txt")
    rows = spark.range(4).select(F.col("id").alias("idx"), F.encode(F.lit("x"), "UTF-8").alias("x"))
    assert tar_source(spark, str(tmp_path)).count() == 1
    tar_sink(rows, str(tmp_path), {"txt": "x"}, samples_per_shard=2)
    assert tar_source(spark, str(tmp_path)).count() == 5


def test_a_large_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    content = {f"d{i % 3}/s{i:04d}": rng.bytes(int(rng.integers(0, 4000))) for i in range(300)}
    with tarfile.open(tmp_path / "big-12.tar", "w") as tar:
        for name, data in sorted(content.items()):
            add(tar, f"{name}.bin", data)
            add(tar, f"{name}.TXT", name.encode())
    members = index_members(spark, str(tmp_path))
    assert members.count() == 600
    found = read_members(members, bytes_per_task=50_000).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    assert {r.key: bytes(r.fields["bin"]) for r in rows} == content and len({r.task for r in rows}) > 3
    assert {r.shard for r in rows} == {12} and all(r.fields["txt"].decode() == r.key for r in rows)
    whole = {(r.key, tuple(sorted((k, bytes(v)) for k, v in r.fields.items()))) for r in tar_source(spark, str(tmp_path)).collect()}
    assert whole == {(r.key, tuple(sorted((k, bytes(v)) for k, v in r.fields.items()))) for r in rows}
    some = read_members(lookup_rows(members.filter("extension = 'txt'"), "key", ["d0/s0000", "d1/s0001", "none"])).collect()
    assert sorted((r.key, sorted(r.fields)) for r in some) == [("d0/s0000", ["txt"]), ("d1/s0001", ["txt"])]


def test_samples_that_share_a_key_stay_apart(spark, tmp_path):
    with tarfile.open(tmp_path / "a-7.tar", "w") as tar:
        for name in ("d/a.JPG", "d/a.seg.png", "e/a.jpg", "README", "d/a.jpg"):
            add(tar, name)
    rows = read_members(index_members(spark, str(tmp_path))).collect()
    assert sorted((r.shard, r.key, sorted(r.fields)) for r in rows) == [
        (7, "d/a", ["jpg"]), (7, "d/a", ["jpg", "seg.png"]), (7, "e/a", ["jpg"]),
    ]


def test_tensors_keep_their_shape(spark, tmp_path):
    rows = [(0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.1]]), (1, None), (2, []), (3, [[0.5]]), (4, [[], []])]
    df = spark.createDataFrame(rows, "idx bigint, v array<array<double>>").repartition(2)
    kept = df.withColumn("v", quantize_f16("v", depth=2)).select("idx", encode_npy("v", depth=2).alias("v"))
    tar_sink(kept.filter("v IS NOT NULL"), str(tmp_path / "t"), {"v.npy": "v"})
    got = {int(r.key): r for r in decode_fields(tar_source(spark, str(tmp_path / "t")), {
        "v": ("v.npy", "array<array<float>>"), "flat": ("v.npy", "array<double>")}).collect()}
    assert got[0].v == [[1.0, 2.0, 3.0], [4.0, 5.0, float(np.float16(6.1))]] and got[3].v == [[0.5]]
    assert got[2].v == [] and got[4].v == [[], []] and len(got[0].flat) == 6
    raw = {r.idx: r.v for r in kept.collect()}
    assert raw[1] is None and np.load(io.BytesIO(raw[0])).shape == (2, 3) and np.load(io.BytesIO(raw[0])).dtype == np.float16
    deep = spark.createDataFrame([([[[1.0, 2.0]], [[3.0, 4.0]]],)], "v array<array<array<double>>>")
    assert deep.select(quantize_f16("v", depth=3)).head()[0] == [[[1.0, 2.0]], [[3.0, 4.0]]]
    ragged = spark.createDataFrame([([[1.0], [2.0, 3.0]],)], "v array<array<double>>")
    with pytest.raises(Exception, match="equal length"):
        ragged.select(encode_npy("v", depth=2)).collect()


def test_filters_pass_through_the_functions(spark, samples, tmp_path):
    samples.write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).withColumn("h", quantize_f16("v"))
    plan = rows.filter("idx = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(idx,3)" in plan
    write_shards(samples, str(tmp_path / "s"), samples_per_shard=10)
    shards = spark.read.parquet(str(tmp_path / "s")).withColumn("n", encode_npy("v")).filter("shard = 1")
    assert "PartitionFilters: [isnotnull(shard" in shards._jdf.queryExecution().executedPlan().toString()
    exploded = rows.select("idx", F.explode(once("h")))
    assert exploded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert exploded.count() == rows.select(F.explode("h")).count() == 100


def test_listing_by_tasks(spark, tmp_path):
    for name in ("a/checkpoint_step_5.pt", "a/x.pt", "b/checkpoint_step_7.pt", "b/checkpoint_step_8.pt.part"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    rows = [(1, str(tmp_path / "a")), (2, f"file://{tmp_path}/b"), (3, str(tmp_path / "none")), (4, None)]
    found = list_manifest(spark, spark.createDataFrame(rows, "run int, place string"), "place")
    assert sorted((r.run, r.path.rpartition("/")[2], r.step) for r in found.collect()) == [(1, "checkpoint_step_5.pt", 5), (2, "checkpoint_step_7.pt", 7)]
    assert list_files(found.select("run").limit(0).withColumn("f", F.lit("x")), "f", "*").count() == 0


def test_a_stream_goes_on_with_its_index(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def add_rows(first, n):
        spark.range(first, first + n).select((1000 - F.col("id")).alias("k"), F.lit("x").alias("t")).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = stream_shards(spark, source, "k bigint, t string", max_files=1)
        stream_indexed(stream, lambda df: df.filter("k <> 995"), ["k"], sink, checkpoint, 8).awaitTermination()
        return sorted(tuple(r) for r in scan_indexed(spark, sink).select("idx", "key", "k", "shard", "batch").collect())

    add_rows(0, 10)
    add_rows(10, 5)
    first = go()
    assert [r[0] for r in first] == list(range(14)) and all(r[3] == r[0] // 8 and int(r[1]) == r[0] for r in first)
    assert go() == first
    add_rows(20, 7)
    second = go()
    assert second[:14] == first and [r[0] for r in second] == list(range(21)) and len({r[4] for r in second}) == 3
    # What a batch that stopped has written does not count, and is written anew.
    (tmp_path / "out" / "notes" / "batch=2").rename(tmp_path / "gone")
    assert sorted(r[0] for r in scan_indexed(spark, sink).select("idx").collect()) == list(range(14))


def gray(n, value):
    return (n, n, 1, bytes([value]) * (n * n))


def test_samples_of_images_and_captions(spark, tmp_path):
    kind = "id int, image struct<height: int, width: int, nChannels: int, data: binary>, text string"
    rows = [(i, gray(3 + i % 4, 10 * i), f"word {i}") for i in range(12)] + [(50, None, "no image"), (51, gray(2, 1), " ")]
    pairs = spark.createDataFrame(rows, kind).repartition(3)

    def images():
        return lambda x: x.reshape(len(x), 3, -1).mean(axis=2)

    def words():
        def predict(texts):
            mask = np.array([[1] * len(t.split()) + [0] * (3 - len(t.split())) for t in texts])
            return np.arange(3)[None, :, None] * np.ones((len(texts), 3, 2)) * mask[:, :, None], mask

        return predict

    path = str(tmp_path / "s")
    prepare_samples(pairs, "image", "text", ["id"], path, images, words, size=4, samples_per_shard=5)
    got = {int(r.key): r for r in decode_fields(tar_source(spark, path), SAMPLE_FIELDS).collect()}
    assert sorted(got) == list(range(12)) and {r.shard for r in got.values()} == {0, 1, 2}
    for i, r in got.items():
        assert r.latents == pytest.approx([(10 * i / 256 * 2 - 1) * 0.18215] * 3, abs=2e-4)
        assert r.embeds == [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]] and r["mask"] == [1, 1, 0]


def test_a_feed_serves_every_sample_once(spark, tar_folder):
    spec, names = {"n": ("label.cls", "int")}, {"n": ("n", "int"), "key": ("key", "string")}
    readers = [feed(spark, tar_folder, spec, names, 4, seed=1, rank=r, world=2).collect() for r in range(2)]
    seen = [s.key for rows in readers for b in rows for s in b.samples]
    assert sorted(seen) == [f"{i:08d}" for i in range(25)]
    first = sorted(readers[0])
    later = sorted(feed(spark, tar_folder, spec, names, 4, seed=1, rank=0, world=2, step=2).collect())
    assert later == first[2:]
    other = feed(spark, tar_folder, spec, names, 4, seed=1, epoch=1, rank=0, world=2).collect()
    assert [s.key for b in sorted(other) for s in b.samples] != [s.key for b in first for s in b.samples]
    few = feed(spark, tar_folder, spec, names, 4, seed=1, limit=6).collect()
    assert sum(b.n for b in few) == 6
