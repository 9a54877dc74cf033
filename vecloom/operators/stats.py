"""Statistics of losses and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrays import doubles
from vecloom.functions.arrow import to_matrix
from vecloom.functions.draws import sample_noise
from vecloom.operators.sampling import INFERENCE_STEPS, VelocityField, euler_sample, velocity_loss

# Rows and columns of a block of a moment matrix, and tasks whose blocks meet first.
BLOCK = 1024
MERGED = 128
# Entries of all matrices a task holds before it passes them on (1 GiB of doubles).
MAX_HELD = 1 << 27


def _groups(table: pa.Table, names: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of ``names`` in a table, each with the rows that have them."""
    if not names:
        yield (), np.arange(table.num_rows)
        return
    labels = table.select(list(names))
    codes = labels.to_pandas().groupby(list(names), dropna=False, sort=False).ngroup().to_numpy()
    first = np.unique(codes, return_index=True)[1]
    for code, row in enumerate(labels.take(pa.array(first)).to_pylist()):
        yield tuple(row.values()), np.flatnonzero(codes == code)


def _number_state(x: np.ndarray) -> tuple:
    """Count, mean, sum of squared deviations, least and greatest; NaN is the greatest number."""
    mean = x.mean()
    least = np.fmin.reduce(x)
    return len(x), mean, np.square(x - mean).sum(), least, x.max()


def _joined(a: Column, b: Column) -> Column:
    """The state of two disjoint sets of numbers from theirs."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"),
    )


def tensor_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min, mean, max and sample deviation over all elements, one row per tensor and group.

    Null arrays and elements do not count; a tensor without elements in a group has no
    row, one with a single element no deviation. A batch leaves one state (count, mean,
    sum of squared deviations, least, greatest) per tensor and group; states of a group
    are joined one by one, which loses no digits to a mean far from zero.
    """
    names = list(by)
    source = df.select(*by, *[doubles(c).alias(f"_v{n}") for n, c in enumerate(cols)])
    groups = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record_batch in batches:
            table = pa.Table.from_batches([record_batch])
            types = [table.schema.field(n).type for n in names]
            found: list[tuple] = []
            for group, rows in _groups(table, names) if table.num_rows else ():
                part = table.take(pa.array(rows)) if names else table
                for n, tensor in enumerate(cols):
                    numbers = pc.drop_null(pc.list_flatten(part.column(f"_v{n}").combine_chunks()))
                    if len(numbers):
                        found.append((*group, tensor, *_number_state(numbers.to_numpy())))
            columns = list(zip(*found)) if found else [[]] * (len(names) + 6)
            kinds = [*types, pa.string(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(columns, kinds)], [*names, "tensor", "n", "mean", "m2", "min", "max"]
            )

    schema = ", ".join([*groups, "tensor string, n bigint, mean double, m2 double, min double, max double"])
    parts = source.mapInArrow(states, schema)
    whole = parts.groupBy(*by, "tensor").agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sort_array(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "mean", "m2"))).alias("_states"),
    )
    first, rest = F.get("_states", F.lit(0)), F.slice("_states", 2, F.greatest(F.size("_states") - 1, F.lit(1)))
    total = F.when(F.size("_states") == 1, first).otherwise(F.aggregate(rest, first, _joined))
    joined = whole.withColumn("_total", total)
    std = F.when(F.col("_total.n") > 1, F.sqrt(F.col("_total.m2") / (F.col("_total.n") - 1)))
    return joined.select(*by, "tensor", "min", F.col("_total.mean").alias("mean"), "max", std.alias("std"))


def batch_mean_loss(
    df: DataFrame, batch: str, loss: str, by: Sequence[str] = (), row_weighted: bool = False
) -> DataFrame:
    """Mean of the batch means: a short batch weighs as much as a full one."""
    if row_weighted:
        return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"))
    batches = df.groupBy(*by, batch).agg(F.avg(loss).alias("_loss"))
    return batches.groupBy(*by).agg(F.avg("_loss").alias("mean_loss"))


def accumulate_loss(df: DataFrame, step: str, loss: str, k: int) -> DataFrame:
    """Loss of a step: the sum of its micro-batches' losses, each divided by ``k``."""
    return df.groupBy(step).agg(F.sum(F.col(loss) / F.lit(float(k))).alias("step_loss"))


def mean_vector(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean, as an all-reduce of gradients gives it. Vectors meet as partial sums."""
    vectors = df.filter(F.col(col).isNotNull()).select(*by, array_to_vector(doubles(col)).alias("_v"))
    return vectors.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean_vector"))


class Moments:
    """Count, mean and centred products of a set of vectors; sets can be joined."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, matrix: np.ndarray) -> Moments:
        mean = matrix.mean(axis=0)
        centred = matrix - mean
        return cls(len(matrix), mean, centred.T @ centred)

    def join(self, other: Moments) -> None:
        """Take in another set. The means' distance joins the two centres, so no digits are lost far from zero."""
        n = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products
        self.products += np.outer(apart * (self.n * other.n / n), apart)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n


class Block:
    """The part of ``Moments`` in some rows and columns."""

    def __init__(self, n: int, down: np.ndarray, across: np.ndarray, products: np.ndarray) -> None:
        self.n, self.down, self.across = n, down, across
        self.products = products.reshape(len(down), len(across))

    def join(self, other: Block) -> None:
        n = self.n + other.n
        down, across = other.down - self.down, other.across - self.across
        self.products = self.products + other.products + np.outer(down * (self.n * other.n / n), across)
        self.down, self.across = self.down + down * (other.n / n), self.across + across * (other.n / n)
        self.n = n


STATE = "widths array<int>, task int, i int, j int, n bigint, down array<double>, across array<double>, products array<double>"
_NUMBERS = pa.list_(pa.float64())


def _state_row(labels: list[pa.Array], names: list[str], widths: list[int], task: int, i: int, j: int, block: Block) -> pa.RecordBatch:
    numbers = [pa.array([a], _NUMBERS) for a in (block.down, block.across, block.products.reshape(-1))]
    places = [pa.array([v], pa.int32()) for v in (task, i, j)]
    arrays = [*labels, pa.array([widths], pa.list_(pa.int32())), *places, pa.array([block.n], pa.int64()), *numbers]
    return pa.RecordBatch.from_arrays(arrays, [*names, "widths", "task", "i", "j", "n", "down", "across", "products"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, int, Block]]:
    """Each row of states: its batch, row, place and block."""
    for batch in batches:
        values = {c: batch.column(c) for c in ("i", "j", "n")}
        lists = [batch.column(c) for c in ("down", "across", "products")]
        for row in range(batch.num_rows):
            block = Block(values["n"][row].as_py(), *(c[row].values.to_numpy(zero_copy_only=False) for c in lists))
            yield batch, row, values["i"][row].as_py(), values["j"][row].as_py(), block


def moment_states(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), partials: int | None = None, side: int = BLOCK
) -> DataFrame:
    """Joint moments of the arrays ``cols``, one after another, as blocks on and above the diagonal.

    Columns: ``by``, ``widths`` of the arrays, block ``i``, ``j``, ``n``, the means ``down``
    its rows and ``across`` its columns, and ``products``, its centred products row by row.
    Rows with a null array do not count. A task holds one set of moments a group, so the
    shuffle carries blocks instead of vectors and a large group costs no more than a
    small one; blocks of ``MERGED`` tasks meet first, and ``whole_moments`` joins what is
    left, so no task reads all tasks' matrices. ``partials`` limits the tasks.
    """
    names = list(by)
    source = df.select(*by, *[doubles(c).alias(f"_v{n}") for n, c in enumerate(cols)])
    source = source.dropna(subset=[f"_v{n}" for n in range(len(cols))])
    if partials is not None:
        source = source.coalesce(partials)
    source = source.withColumn("_task", F.spark_partition_id())
    groups = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names]
    schema = ", ".join([*groups, STATE])

    def rows_of(held: dict[tuple, Moments], types: list[pa.DataType], widths: list[int], task: int) -> Iterator[pa.RecordBatch]:
        for group, m in held.items():
            labels = [pa.array([g], type=t) for g, t in zip(group, types)]
            cuts = [slice(a, a + side) for a in range(0, len(m.mean), side)]
            for i, down in enumerate(cuts):
                for j, across in enumerate(cuts[i:], i):
                    block = Block(m.n, m.mean[down], m.mean[across], m.products[down, across])
                    yield _state_row(labels, names, widths, task // MERGED, i, j, block)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types, widths, task = [], [], 0
        for record_batch in batches:
            table = pa.Table.from_batches([record_batch])
            if not table.num_rows:
                continue
            types, task = [table.schema.field(n).type for n in names], table.column("_task")[0].as_py()
            arrays = [to_matrix(table.column(f"_v{n}").combine_chunks())[0] for n in range(len(cols))]
            widths = [a.shape[1] for a in arrays]
            matrix = np.hstack(arrays)
            for group, rows in _groups(table, names):
                new = Moments.of(matrix[rows] if names else matrix)
                if group in held:
                    held[group].join(new)
                else:
                    held[group] = new
                if len(held) * matrix.shape[1] ** 2 > MAX_HELD:
                    yield from rows_of(held, types, widths, task)
                    held.clear()
        yield from rows_of(held, types, widths, task)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, labels, widths = None, [], []
        for batch, row, _, _, block in _blocks(batches):
            if total is None:
                total, labels = block, [batch.column(n).slice(row, 1) for n in names]
                widths = batch.column("widths")[row].as_py()
            else:
                total.join(block)
        *_, task, i, j = (k.as_py() for k in key)
        yield _state_row(labels, names, widths, task, i, j, total)

    return source.mapInArrow(states, schema).groupBy(*by, "task", "i", "j").applyInArrow(merged, schema)


def whole_moments(batches: Iterator[pa.RecordBatch], side: int = BLOCK) -> tuple[list[int], Moments]:
    """Widths and moments of one group from its states, inside a task: one matrix, and a block at a time."""
    total: dict[tuple[int, int], Block] = {}
    widths: list[int] = []
    for batch, row, i, j, block in _blocks(batches):
        widths = batch.column("widths")[row].as_py()
        if (i, j) in total:
            total[i, j].join(block)
        else:
            total[i, j] = block
    width = sum(widths)
    mean, products = np.zeros(width), np.zeros((width, width))
    for (i, j), block in total.items():
        down, across = slice(i * side, i * side + len(block.down)), slice(j * side, j * side + len(block.across))
        mean[down] = block.down
        products[down, across] = block.products
        products[across, down] = block.products.T
    return widths, Moments(total[0, 0].n if total else 0, mean, products)


def vector_moments(
    df: DataFrame, col: str, by: Sequence[str] = (), partials: int | None = None
) -> DataFrame:
    """Row count, mean vector and sample covariance (NaN for one row), one row per group."""
    names = list(by)
    states = moment_states(df, [col], by, partials)
    groups = [f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema if f.name in names]

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        _, m = whole_moments(chain([first], batches))
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = m.products / (m.n - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cov) + 1, dtype=np.int32) * len(cov)), pa.array(cov.reshape(-1)))
        whole = pa.ListArray.from_arrays(pa.array([0, len(cov)], pa.int32()), lists)
        labels = [first.column(n).slice(0, 1) for n in names]
        yield pa.RecordBatch.from_arrays([*labels, pa.array([m.n], pa.int64()), pa.array([m.mean], _NUMBERS), whole], [*names, "n", "mean", "cov"])

    schema = ", ".join([*groups, "n bigint, mean array<double>, cov array<array<double>>"])
    return states.groupBy(*by).applyInArrow(finish, schema)


def frechet_distance(
    df1: DataFrame, df2: DataFrame, col: str, partials: int | None = None
) -> DataFrame:
    """Fréchet distance of the normal distributions fitted to two sets of vectors; null if one has no row.

    The trace of the root of S1 S2 is that of R S2 R with R the root of S1, which
    is symmetric, so its eigenvalues are real.
    """
    sides = df1.select(F.lit(1).alias("_side"), col).unionByName(df2.select(F.lit(2).alias("_side"), col))

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {1: [], 2: []}
        for batch in batches:
            marks = batch.column("_side").to_numpy()
            for mark, own in parts.items():
                own.append(batch.filter(pa.array(marks == mark)))
        if not all(sum(b.num_rows for b in own) for own in parts.values()):
            return
        (a, s1), (b, s2) = ((m.mean, m.products / (m.n - 1)) for m in (whole_moments(iter(own))[1] for own in parts.values()))
        values, vectors = np.linalg.eigh(s1)
        root = (vectors * np.sqrt(values.clip(min=0.0))) @ vectors.T
        cross = np.sqrt(np.linalg.eigvalsh(root @ s2 @ root).clip(min=0.0)).sum()
        value = np.sum((a - b) ** 2) + np.trace(s1) + np.trace(s2) - 2.0 * cross
        yield pa.RecordBatch.from_arrays([pa.array([value])], ["frechet_distance"])

    states = moment_states(sides, [col], ["_side"], partials)
    found = states.groupBy().applyInArrow(distance, "frechet_distance double")
    return found.agg(F.first("frechet_distance").alias("frechet_distance"))


def frechet_diagonal(df1: DataFrame, df2: DataFrame, col: str) -> DataFrame:
    """The same with all covariances between elements left out."""
    sides = df1.select(F.lit(1).alias("_side"), col).unionByName(df2.select(F.lit(2).alias("_side"), col))
    vectors = sides.filter(F.col(col).isNotNull()).select("_side", array_to_vector(doubles(col)).alias("_v"))
    moments = vectors.groupBy("_side").agg(
        Summarizer.metrics("mean", "variance").summary(F.col("_v")).alias("_m")
    )

    def pick(side: int, field: str) -> Column:
        value = F.when(F.col("_side") == side, vector_to_array(F.col(f"_m.{field}")))
        return F.first(value, ignorenulls=True).alias(f"{field}{side}")

    both = moments.agg(*[pick(s, f) for s in (1, 2) for f in ("mean", "variance")])
    means = F.zip_with("mean1", "mean2", lambda a, b: (a - b) * (a - b))
    deviations = F.zip_with("variance1", "variance2", lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2))
    value = F.aggregate(F.concat(means, deviations), F.lit(0.0), lambda acc, x: acc + x)
    return both.select(value.alias("frechet_diagonal"))


def evaluate(
    df: DataFrame,
    key: str,
    col: str,
    dim: int,
    v_fn: VelocityField,
    batch_size: int = 128,
    n: int = INFERENCE_STEPS,
    seed: int = 0,
    context: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Mean evaluation loss (null without rows) and one generated sample per row.

    ``df`` has an index column ``idx``; batches are runs of ``batch_size`` indexes.
    """
    extra = [F.col(c) for c in context]
    drawn = df.select(
        F.floor(F.col("idx") / batch_size).alias("batch_id"),
        velocity_loss(F.col(key), F.col(col), dim, v_fn, seed, extra).alias("loss"),
    )
    start = sample_noise(F.col(key), dim, seed, "generate")
    samples = df.withColumn("generated", euler_sample(start, v_fn, n, extra))
    return batch_mean_loss(drawn, "batch_id", "loss"), samples
