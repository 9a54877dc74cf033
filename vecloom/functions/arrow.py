"""Arrow list columns as numpy matrices and back, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


# Arrow counts the elements of a list column in 32 bits.
MAX_ELEMENTS = (1 << 31) - 1


def vector_udf(kind: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    """An Arrow UDF of the library: deterministic, so filters on other columns reach the scan through it."""

    def wrap(fn: Callable[..., pa.Array]) -> Callable[..., Column]:
        return F.arrow_udf(fn, kind)

    return wrap


def user_udf(kind: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    """An Arrow UDF that calls a user's function, which may be costly: Spark evaluates it once for a row."""

    def wrap(fn: Callable[..., pa.Array]) -> Callable[..., Column]:
        return F.arrow_udf(fn, kind).asNondeterministic()

    return wrap


def once(col: Column | str) -> Column:
    """The column, evaluated once where an explode follows.

    Spark infers a filter from an explode, pushes it down and so evaluates the exploded
    function a second time. It moves no filter past a number that depends on the row's
    place; that is why this is not part of the functions themselves.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.monotonically_increasing_id() >= 0, col)


def map_leaves(column: pa.Array, fn: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A list column of any depth with ``fn`` applied to its elements; lists and nulls stay as they are."""
    if not pa.types.is_list(column.type):
        return fn(column)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    inner = map_leaves(column.flatten(), fn)
    return pa.ListArray.from_arrays(list_offsets(np.cumsum(lengths)), inner, mask=column.is_null())


def tensor_rows(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, tuple[int, ...]] | None]]:
    """Elements of a list column of any depth, and where each row's begin with the shape it has.

    The lists of a row have to be of equal length at each level; null elements are NaN.
    """
    present = np.asarray(column.is_valid())
    levels = []
    while pa.types.is_list(column.type):
        if levels and column.null_count:
            raise ValueError("a tensor has no null lists inside")
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
        levels.append((lengths, np.concatenate([[0], np.cumsum(lengths)])))
        column = column.flatten()
    out: list[tuple[int, tuple[int, ...]] | None] = []
    for row, there in enumerate(present):
        first, count, shape = row, 1, []
        for lengths, starts in levels:
            sizes = lengths[first : first + count]
            if count and (sizes != sizes[0]).any():
                raise ValueError("the lists of a tensor must be of equal length")
            size = int(sizes[0]) if count else 0
            shape.append(size)
            first, count = int(starts[first]), count * size
        out.append((first, tuple(shape)) if there else None)
    return column.to_numpy(zero_copy_only=False), out


def tensor_lists(arrays: list[np.ndarray | None], depth: int, type_: pa.DataType) -> pa.Array:
    """Arrays of ``depth`` axes as nested lists, null where there is none."""
    shapes = [a.shape if a is not None else (0,) * depth for a in arrays]
    flat = [a.reshape(-1) for a in arrays if a is not None]
    out = pa.array(np.concatenate(flat) if flat else np.zeros(0)).cast(type_)
    for level in range(depth - 1, 0, -1):
        outer = np.array([int(np.prod(s[:level])) for s in shapes], np.int64)
        lengths = np.repeat([s[level] for s in shapes], outer)
        out = pa.ListArray.from_arrays(list_offsets(np.cumsum(lengths)), out)
    lengths = np.array([s[0] for s in shapes], np.int64)
    return pa.ListArray.from_arrays(list_offsets(np.cumsum(lengths)), out, mask=pa.array([a is None for a in arrays], pa.bool_()))


def list_type(element: str, depth: int) -> str:
    """Spark's name of a list of lists of lists of an element."""
    return "array<" * depth + element + ">" * depth


def to_matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as float64, with a flag per row saying it is present.

    Absent rows are left out of the matrix. All present rows must be of one length.
    """
    present = np.asarray(column.is_valid())
    kept = column.drop_null()
    if len(kept) == 0:
        return np.empty((0, dim or 0)), present
    flat = kept.flatten()
    width, rest = divmod(len(flat), len(kept))
    lengths = np.diff(np.asarray(kept.offsets))
    if rest or (lengths != width).any() or (dim is not None and width != dim):
        raise ValueError("vectors of one column must all have the same length")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(kept), width), present


def to_lists(matrix: np.ndarray, present: np.ndarray, type_: pa.DataType) -> pa.Array:
    """Matrix rows as a list column, null where a row was absent."""
    width = matrix.shape[1]
    ends = np.cumsum(present) * width
    values = pa.array(matrix.reshape(-1)).cast(type_)
    return pa.ListArray.from_arrays(list_offsets(ends), values, mask=pa.array(~present))


def list_offsets(ends: np.ndarray) -> pa.Array:
    """Offsets of lists that end at ``ends``."""
    if len(ends) and ends[-1] > MAX_ELEMENTS:
        raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch for vectors this wide")
    return pa.array(np.concatenate([[0], ends]).astype(np.int32))


def scatter(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """One number per present row, null elsewhere."""
    out = np.zeros(len(present))
    out[present] = values
    return pa.array(out, mask=~present)
