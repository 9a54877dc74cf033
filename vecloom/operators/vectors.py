"""Operators on vector columns that need more than one row, or change the columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrays import doubles, total

# Fixed value: keeps the clip factor finite for a zero norm.
CLIP_EPS = 1e-6


def map_fields(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Keep, rename and cast: ``{"new": ("old", "array<float>")}``."""
    return df.select([F.col(old).cast(kind).alias(new) for new, (old, kind) in mapping.items()])


def extract_json(df: DataFrame, col: str, path: str, name: str) -> DataFrame:
    """Add one field of a JSON column; without the field, null."""
    return df.withColumn(name, F.get_json_object(col, path))


def zip_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Walk arrays side by side, one row each, up to the shortest.

    A row with a null array has nothing to walk and gives one row of nulls.
    """
    shortest = F.least(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])
    cut = [F.slice(F.col(c), 1, F.col("_shortest")).alias(c) for c in cols]
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    zipped = F.arrays_zip(*cols)
    nothing = F.array(F.struct(*[F.get(c, F.lit(0)).alias(c) for c in cols]))
    return (
        df.withColumn("_shortest", shortest)
        .select(*keep, *cut)
        .select(*keep, F.inline(F.when(present, zipped).otherwise(F.transform(nothing, lambda x: F.struct(*[F.nullif(x[c], x[c]).alias(c) for c in cols])))))
    )


def clip_norm(
    df: DataFrame, col: str, max_norm: float = 1.0, by: Sequence[str] | None = None
) -> DataFrame:
    """Scale vectors so that the norm of all of them together is at most ``max_norm``.

    Adds ``norm`` and replaces ``col``. With ``by`` each group has its own norm; rows
    whose group is null are a group too.
    """
    squares = total(F.transform(doubles(col), lambda x: x * x))
    norm = F.sqrt(F.sum(squares)).alias("norm")
    if by:
        norms = df.groupBy(*by).agg(norm).withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        with_norm = df.join(norms, same, "left").select(*df.columns, "norm")
    else:
        with_norm = df.withColumn("norm", df.agg(norm).scalar())
    factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / (F.col("norm") + CLIP_EPS))
    return (
        with_norm.withColumn("_factor", factor)
        .withColumn(col, F.transform(doubles(col), lambda x: x * F.col("_factor")))
        .drop("_factor")
    )
