"""Registered queries, each next to the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column) -> Column:
    """Six places, and no negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def weighted(col: Column) -> Column:
    """Sum of position times element: tells orders apart, as a plain sum would not."""
    pairs = F.transform(col, lambda x, i: (i + 1) * x.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def elements_sql(columns: str = "", dim: int = 64) -> str:
    """Embeddings, one row per element; ``i`` counts from 1."""
    extra = f", {columns}" if columns else ""
    return f"select vec_id, label, i::BIGINT i, embedding[i]::DOUBLE x{extra} from embeddings, range(1, {dim + 1}) r(i)"


def time_sql(key: str, seed: int = 0, tag: str = "time") -> str:
    return f"('0x'||substr(md5('{seed}:{tag}:'||{key}),1,8))::BIGINT/4294967296.0::DOUBLE"


def noise_sql(source: str, key: str, dim: int, seed: int = 0, tag: str = "noise") -> str:
    """Query of (key, i, z): the normal draws of each key of ``source``."""
    digest = f"md5('{seed}:{tag}:'||{key})"
    modulus = "18446744073709551616::UHUGEINT"
    return f"""
select {key}, (2*p-1+h)::BIGINT i,
  case h when 0 then r*cos(a) else r*sin(a) end z
from (select {key}, p,
    sqrt(-2*ln(((x >> 32)::DOUBLE+0.5::DOUBLE)/4294967296.0::DOUBLE)) r,
    2*pi()*(((x % 4294967296::UHUGEINT)::DOUBLE+0.5::DOUBLE)/4294967296.0::DOUBLE) a
  from (select {key}, p, xor(x, x >> 31) x
    from (select {key}, p, (xor(x, x >> 27)*10723151780598845931::UHUGEINT) % {modulus} x
      from (select {key}, p, (xor(x, x >> 30)*13787848793156543929::UHUGEINT) % {modulus} x
        from (select {key}, p,
            (('0x'||substr({digest},1,15))::BIGINT::UHUGEINT
             + p::UHUGEINT*(2*('0x'||substr({digest},16,15))::BIGINT::UHUGEINT+1)) % {modulus} x
          from {source}, range(1, {(dim + 1) // 2 + 1}) q(p)))))), range(2) hh(h)
where 2*p-1+h <= {dim}"""


def drawn_sql(seed: int = 0) -> str:
    """CTE ``d``: element, noise and time of each embedding."""
    return f"""e as ({elements_sql()}), nz as ({noise_sql('embeddings', 'vec_id', 64, seed)}),
d as (select e.vec_id, label, e.i, x, z noise, {time_sql('e.vec_id', seed)} t
  from e join nz on e.vec_id = nz.vec_id and e.i = nz.i)"""


def tokens_sql(source: str, key: str, text: str = "text") -> str:
    return (
        f"select {key}, list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '') t from {source}"
    )


TOKEN_ID = "(('0x'||substr(md5(w),1,8))::BIGINT % 32000 + 1)"
