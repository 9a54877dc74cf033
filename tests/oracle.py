"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _kind(name: str) -> str:
    names = {"int64": "bigint", "int32": "int", "double": "double", "string": "string", "bool": "boolean"}
    return names.get(name, name)


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True) if len(frame) else frame


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What tells the two results apart; empty if nothing does."""
    expected = connection.sql(sql).to_arrow_table()
    kinds = {f.name: f.dataType.simpleString() for f in result.schema}
    wanted = {f.name: _kind(str(f.type)) for f in expected.schema}
    problems = [f"types: {kinds} and {wanted}"] if kinds != wanted else []
    got, want = _sorted(result.toPandas()), _sorted(expected.to_pandas())
    if got.shape != want.shape:
        return [*problems, f"shape: {got.shape} and {want.shape}"]
    for name in got.columns.intersection(want.columns):
        a, b = got[name], want[name]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            at = bad.idxmax()
            problems.append(f"{name}: {bad.sum()} of {len(a)} differ, first {got.loc[at].to_dict()} and {want.loc[at].to_dict()}")
    return problems
