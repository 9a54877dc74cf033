"""A corpus prepared in stages: each reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import contamination, language, near, packing, repeats
from vecloom.llm.frames import stored
from vecloom.plans.catalog import table

STAGES = [
    ("language", language.stage),
    ("near_duplicates", near.stage),
    ("repeats", repeats.stage),
    ("decontamination", contamination.stage),
    ("packing", packing.stage),
]

# Language, tokens and packing are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
