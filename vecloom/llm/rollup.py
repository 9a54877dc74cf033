"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes has rows with a sign: an insert counts 1, a delete -1, and a
revision is a delete of the old row and an insert of the new one. A batch is counted,
summed by key and written to a folder of its own; totals are the sum over the
folders. Spark's success marker makes a folder count, and a batch that has one is
never counted again, so a batch may be sent any number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.frames import freed_shuffles
from vecloom.llm.registry import query
from vecloom.llm.tokens import VOCABULARY, Encoder
from vecloom.plans.catalog import table
from vecloom.scratch import fresh_path

# Name of a tokenizer version, and its vocabulary; without one, words between white space.
VERSIONS = {"byte_bpe_50k": VOCABULARY, "words": None}
KEY = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents bigint, tokens bigint"


def counted(changes: DataFrame, versions: Mapping[str, str | None]) -> DataFrame:
    """``source, lang, version, documents, tokens`` of each change, signed; a null text has no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = {name: Encoder(path) if path else None for name, path in versions.items()}
        for frame in batches:
            for name, encoder in encoders.items():
                if encoder is None:
                    tokens = [len(text.split()) if text else 0 for text in frame["text"]]
                else:
                    tokens = [len(encoder.packed(text)) // 4 for text in frame["text"]]
                rows = frame[["source", "lang"]].assign(version=name, documents=frame["sign"], tokens=frame["sign"] * tokens)
                # Summed here, so that few rows leave for the JVM.
                yield rows.groupby(KEY, dropna=False, as_index=False).sum().astype({c: object for c in KEY}).where(lambda x: x.notna(), None)

    return changes.select("source", "lang", "text", "sign").mapInPandas(count, SCHEMA)


class Rollup:
    """Totals in a folder, one folder of deltas inside per committed batch."""

    def __init__(self, spark: SparkSession, path: str, versions: Mapping[str, str | None] = VERSIONS) -> None:
        self.spark, self.path, self.versions = spark, path, dict(versions)

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"{batch!r} is no batch name")
        return f"{self.path}/batch={batch}"

    def _file_system(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(batch)}/_SUCCESS")
        return bool(self._file_system().exists(marker))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count and add a batch; False if it had been committed before. One writer per batch name.

        ``changes`` has ``source, lang, text`` and ``sign``. A write that stopped
        half-way left no marker, and is overwritten.
        """
        if self.committed(batch):
            return False
        deltas = counted(changes, self.versions).groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        with freed_shuffles(self.spark):
            deltas.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """Sums over committed batches. Keys with no document left are gone; null keys are keys."""
        spark, system = self.spark, self._file_system()
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        done = [f"{self.path}/{name}" for name in names if name.startswith("batch=") and self.committed(name[6:])]
        if not done:
            return spark.createDataFrame([], SCHEMA)
        rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*done)
        sums = rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")


def inserts(docs: DataFrame) -> DataFrame:
    return docs.select("source", "lang", "text", F.lit(1).cast("bigint").alias("sign"))


def deletes(docs: DataFrame) -> DataFrame:
    return docs.select("source", "lang", "text", F.lit(-1).cast("bigint").alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def copies(docs: DataFrame) -> DataFrame:
    """Rows whose text another row of a smaller id has. Null texts are no copies."""
    named = docs.filter("text is not null").withColumn("_name", F.sha2("text", 256))
    first = named.groupBy("_name").agg(F.min("doc_id").alias("_first"))
    return named.join(first, "_name").filter(F.col("doc_id") > F.col("_first")).drop("_name", "_first")


def without_stutter(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a line that repeats the line before, and the same rows without such lines."""
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: (i == 0) | (line != F.get(lines, i - 1)))
    changed = docs.withColumn("_less", F.array_join(kept, "\n")).filter(F.col("_less") != F.col("text"))
    return changed.drop("_less"), changed.withColumn("text", F.col("_less")).drop("_less")


def maintained(spark: SparkSession, docs: DataFrame, versions: Mapping[str, str | None]) -> DataFrame:
    """Totals after all documents arrived, exact copies left and stutters were revised; each batch is sent twice."""
    rollup = Rollup(spark, fresh_path(spark, "rollup"), versions)
    gone = copies(docs)
    left = docs.join(gone.select("doc_id"), "doc_id", "left_anti")
    old, new = without_stutter(left)
    for _ in range(2):
        rollup.commit("arrival", inserts(docs))
        rollup.commit("copies", deletes(gone))
        rollup.commit("stutters", revisions(old, new))
    return rollup.totals()


@query("op8_token_rollup")
def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(spark, table(spark, sf_dir, "documents"), VERSIONS)


@query(
    "token_rollup_words",
    """with k as (select *, row_number() over (partition by text order by doc_id) copy from documents),
l as (select source, lang, string_split(text, chr(10)) l from k where copy = 1),
t as (select source, lang, array_to_string(list_filter(l, lambda x, i: i = 1 or x <> l[i-1]), chr(10)) t from l)
select source, lang, 'words' AS version, count(*)::BIGINT documents, sum(len(regexp_extract_all(t, '\\S+')))::BIGINT tokens
from t group by all""",
)
def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(spark, table(spark, sf_dir, "documents"), {"words": None})
