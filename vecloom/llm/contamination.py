"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity.

For every benchmark item each document is read in windows of the item's size, in
shingles of five words. A window that could reach the similarity gets a SimHash of
64 bits. Of the items of its size, those are candidates that agree with it in some
block of ``BLOCK_BITS`` bits but for ``FLIPS``: with 16 blocks, every fingerprint
within ``RADIUS`` bits is found. The weighted shingles decide.

A window can only reach the similarity if enough of its shingles stand in items of
its size; counting those first is exact, as the similarity of others is lower. A
text with fewer shingles than an item, but enough for the similarity, is one window
for the item: it may be the item without some of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.frames import mixed
from vecloom.llm.registry import query
from vecloom.llm.shingles import WordHashes, shingles, word_hashes
from vecloom.plans.catalog import table

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCK_BITS = 4
FLIPS = 1
# At a similarity of 0.8, five standard deviations above the mean of differing bits.
RADIUS = 24
# Items held in every task at a time; more are taken in blocks.
ITEMS_AT_ONCE = 20_000
SIEVE_BITS = 22

assert RADIUS < (FLIPS + 1) * (BITS // BLOCK_BITS)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def simhash(values: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingles, repeats counting as often as they stand: ``(windows, size)``."""
    votes = np.zeros((values.shape[0], BITS), np.int32)
    places = np.arange(BITS, dtype=np.uint64)
    for j in range(values.shape[1]):
        votes += ((mixed(values[:, j], 3)[:, None] >> places) & np.uint64(1)).astype(np.int32)
    ones = 2 * votes > values.shape[1]
    return (ones.astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it stands."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


@dataclass
class SizeClass:
    """Items of one number of shingles."""

    ids: list = field(default_factory=list)
    rows: list = field(default_factory=list)

    def freeze(self) -> None:
        self.values = np.array(self.rows, np.uint64)
        self.known = np.unique(self.values)
        self.prints = simhash(self.values)
        size = self.values.shape[1]
        # Two windows of one size share at least so many shingles.
        self.least = self.shared(size)
        blocks = BITS // BLOCK_BITS
        nibble = np.arange(1 << BLOCK_BITS)
        distance = np.array([bin(i).count("1") for i in nibble])
        self.tables = []
        for b in range(blocks):
            own = (self.prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            self.tables.append(distance[nibble[:, None] ^ own[None, :]] <= FLIPS)

    def shared(self, n: int) -> int:
        """The fewest shingles that a window of ``n`` shares with an item like it."""
        return int(np.ceil(SIMILARITY * (n + self.values.shape[1]) / (1 + SIMILARITY) - 1e-9))

    def near(self, fingerprint: int) -> np.ndarray:
        """Items within ``RADIUS`` bits of a fingerprint."""
        hit = np.zeros(len(self.ids), bool)
        for b, rows in enumerate(self.tables):
            hit |= rows[(fingerprint >> (b * BLOCK_BITS)) & ((1 << BLOCK_BITS) - 1)]
        at = np.flatnonzero(hit)
        differing = self.prints[at] ^ np.uint64(fingerprint)
        return at[np.array([int(x).bit_count() <= RADIUS for x in differing], bool)] if len(at) else at


class Index:
    """A block of benchmark items. Items of fewer than five words match texts of the same words only."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        known = WordHashes()
        self.sizes: dict[int, SizeClass] = {}
        self.short: dict[int, list] = {}
        for item, text in items:
            words = word_hashes(text, known)
            found = shingles(words, SHINGLE)
            if 0 < len(words) < SHINGLE:
                self.short.setdefault(int(found[0]), []).append(item)
            elif len(words):
                sized = self.sizes.setdefault(len(found), SizeClass())
                sized.ids.append(item)
                sized.rows.append(found)
        every = [np.zeros(0, np.uint64)]
        for sized in self.sizes.values():
            sized.freeze()
            every.append(sized.known)
        self.known = np.unique(np.concatenate(every))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.known >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Best window of each item: similarity, first word, number of words."""
        best: dict[int, tuple[float, int, int]] = {}
        found = shingles(words, SHINGLE)
        if 0 < len(words) < SHINGLE:
            return {item: (1.0, 0, len(words)) for item in self.short.get(int(found[0]), [])}
        maybe = np.flatnonzero(self.sieve[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        maybe = maybe[among(found[maybe], self.known)]
        if not len(maybe):
            return best
        for size, sized in self.sizes.items():
            # A text shorter than the items is one window as a whole.
            width = min(size, len(found))
            least = sized.least if width == size else sized.shared(width)
            if width < least or len(maybe) < least:
                continue
            own = maybe[among(found[maybe], sized.known)]
            if len(own) < least:
                continue
            marks = np.zeros(len(found) + 1, np.int64)
            marks[own + 1] = 1
            total = np.cumsum(marks)
            starts = np.flatnonzero(total[width:] - total[:-width] >= least)
            # Equal windows are judged once, so a passage repeated many times costs little.
            judged: dict[bytes, list[tuple[int, float]]] = {}
            for part in np.array_split(starts, len(starts) // 4096 + 1):
                rows = found[part[:, None] + np.arange(width)]
                for start, row, fingerprint in zip(part.tolist(), rows, simhash(rows).tolist()):
                    name = row.tobytes()
                    if name not in judged:
                        judged[name] = [(i, weighted_similarity(row, sized.values[i])) for i in sized.near(fingerprint)]
                    for i, similarity in judged[name]:
                        item = sized.ids[i]
                        if similarity >= SIMILARITY and (item not in best or similarity > best[item][0]):
                            best[item] = (similarity, start, width + SHINGLE - 1)
        return best


def item_blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[Index]:
    """The benchmark as indexes of about ``at_once`` items, one after the other."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    blocks = -(-items.count() // at_once)
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark passage it holds, with the best window.

    Columns ``doc_id, item_id, similarity, first_word, n_words``. Null, empty and
    blank texts hold none; neither do null or blank items stand anywhere. A
    repeated row is reported as often as it stands.
    """
    out = None
    for index in item_blocks(benchmark):

        def find(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            for frame in batches:
                rows = [
                    (doc, item, *facts)
                    for doc, text in zip(frame["doc_id"], frame["text"])
                    for item, facts in index.hits(word_hashes(text, known)).items()
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(
            find, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint")
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    for index in item_blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([not index.hits(word_hashes(t, known)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
