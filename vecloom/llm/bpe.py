"""Byte-level BPE: text to token ids and back.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is
itself a token; it maps each entry to a place of its own among exactly as many places,
so a look-up is two reads and one comparison. Any other pre-token is a linked list of
its bytes, and a heap of neighbouring pairs yields the merge of least rank, the leftmost
of equal ones, until none is left.

A null or empty text has no ids; equal texts have equal ids. Long texts go through in
runs of ``PIECES`` pre-tokens, so memory holds a text and its ids, and a long pre-token
takes time in proportion to its length times the heap's depth. Other columns pass by
untouched.
"""

from __future__ import annotations

import base64
import itertools
import operator
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.frames import Numbered, mixed
from vecloom.llm.registry import query
from vecloom.llm.tokens import NOT_SIMPLE, SIMPLE
from vecloom.plans.catalog import table

VOCABULARY = "byte_bpe_50k.tiktoken"
# Keys that share a displacement, on average.
PER_BUCKET = 4
# Displacements tried at once.
TRIES = 256
# Pre-tokens taken from a text at once, and distinct ones a task remembers.
PIECES = 1 << 16
REMEMBERED = 500_000
# Pre-tokens whose ids are looked up together.
WAITING = 1 << 17
# Bytes of text, and rows of ids, that leave a task together.
PART_BYTES = 4 << 20
ROWS_AT_ONCE = 512
# Longer texts are not cut into pre-tokens in one go.
LONG = 1 << 20


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each key."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """Places ``n`` keys on ``0..n-1`` without a gap.

    Keys are dealt to buckets; large buckets first, each takes the first displacement
    that puts all its keys on free places. Buckets of one key name their place.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // PER_BUCKET)
        # A bucket's displacement, or minus one less the place of its only key.
        self.moves = np.zeros(self.buckets, np.int64)
        self.order = np.zeros(self.n, np.int64)
        if len(set(keys)) < self.n:
            raise ValueError("keys must differ")
        if not keys:
            return
        deal, place = _hashes(keys)
        bucket = (deal % np.uint64(self.buckets)).astype(np.int64)
        sizes = np.bincount(bucket, minlength=self.buckets)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(sizes)[:-1])
        free = np.ones(self.n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            own = members[b]
            if len(own) < 2:
                break
            for first in itertools.count(0, TRIES):
                at = self._places(place[own][:, None], np.arange(first, first + TRIES))
                low = np.sort(at, axis=0)
                fits = free[at].all(axis=0) & (low[1:] != low[:-1]).all(axis=0)
                if fits.any():
                    found = int(fits.argmax())
                    self.moves[b] = first + found
                    free[at[:, found]] = False
                    self.order[at[:, found]] = own
                    break
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            at = next(left)
            self.moves[b] = -1 - at
            self.order[at] = members[b][0]

    def _places(self, place: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (mixed(place ^ (moves.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(max(self.n, 1))).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """The number of the only entry that each key can be."""
        deal, place = _hashes(keys)
        moves = self.moves[(deal % np.uint64(self.buckets)).astype(np.int64)]
        return self.order[np.where(moves < 0, -1 - moves, self._places(place, np.maximum(moves, 0)))]


class Vocabulary:
    """Tokens with their ranks, which are their ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.places = PerfectHash(self.tokens)
        self.pairs = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """Ids of the pieces that are tokens, -1 for the others."""
        if not pieces or not self.tokens:
            return np.full(len(pieces), -1)
        at = self.places(pieces)
        same = np.fromiter(map(operator.eq, map(self.tokens.__getitem__, at.tolist()), pieces), bool, len(pieces))
        return np.where(same, self.ids[at], -1)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece by merging neighbours of least rank, the leftmost first."""
        rank_of, pairs, n = self.ranks.get, self.pairs, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        # An entry is one number: rank, start, end.
        width = n + 1
        square = width * width
        heap = [r * square + i * width + i + 2 for i in range(n - 1) if (r := pairs[piece[i] << 8 | piece[i + 1]]) is not None]
        heapify(heap)
        while heap:
            i, end = divmod(heappop(heap) % square, width)
            right = ends[i]
            # A part that is gone ends at 0; one that has grown no longer gives this merge.
            if not right or right == n or ends[right] != end:
                continue
            ends[i] = end
            ends[right] = 0
            if end < n:
                before[end] = i
                far = ends[end]
                if (r := rank_of(piece[i:far])) is not None:
                    heappush(heap, r * square + i * width + far)
            left = before[i]
            if left >= 0 and (r := rank_of(piece[left:end])) is not None:
                heappush(heap, r * square + left * width + end)
        out, i = [], 0
        while i < n:
            end = ends[i]
            out.append(self.ranks[piece[i:end]])
            i = end
        return out


@lru_cache(maxsize=4)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """Read from the installed package, which names the place of each file."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


class Encoder:
    """Encodes texts; a distinct pre-token goes through the tiers once until the memory is full."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.split = regex.compile(public_tokenizers.PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        simple = not NOT_SIMPLE.search(text)
        pattern = SIMPLE if simple else self.split
        if len(text) <= LONG:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(itertools.islice(found, PIECES)):
            yield some

    def _resolve(self) -> None:
        """Ids of the pre-tokens numbered since the last call."""
        new = [p.encode() for p in itertools.islice(self.known, len(self.sizes), None)]
        if not new:
            return
        whole = self.vocab.whole(new)
        sizes = np.ones(len(new), np.int64)
        merged = {}
        for i in np.flatnonzero(whole < 0).tolist():
            merged[i] = self.vocab.merged(new[i])
            sizes[i] = len(merged[i])
        ends = np.cumsum(sizes)
        flat = np.zeros(ends[-1], np.uint32)
        single = whole >= 0
        flat[ends[single] - 1] = whole[single]
        for i, ids in merged.items():
            flat[ends[i] - sizes[i] : ends[i]] = ids
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers, little-endian."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle() -> None:
            self._resolve()
            for i, codes in waiting:
                sizes = self.sizes[codes]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(self.starts[codes] - (ends - sizes), sizes)
                out[i].append(self.flat[at].astype("<u4").tobytes())
            waiting.clear()

        for i, text in enumerate(texts):
            for pieces in self._pieces(text) if text else ():
                waiting.append((i, np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))))
                held += len(pieces)
                if held > WAITING or len(self.known) > REMEMBERED:
                    settle()
                    held = 0
                    if len(self.known) > REMEMBERED:
                        self._forget()
        settle()
        return [b"".join(parts) for parts in out]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PART_BYTES`` of text, one text at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    part = (np.cumsum(lengths) - lengths) // PART_BYTES
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lengths)]
    for a, b in zip(starts, starts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def encoded(docs: DataFrame, keep: list[str], text: str = "text", ids: str = "ids", name: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``: 32-bit little-endian numbers, in the text's order."""
    vocab = vocabulary(name)
    # Positions, not names, tell the columns apart.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Encoder(vocab)
        for batch in batches:
            for some in _parts(batch, len(keep)):
                found = pa.array(one(some.column(len(keep)).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], found], names=[*some.schema.names[:-1], "ids"])

    kinds = [f"k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    out = inner.mapInArrow(encode, ", ".join([*kinds, "ids binary"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids))


def decoded(ids: Column | str, name: str = VOCABULARY) -> Column:
    """The bytes that packed ids stand for. An id outside the vocabulary is an error."""
    tokens = {i: t for t, i in vocabulary(name).ranks.items()}

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(value: bytes) -> bytes:
            numbers = np.frombuffer(value, "<u4")
            some = (numbers[i : i + PIECES].tolist() for i in range(0, len(numbers), PIECES))
            return b"".join(b"".join(map(tokens.__getitem__, part)) for part in some)

        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                yield pa.array([one(v.as_py()) if v.is_valid else None for v in some], pa.binary())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded("ids"), 256).alias("decoded_sha256"),
    )
