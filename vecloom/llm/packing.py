"""Documents packed into sequences by linear grouping and best fit.

A packing depends on lengths only, and there are at most ``CAPACITY`` of them. So
the plan is made from a histogram: large lengths are rounded up to the greatest of
their group, groups having equally many pieces; a linear program over configurations
of these few sizes, its columns found by a knapsack, says how often to use each;
actual pieces take the places, and what is left is put where it fits best, the
longest first. What rounding up wastes is won back by repairs: the least filled
sequences are emptied, others swap pieces for longer ones of these, and the rest is
filled in again. The plan is a table of runs: pieces of a length, by rank, go to
consecutive sequences. Its size depends on the capacity, not on the corpus.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.frames import stored
from vecloom.llm.registry import query
from vecloom.llm.tokens import VOCABULARY, Encoder
from vecloom.plans.catalog import table

CAPACITY = 2048
END = (0).to_bytes(4, "little")
# Groups of equally many large pieces; a piece is large from an eighth of the capacity on.
GROUPS = 128
LARGE = CAPACITY // 8
# The linear program ends within this share of its optimum.
GAP = 0.002
# Rounds of repair, and shares of the sequences that they empty in turn.
REPAIRS = 48
SHARES = (0.01, 0.03, 0.1, 0.3)
# Pieces of one length and slice, ranked in one task.
SLICE_ROWS = 50_000

Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each row: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and a closing 0; a null or empty text the 0 alone. Longer
    ones are cut into full pieces, the first being the shorter one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for frame in batches:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                data = encoder.packed(text) + END
                n = len(data) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc, i, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, and its counts; item by item, as few fit."""
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = room >= 0
    room = np.where(fits, room, 0)
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        values = np.where(fits, best[room] + worth[:, None], -1)
        choice = values.argmax(axis=0)
        value = values[choice, np.arange(capacity + 1)]
        choices.append(np.where(value > 0, choice, -1))
        best = np.maximum(value, 0)
    counts, left = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(choices):
        if choice[left] >= 0:
            counts[choice[left]] += 1
            left -= int(sizes[choice[left]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration, rounded down: the simplex method with columns on demand."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + GAP:
            break
        use, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand)
    return [(int(x + 1e-6), basis[:, i].astype(np.int64)) for i, x in enumerate(use) if x >= 1 - 1e-6]


class Pool:
    """Pieces that wait for a place: how many there are of each length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = [0] * (capacity + 1)
        self.sorted: list[int] = []
        for length, count in counts.items():
            self.add(length, count)

    def add(self, length: int, count: int) -> None:
        if count and not self.n[length]:
            bisect.insort(self.sorted, length)
        self.n[length] += count

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.sorted[bisect.bisect_left(self.sorted, length)]

    def longest(self, most: int) -> int:
        """The longest piece of at most ``most``; 0 if there is none."""
        at = bisect.bisect_right(self.sorted, most)
        return self.sorted[at - 1] if at else 0


class Plan:
    """Sequences by content, made from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> None:
        self.capacity = capacity
        self.counts = {n: c for n, c in counts.items() if c}
        # How many sequences hold which lengths.
        self.kinds: Counter[tuple[int, ...]] = Counter()
        pool = Pool(self.counts, capacity)
        self._group({n: c for n, c in self.counts.items() if large < n}, groups, pool)
        self._fill(pool)
        self._repair()
        self.sequences = sum(self.kinds.values())

    def _group(self, counts: dict[int, int], groups: int, pool: Pool) -> None:
        total = sum(counts.values())
        if not total:
            return
        # Equal shares of the pieces from the longest on; a share is named by its longest.
        share = -(-total // min(groups, max(8, total // 16)))
        queues: list[list[list[int]]] = [[]]
        filled = 0
        for n in sorted(counts, reverse=True):
            rest = counts[n]
            while rest:
                if filled == share:
                    queues.append([])
                    filled = 0
                take = min(rest, share - filled)
                queues[-1].append([n, take])
                rest -= take
                filled += take
        by_size: dict[int, list[list[int]]] = {}
        for q in queues:
            by_size.setdefault(q[0][0], []).extend(q)
        sizes = np.array(sorted(by_size, reverse=True))
        demand = np.array([sum(c for _, c in by_size[int(s)]) for s in sizes], float)
        for times, column in configurations(sizes, demand, self.capacity):
            spans: list[tuple[tuple[int, ...], int]] = [((), times)]
            for k in np.repeat(np.arange(len(sizes)), column):
                queue = by_size[int(sizes[k])]
                after = []
                for held, count in spans:
                    while count and queue:
                        length, there = queue[0]
                        take = min(count, there)
                        pool.take(length, take)
                        after.append(((*held, length), take))
                        queue[0][1] -= take
                        if not queue[0][1]:
                            queue.pop(0)
                        count -= take
                    if count:
                        after.append((held, count))
                spans = after
            for held, count in spans:
                self._add(held, count)

    def _add(self, held: tuple[int, ...], count: int) -> None:
        if held and count:
            self.kinds[tuple(sorted(held, reverse=True))] += count

    def _fill(self, pool: Pool) -> None:
        """Put all that waits where it fits best, the longest first; open sequences for what fits nowhere."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for held, count in self.kinds.items():
            open_.setdefault(self.capacity - sum(held), []).append((held, count))
        rooms = sorted(open_)

        def release(held: tuple[int, ...], count: int) -> None:
            room = self.capacity - sum(held)
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((held, count))

        while length := pool.longest(self.capacity):
            count = pool.n[length]
            pool.take(length, count)
            while count:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    each = self.capacity // length
                    if count >= each:
                        release((length,) * each, count // each)
                    if count % each:
                        release((length,) * (count % each), 1)
                    break
                room = rooms[at]
                held, n = open_[room].pop()
                take = min(n, count)
                release((*held, length), take)
                if take < n:
                    open_[room].append((held, n - take))
                if not open_[room]:
                    del open_[room]
                    rooms.remove(room)
                count -= take
        self.kinds = Counter()
        for found in open_.values():
            for held, count in found:
                self._add(held, count)

    def _swap(self, pool: Pool) -> None:
        """Give sequences longer pieces for shorter ones, as far as there is room: what waits gets shorter."""
        found = sorted(self.kinds.items(), key=lambda kind: sum(kind[0]))
        self.kinds = Counter()
        while found:
            held, count = found.pop()
            room = self.capacity - sum(held)
            gain, out, into = 0, 0, 0
            for length in {0, *held} if room else ():
                longer = pool.longest(length + room)
                if longer - length > gain:
                    gain, out, into = longer - length, length, longer
            if not gain:
                self._add(held, count)
                continue
            take = min(count, pool.n[into])
            pool.take(into, take)
            if out:
                pool.add(out, take)
            changed = list(held)
            if out:
                changed.remove(out)
            found.append((tuple(sorted((*changed, into), reverse=True)), take))
            if take < count:
                found.append((held, count - take))

    def _waste(self, kinds: Counter) -> tuple[int, int]:
        """Sequences, and how evenly their room is spread: room in one place is worth more than a little everywhere."""
        return sum(kinds.values()), -sum(count * (self.capacity - sum(held)) ** 2 for held, count in kinds.items())

    def _repair(self) -> None:
        """Empty sequences, swap what they held for shorter pieces elsewhere and fill again, and keep what is better.

        Rounds empty growing shares, of those with most room or nearly so, and end at the
        least possible number of sequences. The choice is seeded: equal counts give equal plans.
        """
        least = -(-sum(n * c for n, c in self.counts.items()) // self.capacity)
        best, chance = self.kinds, np.random.default_rng(0)
        for trial in range(REPAIRS):
            if sum(best.values()) <= least:
                break
            share = SHARES[trial % len(SHARES)]
            pool = Pool({}, self.capacity)
            found = sorted(best)
            blur = chance.random(len(found)) * (self.capacity * share * (trial % 2))
            order = np.argsort([sum(held) for held in found] + blur, kind="stable")
            emptied = max(2, int(share * sum(best.values())))
            self.kinds = Counter(best)
            for held in map(found.__getitem__, order.tolist()):
                gone = min(best[held], emptied)
                emptied -= gone
                self.kinds[held] -= gone
                for length in held if gone else ():
                    pool.add(length, gone)
            self.kinds = Counter({held: count for held, count in self.kinds.items() if count})
            self._swap(pool)
            self._fill(pool)
            if self._waste(self.kinds) < self._waste(best):
                best = self.kinds
        self.kinds = best

    @property
    def runs(self) -> list[Run]:
        """Pieces of a length, by rank, in consecutive sequences."""
        out: list[Run] = []
        taken = dict.fromkeys(self.counts, 0)
        first = 0
        for held, count in sorted(self.kinds.items()):
            offset = 0
            for length in held:
                out.append((length, taken[length], count, first, offset))
                taken[length] += count
                offset += length
            first += count
        return out


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of at most ``capacity``.

    ``found`` has to be stored: it is read for the histogram, the ranks and the result.
    """
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    runs = np.array(sorted(Plan(counts, capacity).runs) or np.zeros((0, 5)), np.int64)
    keys = (runs[:, 0] << 44) | runs[:, 1]
    slices = -(-max(counts.values(), default=1) // SLICE_ROWS)
    order = [c for c in ("doc_id", "piece") if c in found.columns]
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("length", "_slice").count().select(
        "length", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_slice").orderBy(*order)
    ranked = (
        sliced.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["length", "_slice"])
        .select(*found.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            length, rank = frame["length"].to_numpy(np.int64), frame["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            yield frame.drop(columns="_rank").assign(sequence_id=runs[at, 3] + rank - runs[at, 1], offset=runs[at, 4])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "sequence_id bigint, offset bigint"])
    return ranked.mapInPandas(place, schema)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows and their places. A repeated row is packed as often as it stands."""
    return packed(stored(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
