"""Phrase mining: runs of words that stand together more often than their parts would.

Every (language, word) of enough occurrences is a unit. Units are ranked by frequency,
and adjacent ranks are counted by direct address: a pair lies in the tile of its two
ranks' high bits, a tile with many occurrences is counted by one dense bincount of the
low bits, the others as sorted coordinates. The frequent pairs are ranked anew, and
adjacent pairs, which overlap in a word, are counted the same way, and so on up.

Ranks are given to at most ``RANKED`` units of each level, those of the highest counts;
this table goes to every task. Any further frequent unit is known by its hash behind a
filter of fixed size and is counted as coordinates, so no unit is left out. Counts of
tasks meet in a shuffle by phrase; a false hit of the filter falls below the least count.

Null texts are empty, null languages ``und``. Texts without words give nothing but their
share of ``n``, a language without a candidate no row. Pieces of any length are read
whole, long texts in runs of pieces. Repeated rows count each time. Ties go by the order
stated in ``top``. Columns other than language and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.frames import mixed, stored
from vecloom.llm.registry import query
from vecloom.plans.catalog import table

# Language of rows without one; least occurrences; longest phrase; share, in
# percent, of its occurrences that a phrase may lose to a longer one; rows kept a language.
NO_LANG = "und"
MIN_COUNT = 10
MAX_WORDS = 3
ABSORBED = 50
TOP = 2000
# Fixed rule: A-Z become a-z, ends of pieces a full stop, white space within one a space.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else ord(".") if c in _PIECE_ENDS else 32 if c == 9 else c for c in range(256)
)

# Units of a level that are ranked: a table of so many numbers goes to every task.
RANKED = 1 << 20
# Bits of the filter of units beyond these, and how it is cut for building.
FILTER_BITS = 1 << 26
SEGMENT_BITS = 1 << 16
# Ranks along a side of a tile, and occurrences that make it dense.
SIDE_BITS = 10
DENSE = 1 << 16
# Pairs a task counts at once, bytes of text it splits at once, words it remembers.
AT_ONCE = 1 << 20
BLOB = 1 << 20
REMEMBERED = 400_000
# Slices of a language in the choice of its first rows.
SLICES = 64
# Hashes of units to try until one tells all apart.
SEEDS = 8
# Steps a doubling in the histogram that finds the least count of a ranked unit.
STEPS = 16

NONE = -1


class Units(dict):
    """Numbers the words of one language among all that a task has met; number 0 ends a piece."""

    def __init__(self, lang: bytes, met: list) -> None:
        self.lang, self.met = lang, met
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.met)
        self.met.append((self.lang, word))
        return number


def unit_hash(lang: bytes, word: bytes, seed: int) -> int:
    """62 bits, so that its negative fits beside ranks."""
    return xxhash.xxh3_64_intdigest(len(lang).to_bytes(4, "little") + lang + word, seed) >> 2


class Reader:
    """Word numbers of texts, remembered until there are too many."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.met: list = [None]
        self.langs: dict[bytes, Units] = {}

    def runs(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Numbers of words, 0 between pieces, in runs that cut no piece."""
        langs = pc.fill_null(batch.column(0), NO_LANG).cast(pa.binary()).to_pylist()
        held: dict[bytes, list[bytes]] = {}
        sizes: dict[bytes, int] = {}
        for lang, text in zip(langs, batch.column(1).cast(pa.binary())):
            raw = text.as_py()
            if raw:
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] > BLOB:
                    sizes[lang] = 0
                    yield from self._numbers(lang, held.pop(lang))
        for lang, texts in held.items():
            yield from self._numbers(lang, texts)

    def _numbers(self, lang: bytes, texts: list[bytes]) -> Iterator[np.ndarray]:
        plain = b".".join(texts).translate(PLAIN)
        start = 0
        while start < len(plain):
            end = plain.find(b".", start + BLOB) if len(plain) - start > 2 * BLOB else len(plain)
            end = len(plain) if end < 0 else end
            words = plain[start:end].replace(b".", b" . ").split()
            start = end
            if len(self.met) > REMEMBERED:
                self.forget()
            known = self.langs.get(lang) or self.langs.setdefault(lang, Units(lang, self.met))
            yield np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """Columns lang, word, unit and n, one row per language and word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, totals = Reader(), np.zeros(0, np.int64)

        def settled(met: list) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(totals[1:]) + 1
            for some in np.array_split(at, len(at) // BLOB + 1):
                units = [met[i] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for lang, _ in units], pa.binary()),
                        pa.array([word for _, word in units], pa.binary()),
                        pa.array([unit_hash(*u, seed) for u in units], pa.int64()),
                        pa.array(totals[some]),
                    ],
                    ["lang", "word", "unit", "n"],
                )

        met = reader.met
        for batch in batches:
            for numbers in reader.runs(batch):
                if reader.met is not met:
                    yield from settled(met)
                    met, totals = reader.met, np.zeros(0, np.int64)
                found = np.bincount(numbers, minlength=len(totals))
                found[: len(totals)] += totals
                totals = found
        yield from settled(met)

    parts = docs.mapInArrow(count, "lang binary, word binary, unit bigint, n bigint")
    whole = parts.groupBy("lang", "word").agg(F.first("unit").alias("unit"), F.sum("n").alias("n"))
    return whole.select(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "unit", "n")


class Level:
    """What a task knows of the frequent units of a level: ranked ones, and a filter of the rest."""

    def __init__(self, hashes: np.ndarray, members: np.ndarray, bits: np.ndarray | None, seed: int = 0) -> None:
        """``hashes`` and ``members`` (the ids of their words, a column a word) go by rank."""
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.members = members
        self.bits = bits
        self.seed = seed

    def _hit(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, and whether there is one."""
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return self.order[at], self.sorted[at] == hashes

    def _rest(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of unranked units: their hash as a negative number, or none."""
        if self.bits is None:
            return np.full(len(hashes), NONE)
        at = hashes & (FILTER_BITS - 1)
        here = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return np.where(here.astype(bool), -2 - hashes, NONE)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        rank, hit = self._hit(hashes)
        return np.where(hit, rank, self._rest(hashes))

    def phrases(self, words: np.ndarray) -> np.ndarray:
        """Ids of phrases given by their words' ids, a column a word. Equal hashes are told apart."""
        hashes = phrase_hash(words, self.seed)
        rank, hit = self._hit(hashes)
        if len(self.members):
            hit &= (self.members[rank] == words).all(axis=1)
        return np.where(hit, rank, self._rest(hashes))


def phrase_hash(words: np.ndarray, seed: int = 0) -> np.ndarray:
    """62 bits from the ids of the words."""
    out = np.full(len(words), seed, np.uint64)
    for k in range(words.shape[1]):
        out = mixed(out ^ words[:, k].astype(np.int64).view(np.uint64), k + 1)
    return (out >> np.uint64(2)).astype(np.int64)


def tiled(left: np.ndarray, right: np.ndarray, ranks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of pairs of ranks: dense tiles by bincount of the address inside, the rest sorted."""
    side, low = 1 << SIDE_BITS, (1 << SIDE_BITS) - 1
    across = (ranks >> SIDE_BITS) + 1
    tile = (left >> SIDE_BITS) * across + (right >> SIDE_BITS)
    dense = np.bincount(tile, minlength=1) >= DENSE
    crowded = dense[tile]
    at = np.flatnonzero(crowded)
    at = at[np.argsort(tile[at], kind="stable")]
    for own in np.split(at, np.flatnonzero(np.diff(tile[at])) + 1):
        if len(own):
            cells = np.bincount((left[own] & low) << SIDE_BITS | right[own] & low, minlength=side * side)
            used = np.flatnonzero(cells)
            high_left, high_right = divmod(int(tile[own[0]]), across)
            yield (high_left << SIDE_BITS) + (used >> SIDE_BITS), (high_right << SIDE_BITS) + (used & low), cells[used]
    width = ranks + 1
    codes = np.sort(left[~crowded] * width + right[~crowded])
    if len(codes):
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        yield codes[starts] // width, codes[starts] % width, np.diff(np.append(starts, len(codes)))


class Counter:
    """Counts the phrases of ``len(levels) + 1`` words that a task meets."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels, self.size = levels, len(levels) + 1
        # Ranks of word tables and of phrase tables share one width.
        self.ranks = max(len(level.sorted) for level in levels)
        self.pairs: list[np.ndarray] = []
        self.loose: list[np.ndarray] = []
        self.held = 0

    def add(self, words: np.ndarray) -> None:
        """Take in a run of word ids, ``NONE`` where a phrase cannot go on."""
        ids = words
        for level, below in enumerate(self.levels[1:], 2):
            at = np.flatnonzero((ids[:-1] != NONE) & (ids[1:] != NONE))
            longer = np.full(max(len(ids) - 1, 0), NONE)
            longer[at] = below.phrases(np.stack([words[at + k] for k in range(level)], axis=1))
            ids = longer
        left, right = ids[:-1], ids[1:]
        both = (left != NONE) & (right != NONE)
        ranked = (left >= 0) & (right >= 0)
        self.pairs.append(np.stack([left[ranked], right[ranked]]))
        at = np.flatnonzero(both & ~ranked)
        if len(at):
            self.loose.append(np.stack([words[at + k] for k in range(self.size)], axis=1))
        self.held += int(both.sum())

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Columns w1, w2, ... and n of all taken in since the last call."""
        names = [*(f"w{k + 1}" for k in range(self.size)), "n"]
        pairs = np.concatenate(self.pairs, axis=1) if self.pairs else np.zeros((2, 0), np.int64)
        top = self.levels[-1].members
        for left, right, n in tiled(pairs[0], pairs[1], self.ranks) if pairs.size else ():
            columns = [*top[left].T, top[right][:, -1], n]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)
        if self.loose:
            rows, n = np.unique(np.concatenate(self.loose), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*rows.T.copy(), n]], names)
        self.pairs, self.loose, self.held = [], [], 0


def phrase_counts(docs: DataFrame, levels: list[Level], seed: int, min_count: int) -> DataFrame:
    """Columns w1, w2, ... (ids of words) and n of the phrases one word longer than the last level's."""
    size = len(levels) + 1
    known = docs.sparkSession.sparkContext.broadcast(levels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, reader = Counter(known.value), Reader()
        met, ids = reader.met, np.full(1, NONE)
        for batch in batches:
            for numbers in reader.runs(batch):
                if reader.met is not met:
                    met, ids = reader.met, np.full(1, NONE)
                new = met[len(ids) :]
                hashes = np.fromiter((unit_hash(*u, seed) for u in new), np.int64, len(new))
                ids = np.concatenate([ids, known.value[0].words(hashes)])
                counter.add(ids[np.append(numbers, 0)])
                if counter.held > AT_ONCE:
                    yield from counter.settle()
        yield from counter.settle()

    words = [f"w{k + 1}" for k in range(size)]
    parts = docs.mapInArrow(count, ", ".join(f"{c} bigint" for c in [*words, "n"]))
    return parts.groupBy(*words).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _filter(rest: DataFrame, hashed: Column) -> np.ndarray | None:
    """A bit for every hash of ``rest``, built in segments of fixed size."""
    spots = rest.select((hashed % FILTER_BITS).alias("_spot"))
    spots = spots.select((F.col("_spot") / SEGMENT_BITS).cast("int").alias("segment"), (F.col("_spot") % SEGMENT_BITS).cast("int").alias("bit"))

    def packed(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        for some in found:
            bits[some.column("bit").to_numpy()] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([raw], pa.binary())], ["segment", "bits"])

    segments = spots.distinct().groupBy("segment").applyInArrow(packed, "segment int, bits binary").collect()
    if not segments:
        return None
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    width = SEGMENT_BITS // 8
    for segment in segments:
        out[segment["segment"] * width : (segment["segment"] + 1) * width] = np.frombuffer(segment["bits"], np.uint8)
    return out


def _step() -> Column:
    """A coarse logarithm of the count, which grows with it."""
    return F.floor(F.log2("n") * STEPS)


def _ranked(found: DataFrame, keys: list[str], limit: int) -> tuple[np.ndarray, DataFrame | None]:
    """``keys`` of the most frequent units by rank, at most ``limit`` of them, and the units beyond."""
    steps = found.groupBy(_step().alias("step")).agg(F.count("*").alias("units")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["units"]
        if total > limit:
            break
        least = row["step"]
    beyond = None if total <= limit else found if least is None else found.filter(_step() < least)
    if least is None:
        return np.zeros((0, len(keys)), np.int64), beyond
    first = found.filter(_step() >= least).select("n", *keys).toArrow()
    n, *columns = (np.asarray(first.column(c), np.int64) for c in ["n", *keys])
    order = np.lexsort([*columns[::-1], -n])
    return np.stack([c[order] for c in columns], axis=1), beyond


def word_level(words: DataFrame, limit: int) -> Level:
    rows, beyond = _ranked(words, ["unit"], limit)
    bits = None if beyond is None else _filter(beyond, F.col("unit"))
    return Level(rows[:, 0], np.arange(len(rows))[:, None], bits)


def phrase_level(found: DataFrame, names: list[str], limit: int) -> Level:
    rows, beyond = _ranked(found, names, limit)
    # A ranked phrase has a hash of its own among the ranked.
    seed = next(s for s in range(SEEDS) if len(np.unique(phrase_hash(rows, s))) == len(rows))

    @F.pandas_udf("bigint")
    def hashed(*columns: pd.Series) -> pd.Series:
        return pd.Series(phrase_hash(np.stack([c.to_numpy() for c in columns], axis=1), seed))

    bits = None if beyond is None else _filter(beyond, hashed(*names))
    return Level(phrase_hash(rows, seed), rows, bits, seed)


def with_ids(words: DataFrame, level: Level) -> DataFrame:
    """Words with the id by which phrases name them."""
    known = words.sparkSession.sparkContext.broadcast(level)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = known.value.words(np.asarray(batch.column("unit"), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "id"])

    return words.mapInArrow(name, "lang string, word string, unit bigint, n bigint, id bigint")


def counts(docs: DataFrame, max_words: int, min_count: int, ranked: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words met per language, and tables of frequent words (lang, word, id, n) and of frequent phrases of each length."""
    for seed in range(SEEDS):
        met = stored(word_counts(docs, seed), "words")
        if met.groupBy("unit").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no hash tells all words apart")
    totals = met.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = met.filter(F.col("n") >= min_count)
    levels = [word_level(frequent, ranked)]
    tables = [stored(with_ids(frequent, levels[0]).select("lang", "word", F.col("id").alias("w1"), "n"), "words")]
    for size in range(2, max_words + 1):
        tables.append(stored(phrase_counts(docs, levels, seed, min_count), f"phrases-{size}"))
        if size < max_words:
            levels.append(phrase_level(tables[-1], [f"w{k + 1}" for k in range(size)], ranked))
    return totals, tables


def _renamed(found: DataFrame, first: int, value: str) -> DataFrame:
    """A table of phrases as it is joined from word ``first`` of a longer one on."""
    size = len([c for c in found.columns if c.startswith("w") and c != "word"])
    return found.select(*[F.col(f"w{k + 1}").alias(f"w{k + first}") for k in range(size)], F.col("n").alias(value))


def scored(tables: list[DataFrame], size: int) -> DataFrame:
    """Phrases of ``size`` words with lang, phrase, a, l, r and score, and the ids of their words."""
    out = tables[size - 1].withColumnRenamed("n", "a")
    cuts = []
    for k in range(1, size):
        for part, first, value in ((tables[k - 1], 1, f"_l{k}"), (tables[size - k - 1], k + 1, f"_r{k}")):
            side = _renamed(part, first, value)
            out = out.join(side, [c for c in side.columns if c != value])
        big = "cast({} as decimal(38,0))"
        score = F.expr(f"({big.format(1000000)} * a * a) div ({big.format(f'_l{k}')} * _r{k})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    for k in range(1, size + 1):
        names = tables[0].select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"_t{k}"), *([F.col("lang")] if k == 1 else []))
        out = out.join(names, f"w{k}")
    cut = F.array_min(F.array(*cuts)).alias("_cut")
    phrase = F.concat_ws(" ", *[f"_t{k}" for k in range(1, size + 1)]).alias("phrase")
    ids = [f"w{k}" for k in range(1, size + 1)]
    return out.select(*ids, "lang", phrase, "a", cut).select(*ids, "lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def unabsorbed(phrases: DataFrame, longer: DataFrame, size: int, absorbed: int) -> DataFrame:
    """Drop phrases that stand inside a longer one too often.

    A longer phrase's own parts are at least as frequent, so one more word is enough to look at.
    """
    names = [f"w{k + 1}" for k in range(size)]
    inside = [longer.select(*[F.col(f"w{k + first}").alias(f"w{k + 1}") for k in range(size)], "n") for first in (1, 2)]
    most = inside[0].unionByName(inside[1]).groupBy(*names).agg(F.max("n").alias("_most"))
    joined = phrases.join(most, names, "left")
    return joined.filter(F.coalesce(F.col("_most") * 100 < F.col("a") * absorbed, F.lit(True))).drop("_most")


def top(found: DataFrame, rows: int) -> DataFrame:
    """The first rows of each language by score, count and phrase; first of slices, so no task sees all of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    few = sliced.withColumn("_place", first).filter(F.col("_place") <= rows).drop("_slice", "_place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return few.withColumn("rank", rank).filter(F.col("rank") <= rows)


def mined(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    absorbed: int = ABSORBED,
    rows: int = TOP,
    ranked: int = RANKED,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n and score.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts of the cut that scores least.
    """
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    totals, tables = counts(docs, max_words, min_count, ranked)
    found = None
    for size in range(2, max_words + 1):
        phrases = scored(tables, size)
        if size < max_words:
            phrases = unabsorbed(phrases, tables[size], size, absorbed)
        phrases = phrases.select("lang", "phrase", "a", "l", "r", "score")
        found = phrases if found is None else found.unionByName(phrases)
    chosen = top(found, rows).join(totals, "lang")
    return chosen.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _sql() -> str:
    """The definition, read plainly."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    big = "1000000::HUGEINT*a*a"
    return f"""
with p as (select coalesce(lang, '{NO_LANG}') lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') t from p),
n as (select lang, sum(len(t)) n from w group by 1),
f as (select lang, k size, t[i:i+k-1] words, count(*) f
  from w, range(1, {MAX_WORDS + 1}) s(k), unnest(range(1, len(t)-k+2)) r(i) where len(t) >= k group by all having count(*) >= {MIN_COUNT}),
c as (select g.lang, g.size, g.words, g.f a, x.f l, y.f r, ({big.replace('a', 'g.f')})//(x.f::HUGEINT*y.f) score, x.size k
  from f g join f x on x.lang = g.lang and x.size < g.size and x.words = g.words[1:x.size]
  join f y on y.lang = g.lang and y.size = g.size-x.size and y.words = g.words[x.size+1:g.size]),
b as (select * from c qualify row_number() over (partition by lang, words order by score, k) = 1),
i as (select lang, words[j:j+len(words)-2] words, max(f) f from f, range(1, 3) r(j) where len(words) > 2 group by all),
z as (select b.*, array_to_string(b.words, ' ') phrase from b left join i on b.lang = i.lang and b.words = i.words
  where coalesce(100*i.f < {ABSORBED}*a, true)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) place from z)
select o.lang, place AS rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT score
from o join n on o.lang = n.lang where place <= {TOP}"""


@query("op12_phrases", _sql())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))
