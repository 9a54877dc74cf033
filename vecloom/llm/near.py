"""Near duplicates: fast similarity sketches, banding, exact confirmation.

A sketch has ``COORDS`` coordinates. In round i every element of the set is hashed
to a bin and a value; a bin keeps the least (round, value). From round ``COORDS``
on, round by round one given bin takes the least element, so every bin fills. Most
sets are full after a few rounds, and then stop.

Texts with equal sets become one class before any banding. Bands of ``ROWS``
coordinates make buckets of classes. A bucket is never multiplied out: all members
are compared with its pivot, and written as differences from it. Two that are not
both linked to the pivot can only be linked if they share many of these, so members
are joined by the first elements of their differences, under a bound that is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.frames import mixed, stored
from vecloom.llm.registry import query
from vecloom.llm.shingles import WordHashes, distinct, shingles, word_hashes
from vecloom.plans.catalog import table

COORDS = 128
# At a similarity of 0.8 the chance that no band of 32 agrees is below 1e-7.
ROWS = 4
SIMILARITY = 80
ROUND_BITS = 20
# Steps from a bucket to its pivot.
CLIMBS = 2


def sketch_sets(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Sketches of non-empty sets, ``(sets, coords)``."""
    n = len(sets)
    out = np.full(n * coords, np.iinfo(np.uint64).max, np.uint64)
    live = np.arange(n)
    for i in range(2 * coords):
        if not len(live):
            break
        elements = np.concatenate([sets[j] for j in live])
        owner = np.repeat(live, [len(sets[j]) for j in live])
        h = mixed(elements, i + 1)
        bins = h % np.uint64(coords) if i < coords else np.full(len(h), i - coords, np.uint64)
        value = (np.uint64(i) << np.uint64(64 - ROUND_BITS)) | (h >> np.uint64(ROUND_BITS))
        np.minimum.at(out, owner * coords + bins.astype(np.int64), value)
        full = out.reshape(n, coords)[live] != np.iinfo(np.uint64).max
        live = live[~full.all(axis=1)]
    return out.reshape(n, coords)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One number per band, the band's place mixed in: ``(sets, bands)``."""
    parts = sketches.reshape(len(sketches), -1, rows)
    out = mixed(parts[:, :, 0] + np.arange(parts.shape[1], dtype=np.uint64)[None, :])
    for r in range(1, rows):
        out = mixed(out ^ parts[:, :, r], r)
    return out


def described(docs: DataFrame, k: int) -> DataFrame:
    """Per document: size of its set, a name of the set, its band keys (empty set: null and none)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in batches:
            sets = [distinct(shingles(word_hashes(t, known), k)) for t in frame["text"]]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            first = {name: i for i, name in reversed(list(enumerate(names))) if name}
            keys: dict[bytes, np.ndarray] = {}
            for chunk in np.array_split(np.fromiter(first.values(), np.int64, len(first)), len(first) // 256 + 1):
                if len(chunk):
                    keys |= zip([names[i] for i in chunk], bands(sketch_sets([sets[i] for i in chunk])).view(np.int64))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_name": names,
                    "band_keys": [keys[name] if name else [] for name in names],
                }
            )

    schema = "doc_id bigint, n_shingles bigint, set_name binary, band_keys array<bigint>"
    return docs.select("doc_id", "text").mapInPandas(describe, schema)


def set_bytes(docs: DataFrame, k: int) -> DataFrame:
    """Name and packed elements of each document's full set."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in batches:
            sets = [distinct(shingles(word_hashes(t, known), k)).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s) for s in sets], "elements": sets})

    return docs.select("doc_id", "text").mapInPandas(pack, "node binary, elements binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keep = []
            for x, y in zip(frame["x"], frame["y"]):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                union = len(distinct(both))
                keep.append(100 * (len(both) - union) >= similarity * union)
            yield frame.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(confirm, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Least node that each linked node reaches: ``(node, comp)``.

    Large and small stars in turn: neighbours are linked to the least node around,
    until nothing changes; about as many rounds as the logarithm of the longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("u", "out", "into"))
        # Done when every node points at one other, at which no further step begins.
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out + into > 1").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def stars(shared: DataFrame) -> DataFrame:
    """Each class with the pivots of its buckets: ``(a, b)``.

    A bucket's pivot is found by climbing: from its class that shares buckets with most
    to the like class of any bucket of that one, ``CLIMBS`` times. An original shares more
    with its copies than they do with each other, so a family has one pivot or few. There
    is at most a pair for each row of a bucket, however large it is.
    """
    best = F.max(F.struct("crowd", "node"))
    peaks = shared.groupBy("bucket").agg(best.alias("peak"))
    homes = stored(
        shared.join(peaks, "bucket").groupBy("node").agg(F.max("peak")["node"].alias("home")), "homes"
    )
    pivots = peaks.select("bucket", F.col("peak.node").alias("a"))
    for _ in range(CLIMBS):
        pivots = pivots.join(homes, pivots["a"] == homes["node"]).select("bucket", F.col("home").alias("a"))
    pairs = shared.join(pivots, "bucket").select("a", F.col("node").alias("b")).filter("a <> b")
    return pairs.distinct()


def measured(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Each pair ``(a, b)`` with the size of ``b``, whether it is linked, and ``elements`` that only one of them has."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = []
            for packed_x, packed_y in zip(frame["x"], frame["y"]):
                x, y = np.frombuffer(packed_x, np.uint64), np.frombuffer(packed_y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = x[at] == y
                only_x = np.ones(len(x), bool)
                only_x[at[both]] = False
                apart = np.concatenate([y[~both], x[only_x]])
                size, n = len(x) + len(y), len(apart)
                found.append((len(y), 100 * (size - n) >= similarity * (size + n), apart.view(np.int64)))
            out = pd.DataFrame(found, columns=["size", "linked", "elements"])
            yield pd.concat([frame[["a", "b"]].reset_index(drop=True), out], axis=1)

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    kind = "a binary, b binary, size bigint, linked boolean, elements array<bigint>"
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(measure, kind)


def candidates(family: DataFrame, similarity: int) -> DataFrame:
    """Pairs of classes around one pivot that may be linked, though not both are linked to it.

    ``family`` has the rows of ``measured`` with ``comp``. Let X and Y differ from the
    pivot by dX and dY elements and have S together. They are linked if at most
    s = S(100-p)/(100+p) elements are in one of them only, so if they share at least
    t = (dX+dY-s)/2 of their differences. If one of them is not linked to the pivot then
    t > 0. In any order of the elements the first shared one then has a place of at most
dX-t in X's and dY-t in Y's, places counted from 0; their sum is at most s, so one of
    them lies in the first half of what a class may show. Nothing else is joined. The order
    is by how many of the family have an element, the fewest first, so where copies have
    edits of their own hardly anything meets, also if all have some edit in common.
    """
    open_ = family.groupBy("a").agg(F.bool_and("linked").alias("all_linked")).filter("not all_linked").select("a")
    spread = family.join(open_, "a", "left_semi").select(
        "a", "b", "size", "comp", F.size("elements").alias("apart"), F.explode("elements").alias("e")
    )
    shares = spread.groupBy("a", "e").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "e")) - 1
    ranked = spread.join(shares, ["a", "e"]).withColumn("at", place)
    # An element that no other has takes a place and meets nothing.
    in_reach = (F.col("n") > 1) & (F.col("at") * similarity <= F.col("size") * (100 - similarity))
    shown = stored(ranked.filter(in_reach).drop("n"), "differences")
    first = shown.filter(F.col("at") * (2 * similarity) <= F.col("size") * (100 - similarity))
    other = shown.select("a", "e", *[F.col(c).alias(f"{c}_") for c in ("b", "size", "apart", "comp", "at")])
    room = (F.col("size") + F.col("size_")) * (100 - similarity)
    near_x = F.col("at") * (2 * (100 + similarity)) <= (F.col("apart") - F.col("apart_")) * (100 + similarity) + room
    near_y = F.col("at_") * (2 * (100 + similarity)) <= (F.col("apart_") - F.col("apart")) * (100 + similarity) + room
    alike = 100 * F.least("size", "size_") >= similarity * F.greatest("size", "size_")
    met = first.join(other, ["a", "e"]).filter((F.col("comp") != F.col("comp_")) & alike & near_x & near_y)
    return met.select(F.least("b", "b_").alias("a"), F.greatest("b", "b_").alias("b")).distinct()


def class_links(shared: DataFrame, sets: DataFrame, similarity: int) -> DataFrame | None:
    """Components of the linked classes, or None; ``shared`` has ``(bucket, node, crowd)``.

    Every class is compared with the pivots of its buckets. Two classes of a bucket that
    are not joined by that differ from one pivot in elements they must share.
    """
    family = stored(measured(stars(shared), sets, similarity), "stars")
    links = family.filter("linked").select("a", "b")
    if links.isEmpty():
        comps = None
        named = family.withColumn("comp", F.col("b"))
    else:
        comps = stored(components(links), "components")
        named = family.join(comps, family["b"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "b")).drop("node")
    more = stored(confirmed(stored(candidates(named, similarity), "pairs"), sets, similarity), "links")
    if more.isEmpty():
        return comps
    if comps is None:
        return components(more)
    # The components found so far are the nodes of the second round.
    ends = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab"]
    joined = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
    between = joined.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).filter("a <> b")
    outer = components(stored(between.distinct(), "between")).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    inner = comps.join(outer, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
    alone = outer.join(comps, outer["comp"] == comps["node"], "left_anti").select(F.col("comp").alias("node"), F.col("whole").alias("comp"))
    return inner.unionByName(alone)


def linked(docs: DataFrame, k: int, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Null, empty and blank texts have no shingles, are linked with nothing and kept.
    Rows of equal sets are linked. Of rows that repeat an id and a set, each is
    kept; a null id is no smallest id, and such a row is kept.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = stored(described(docs, k), "sketches")
    classes = seen.filter("set_name is not null").groupBy(F.col("set_name").alias("node")).agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies")
    )
    buckets = seen.filter("set_name is not null").select(
        F.col("set_name").alias("node"), F.explode("band_keys").alias("bucket")
    ).distinct()
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(buckets.join(several, "bucket"), "buckets")
    crowds = shared.groupBy("node").agg(F.sum("n").alias("crowd"))
    shared = shared.select("bucket", "node").join(crowds, "node")
    least = classes.join(crowds.select("node").distinct(), "node", "left_semi").select("node", F.col("least_id").alias("doc_id"))
    sets = stored(set_bytes(docs.join(least.select("doc_id").distinct(), "doc_id", "left_semi"), k).join(least.select("node"), "node", "left_semi"), "sets")
    comps = class_links(shared, sets, similarity)
    if comps is None:
        ids = classes.select("node", F.col("least_id").alias("component_id"))
    else:
        joined = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        ids = joined.groupBy("comp").agg(F.min("least_id").alias("component_id"))
        ids = joined.join(ids, "comp").filter("copies > 1 or component_id <> least_id").select("node", "component_id")
    return seen.join(ids, seen["set_name"] == ids["node"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    gone = linked(docs, 5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x20\x09-\x0D]+')"


def sql(k: int = 2) -> str:
    """The definition, read plainly; for small tables."""
    return f"""
with recursive w as (select doc_id, {SQL_WORDS} t from documents),
s as (select distinct doc_id, array_to_string(t[i:i+least({k},len(t))-1],' ') s
  from w, unnest(range(1, greatest(len(t)-{k - 1},1)+1)) r(i) where len(t) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100*c >= {SIMILARITY}*(x.n+y.n-c)),
r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(r.b)::BIGINT component_id, d.doc_id = min(r.b) kept
from documents d left join n on d.doc_id = n.doc_id join r on r.a = d.doc_id group by d.doc_id"""


@query("op10_near_duplicates", sql())
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), 2)
