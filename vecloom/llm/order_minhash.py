"""Order MinHash fingerprints, in Spark SQL functions alone.

A text is its runs of ``K`` units, each numbered among its equals: the first
"and so ", the second, and so on. A unit is at most 16 code points without white
space and the white space after them, so that every code point counts; runs of
single code points took about four times the CPU seconds there are. A hash deals the numbered runs to ``BINS`` bins; each
bin selects its ``TUPLE`` least, puts them back in the order of the text and hashes
them as a tuple. Order and number of repeats tell texts apart that hold the same
runs, so the share of equal tuples falls with the edit distance.

A bin with fewer runs than a tuple would keep no order, and a short text has mostly
such bins. So each of these takes the least of all runs by a hash of the bin's own, as
Order MinHash does for every hash.

Equal runs are numbered without a scan: their hashes, each with its place in the low
bits, are sorted; the starts of equal stretches cut the numbering 0, 1, 2, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.registry import query
from vecloom.operators.feed import cut_ranges
from vecloom.plans.catalog import table

K = 2
UNIT = r"\\S{1,16}\\s*|\\s+"
BINS = 64
TUPLE = 2
# A place in the text takes so many low bits, so texts may have 2^31 code points.
PLACE_BITS = 31

_PLACE = (1 << PLACE_BITS) - 1
_BIN_SHIFT = 64 - (BINS.bit_length() - 1)


def _bound(value: str, body: str) -> str:
    """``body`` with ``v`` for the value, evaluated once: in a lambda a captured expression is evaluated for each element."""
    return f"element_at(transform(array({value}), v -> {body}), 1)"


def _runs(text: str) -> str:
    """Hash of each run, its place in the low bits; a shorter text is one run."""
    units = ", ".join(f"get(v, i + {j})" for j in range(K))
    return _bound(
        f"regexp_extract_all(coalesce({text}, ''), '{UNIT}', 0)",
        f"transform(sequence(0, greatest(size(v) - {K}, 0)), i -> ((xxhash64({units}) & ~{_PLACE}L) | i))",
    )


def _starts(s: str) -> str:
    """Where in sorted hashes a stretch of equals begins, and the end."""
    return (
        f"concat(array(0), filter(sequence(1, greatest(size({s}) - 1, 1)), i -> "
        f"i < size({s}) and (({s}[i] ^ {s}[i - 1]) & ~{_PLACE}L) <> 0), array(size({s})))"
    )


def _numbered(s: str, starts: str) -> str:
    """Hash of run and number, place in the low bits, in the order of the hashes.

    Where no run repeats, every number is 0 and nothing has to be cut.
    """
    numbers = f"flatten(zip_with(slice({starts}, 1, size({starts}) - 1), slice({starts}, 2, size({starts}) - 1), (a, b) -> sequence(0, b - a - 1)))"
    return (
        f"if(size({starts}) - 1 = size({s}), transform({s}, x -> ((xxhash64(x & ~{_PLACE}L, 0) & ~{_PLACE}L) | (x & {_PLACE}L))), "
        f"zip_with({s}, {numbers}, (x, k) -> ((xxhash64(x & ~{_PLACE}L, k) & ~{_PLACE}L) | (x & {_PLACE}L))))"
    )


def _likely(g: str) -> str:
    """Those that may be selected: of the lowest hashes within their bins, so many that bins rarely lack any.

    The share is a power of two, taken from the bits right below the bin's.
    """
    bits = f"greatest(0, cast(floor(log2(size({g}) / {float(BINS * TUPLE * 12)})) as int))"
    return f"filter({g}, x -> shiftrightunsigned(x << {64 - _BIN_SHIFT}, 64 - {bits}) = 0 or {bits} = 0)"


def _served(o: str) -> str:
    """How many bins have a tuple's worth of sorted hashes."""
    bin_of = lambda at: f"shiftrightunsigned({o}[{at}], {_BIN_SHIFT})"
    return (
        f"size(filter(sequence(0, greatest(size({o}) - {TUPLE}, 0)), i -> i + {TUPLE} <= size({o}) and {bin_of('i')} = {bin_of(f'i + {TUPLE - 1}')} "
        f"and (i = 0 or {bin_of('i')} <> {bin_of('greatest(i - 1, 0)')})))"
    )


def _firsts(o: str) -> str:
    """Where in sorted hashes a bin begins."""
    return (
        f"filter(sequence(0, size({o}) - 1), i -> i = 0 or "
        f"shiftrightunsigned({o}[i], {_BIN_SHIFT}) <> shiftrightunsigned({o}[greatest(i - 1, 0)], {_BIN_SHIFT}))"
    )


def _selected(o: str, firsts: str) -> str:
    """Per bin its number and the tuple's hash: the least of the bin, by place in the text."""
    same = f"filter(slice({o}, i + 1, {TUPLE}), x -> shiftrightunsigned(x, {_BIN_SHIFT}) = shiftrightunsigned({o}[i], {_BIN_SHIFT}))"
    ordered = f"transform(array_sort(transform({same}, x -> named_struct('p', x & {_PLACE}L, 'h', x & ~{_PLACE}L))), y -> y.h)"
    return (
        f"transform({firsts}, i -> named_struct('b', shiftrightunsigned({o}[i], {_BIN_SHIFT}), 'n', size({same}), "
        f"'h', aggregate({ordered}, 42L, (acc, h) -> xxhash64(acc, h))))"
    )


def _filled(o: str, d: str) -> str:
    """The tuple's hash of every bin; one that lacks runs takes the ``TUPLE`` (two) least of all by a hash of its own.

    Where a bin lacks any, ``o`` is the whole list. A text of a single run has tuples of one.
    """
    least = "named_struct('a', array_min(k), 'z', array_min(array_remove(k, array_min(k))))"
    place = lambda x: f"(element_at({o}, cast(array_position(k, {x}) as int)) & {_PLACE}L)"
    ordered = f"y -> if({place('y.a')} < {place('y.z')}, xxhash64(y.a, y.z), xxhash64(y.z, y.a))"
    own = f"element_at(transform(array(transform(hs, x -> xxhash64(x, b))), k -> element_at(transform(array({least}), {ordered}), 1)), 1)"
    whole = f"map_from_entries(transform(filter({d}, x -> x.n >= {TUPLE}), x -> struct(x.b, x.h)))"
    hashes = f"if(size({d}) = {BINS} and forall({d}, x -> x.n >= {TUPLE}), array(), transform({o}, x -> x & ~{_PLACE}L))"
    each = f"transform(sequence(0L, {BINS - 1}L), b -> coalesce(element_at(v, b), {own}))"
    return _bound(whole, f"element_at(transform(array({hashes}), hs -> {each}), 1)")


def with_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add a fingerprint for each text column: ``{"text": "fingerprint"}``.

    It has 16 hexadecimal digits for each bin, a tuple in each however short the text;
    an empty or null text has an empty one.
    """
    for text in columns:
        df = df.withColumn(f"_n_{text}", F.length(F.coalesce(text, F.lit(""))))
    for step in ("s", "t", "g", "o", "f", "d", "e"):
        for text in columns:
            s, t, g, o, f = (f"_{c}_{text}" for c in "stgof")
            made = {
                "s": f"sort_array({_runs(text)})",
                "t": _starts(s),
                "g": _numbered(s, t),
                "o": "",
                "f": _firsts(o),
                "d": _selected(o, f),
                "e": _filled(o, f"_d_{text}"),
            }[step]
            if step == "o":
                # A bin that lacks runs among the likely ones makes the whole list count.
                likely = f"_l_{text}"
                df = df.withColumn(likely, F.expr(f"sort_array({_likely(g)})"))
                made = f"if(size({likely}) = size({g}) or {_served(likely)} = {BINS}, {likely}, sort_array({g}))"
            df = df.withColumn(f"_{step}_{text}", F.expr(made))
        gone = {"g": "st", "o": "gl", "d": "f", "e": "o"}.get(step, "")
        df = df.drop(*[f"_{c}_{text}" for c in gone for text in columns])
    for text, name in columns.items():
        digits = f"array_join(transform(_e_{text}, h -> lpad(lower(hex(h)), 16, '0')), '')"
        df = df.withColumn(name, F.expr(f"if(_n_{text} = 0, '', {digits})"))
    return df.drop(*[f"_{c}_{text}" for c in "nde" for text in columns])


def likeness(a: str, b: str) -> Column:
    """Share of bins with equal tuples; two empty texts are alike, an empty one and another are not."""
    parts = [f"regexp_extract_all({c}, '.{{16}}', 0)" for c in (a, b)]
    share = f"size(filter(zip_with({parts[0]}, {parts[1]}, (x, y) -> x = y), z -> z)) / cast({BINS} as double)"
    return F.expr(f"case when {a} = {b} then 1.0D when {a} = '' or {b} = '' then 0.0D else {share} end")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows with group, order and a copy of each group's first row at the end of the group before.

    Groups are quantiles of id and text, so no window spans the table, and neither far
    ids nor many rows of one id or without one make a large group. Null ids stand first;
    rows of one id are ordered by a hash of their text.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = cut_ranges(plain, ["doc_id"], ["text"]).withColumnRenamed("_range", "_group")
    groups = dealt.groupBy("_group").agg(F.min(F.struct("doc_id", "_tie")).alias("_least"))
    ring = Window.orderBy("_group")
    last = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_group").over(ring), F.last("_group").over(last))
    # One row per quantile, of which there are some per shuffle partition.
    firsts = F.broadcast(groups.select("_group", "_least", before.alias("_before")))
    first = (F.col("doc_id").eqNullSafe(F.col("_least.doc_id"))) & (F.col("_tie") == F.col("_least._tie"))
    places = F.when(first, F.array("_group", "_before")).otherwise(F.array("_group"))
    return dealt.join(firsts, "_group", "left").select("doc_id", "text", "_tie", F.posexplode(places).alias("_copy", "_at"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they are.

    Null texts are empty. The edited text has its second half replaced by the start
    of the next document's; a single document follows itself. Repeated rows follow
    each other.
    """
    order = Window.partitionBy("_at").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_tie")
    rows = with_next(docs).withColumn("_next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.coalesce("_next", F.lit("")), half))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("_edited", edited).drop("_next")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    rows = with_fingerprints(rows, {"text": "fingerprint", "_edited": "edited_fingerprint"}).drop("text", "_edited")
    rows = rows.withColumn("_next", F.lead("fingerprint").over(order)).filter("_copy = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        F.coalesce(likeness("fingerprint", "_next"), F.lit(1.0)).alias("near_next"),
    )


@query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
