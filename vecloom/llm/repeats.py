"""Passages that repeat across documents, found by suffix sorting.

Every window of ``length`` bytes has an anchor: the place of the least hash among
its runs of ``GRAM`` bytes, which depends on the window's bytes alone. Equal windows
therefore have equal anchors, and the passes are

1. anchors are dealt by hash; those of one hash found in two documents are candidates,
2. candidates go back to their documents, whose windows around an anchor (a snippet)
   are dealt by hash again, equal ones once,
3. the snippets of a bucket are suffix-sorted in two stages, adjacent suffixes are
   compared, and each class of equal windows gets its smallest document id,
4. the windows with a smaller one go back to their documents as spans of bytes.

Numbers travel as packed arrays, one row per block of text and bucket, or bucket and part.
Where much repeats, the snippets are several times the texts: steps 2 and 3 then take the
buckets in rounds, and the snippets of a round leave the disk when it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.frames import Numbered, mixed, set_aside, stored, text_bytes
from vecloom.llm.registry import query
from vecloom.plans.catalog import table

LENGTH = 50
GRAM = 16
# UTF-8 has no such byte.
BREAK = 0xFF
# Bytes of text whose anchors or documents meet in one group.
GROUP_BYTES = 4 << 20
MOST_GROUP_BYTES = 64 << 20
# Buckets of anchors a part of documents: sorting a bucket takes many times its bytes.
BUCKETS_A_PART = 2
# Bytes of snippets sorted at once, and how many groups of them a bucket can be cut into.
SORT_BYTES = 4 << 20
SLICES = 1 << 10
# Bytes of snippets cut in one round, or as many as the texts have if that is more.
ROUND_BYTES = 64 << 20
# Bytes of text a task turns into anchors at a time, and rows it decodes at a time.
BLOCK = 1 << 20
ROWS_AT_ONCE = 256


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers in byte order; ``data`` has eight to spare."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first window and number of further windows of each anchor.

    ``data`` holds documents one after the other, which end at ``ends``.
    """
    starts = np.concatenate([[0], ends[:-1]])
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none.astype(np.uint64), none, none, none
    eight = words_at(data).astype(np.uint64)
    grams = len(data) - GRAM + 1
    h = mixed(eight[:grams] ^ (eight[8 : 8 + grams] * np.uint64(0x9E3779B97F4A7C15)))
    key = (h & ~np.uint64((1 << 31) - 1)) | np.arange(grams, dtype=np.uint64)
    width = 1
    wanted = length - GRAM + 1
    while width * 2 <= wanted:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wanted:
        key = np.minimum(key[: -(wanted - width)], key[wanted - width :])
    at = (key[:n] & np.uint64((1 << 31) - 1)).astype(np.int64)
    # Windows that leave their document do not count.
    live = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(live, starts[long], 1)
    np.add.at(live, ends[long] - length + 1, -1)
    x = np.flatnonzero(np.cumsum(live[:n]))
    if not len(x):
        return none.astype(np.uint64), none, none, none
    at = at[x]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (x[1:] != x[:-1] + 1)])
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(x)]]))
    doc = np.searchsorted(ends, x[begin], "right")
    return h[at[begin]], doc, x[begin] - starts[doc], count - 1


def direct_sort(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` bytes that follow them."""
    eight = words_at(data)
    key = eight[places].astype(np.uint64)
    order = np.argsort(key)
    places, key = places[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    done = 8
    while done < depth:
        rank = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        sub = np.flatnonzero(tied)
        if not len(sub):
            break
        take = min(4, depth - done)
        part = eight[places[sub] + done].astype(np.uint64) >> np.uint64(64 - 8 * take)
        key = (rank[sub].astype(np.uint64) << np.uint64(32)) | part
        order = np.argsort(key)
        places[sub], key = places[sub][order], key[order]
        new[sub] = np.concatenate([[True], key[1:] != key[:-1]])
        done += take
    return places


def two_stage(data: np.ndarray, size: int, depth: int) -> np.ndarray:
    """All suffixes of ``data[:size]`` in the order of their first ``depth`` bytes.

    Suffixes smaller than their successor are sorted directly. Every other one
    stands right after where its successor stands: a scan over the buckets of first
    bytes, from the least on, puts them in place.
    """
    text = data[:size]
    step = np.zeros(size, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    turn = np.flatnonzero(step)
    smaller = np.repeat(step[turn] > 0, np.diff(turn, prepend=-1))
    chosen = direct_sort(data, np.flatnonzero(smaller), depth)
    borders = np.searchsorted(text[chosen], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[text[-1]].append(np.array([size - 1]))
    out = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            larger[first[a]].append(before[a:b])

    for c in range(256):
        seen = 0
        while seen < len(larger[c]):
            wave = np.concatenate(larger[c][seen:])
            seen = len(larger[c])
            induce(wave)
        own = chosen[borders[c] : borders[c + 1]]
        induce(own)
        out += [*larger[c], own]
    return np.concatenate(out)


def window_classes(snippets: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, snippet and offset of every window of the snippets, in text order; equal windows share a class."""
    sizes = np.fromiter(map(len, snippets), np.int64, len(snippets))
    joined = bytes([BREAK]).join(snippets) + bytes([BREAK])
    data = np.frombuffer(joined + bytes(length + 16), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(snippets), dtype=np.int32), counts)
    offset = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    valid = np.full(len(joined), -1, np.int32)
    valid[begin[owner] + offset] = np.arange(len(owner), dtype=np.int32)
    order = two_stage(data, len(joined), length)
    order = order[valid[order] >= 0]
    eight = words_at(data)
    same = np.ones(max(len(order) - 1, 0), bool)
    for i in range(0, length, 8):
        word = eight[order + i].astype(np.uint64) >> np.uint64(8 * max(0, i + 8 - length))
        same &= word[1:] == word[:-1]
    classes = np.empty(len(order), np.int64)
    classes[valid[order]] = np.cumsum(np.concatenate([[False], ~same])) if len(order) else 0
    return classes, owner, offset


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield int(key[order[a]]), order[a:b]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: high bytes are alike, and pack to nothing in the shuffle."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel() for x in column.to_pylist()]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    found = _numbers(column, kind)
    return np.concatenate(found) if found else np.zeros(0, kind)


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """The same as ``_part`` on Spark's side."""
    return (doc ^ (doc >> 16) ^ (doc >> 32)) % parts


def _part(parts: int) -> Column:
    doc = F.col("doc_id")
    mixed_id = doc.bitwiseXOR(F.shiftright(doc, 16)).bitwiseXOR(F.shiftright(doc, 32))
    return F.coalesce(F.pmod(mixed_id, F.lit(parts)), F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int")


def _schema(**kinds: str) -> pa.Schema:
    return pa.schema([(name, pa.int32() if kind == "int" else pa.binary()) for name, kind in kinds.items()])


ANCHOR = _schema(bucket="int", hash="", doc="", lo="", more="")
CANDIDATE = _schema(part="int", bucket="int", doc="", lo="", more="")
SNIPPET = _schema(bucket="int", part="int", bytes="", sizes="", of="", doc="", row="", lo="")
SPAN = _schema(part="int", row="", lo="", hi="")
ZSTD = "zstd"


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if pa.types.is_integer(f.type) else 'binary'}" for f in schema)


def _find_anchors(buckets: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(texts: list[bytes], facts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            h, piece, lo, more = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
            doc, start = np.array(facts, np.int64)[piece].reshape(-1, 2).T
            lo = (lo + start).astype(np.uint32)
            doc, low, more = np.ascontiguousarray(doc), h.astype(np.uint32), more.astype(np.uint8)
            rows = [
                {"bucket": bucket, "hash": low[at].tobytes(), "doc": _planes(doc[at]), "lo": _planes(lo[at]), "more": more[at].tobytes()}
                for bucket, at in _split(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
            ]
            yield from pa.Table.from_pylist(rows, ANCHOR).to_batches()

        texts, facts, size = [], [], 0
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "replace")
                # A long text comes in pieces that share all but one byte of a window.
                for start in range(0, len(data) - length + 1, BLOCK):
                    texts.append(data[start : start + BLOCK + length - 1])
                    facts.append((doc, start))
                    size += len(texts[-1])
                    if size >= BLOCK:
                        yield from flush(texts, facts)
                        texts, facts, size = [], [], 0
        if texts:
            yield from flush(texts, facts)

    return find


def _snippet_bytes(members: int, length: int = LENGTH) -> int:
    """Of so many anchors, each with half as many further windows as it can have."""
    return members * (length + (length - GRAM) // 2)


def _shared_anchors(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Anchors whose hash stands in two documents; many of a bucket are dealt by hash to slices of it."""

    def share(group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in group["hash"].to_pylist()])
        more = np.concatenate([np.frombuffer(x, np.uint8) for x in group["more"].to_pylist()])
        doc, lo = _joined(group["doc"], "i8"), _joined(group["lo"], "u4")
        order = np.argsort(h)
        cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        sizes = np.diff(np.concatenate([cuts, [len(h)]]))
        several = np.minimum.reduceat(doc[order], cuts) < np.maximum.reduceat(doc[order], cuts)
        take = order[np.repeat(several, sizes)]
        h, doc, lo, more = h[take], doc[take], lo[take], more[take]
        slices = min(SLICES, max(1, -(-_snippet_bytes(len(take)) // SORT_BYTES)))
        first = group["bucket"][0].as_py() * SLICES
        rows = [
            {"part": key // slices, "bucket": first + key % slices, "doc": _planes(doc[at]), "lo": _planes(lo[at]), "more": more[at].tobytes()}
            for key, at in _split(_part_of(doc, parts) * slices + h % np.uint32(slices))
        ]
        return pa.Table.from_pylist(rows, CANDIDATE)

    return share


def _in_order(docs: pa.Table) -> list[int]:
    """Rows of a part by id and text, so that every pass numbers them alike."""
    ids, tags = docs["doc_id"].to_pylist(), docs["tag"].to_pylist()
    return sorted((i for i, doc in enumerate(ids) if doc is not None), key=lambda i: (ids[i], tags[i]))


def _cut_snippets(length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if found.num_rows and docs.num_rows:
            ids, texts = docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary())
            # A candidate goes to every row of its id that is long enough; the bytes decide.
            own: dict[int, list[tuple[int, bytes]]] = {}
            for row, i in enumerate(_in_order(docs)):
                text = texts[i].as_py()
                if text is not None:
                    own.setdefault(ids[i], []).append((row, text))
            by_bucket: dict[int, list[int]] = {}
            for i, bucket in enumerate(found["bucket"].to_pylist()):
                by_bucket.setdefault(bucket, []).append(i)
            doc_parts, lo_parts, more_parts = _numbers(found["doc"], "i8"), _numbers(found["lo"], "u4"), found["more"].to_pylist()
            codec = pa.Codec(ZSTD)
            for bucket, at in by_bucket.items():
                index: dict[bytes, int] = Numbered()
                of, doc, row, lo = [], [], [], []
                for i in at:
                    for d, a, m in zip(doc_parts[i].tolist(), lo_parts[i].tolist(), more_parts[i]):
                        for r, text in own.get(d, ()):
                            if a + m + length <= len(text):
                                of.append(index[text[a : a + m + length]])
                                doc.append(d)
                                row.append(r)
                                lo.append(a)
                rows.append(
                    {
                        "bucket": bucket,
                        "part": found["part"][0].as_py(),
                        "bytes": codec.compress(b"".join(index), asbytes=True),
                        "sizes": np.fromiter(map(len, index), np.uint8, len(index)).tobytes(),
                        "of": _planes(np.array(of, np.uint32)),
                        "doc": _planes(np.array(doc, np.int64)),
                        "row": _planes(np.array(row, np.uint32)),
                        "lo": _planes(np.array(lo, np.uint32)),
                    }
                )
        return pa.Table.from_pylist(rows, SNIPPET)

    return cut


def _repeated(length: int) -> Callable[[pa.Table], pa.Table]:
    def judge(group: pa.Table) -> pa.Table:
        index: dict[bytes, int] = Numbered()
        of, part = [], []
        codec = pa.Codec(ZSTD)
        for data, sizes, local, own in zip(group["bytes"].to_pylist(), group["sizes"].to_pylist(), _numbers(group["of"], "u4"), group["part"].to_pylist()):
            cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64)]).tolist()
            data = codec.decompress(data, cuts[-1], asbytes=True) if cuts[-1] else b""
            here = [index[data[a:b]] for a, b in zip(cuts, cuts[1:])]
            of.append(np.array(here, np.int64)[local])
            part.append(np.full(len(local), own))
        of, part = np.concatenate(of), np.concatenate(part)
        if not len(of):
            return pa.Table.from_pylist([], SPAN)
        doc = _joined(group["doc"], "i8")
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        classes, owner, _ = window_classes(list(index), length)
        first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, classes, least[owner])
        first = first[classes]
        counts = np.bincount(owner, minlength=len(index))
        begin = np.cumsum(counts) - counts
        low, high = np.minimum.reduceat(first, begin), np.maximum.reduceat(first, begin)
        lo = _joined(group["lo"], "u4").astype(np.int64)
        whole = high[of] < doc
        some = np.flatnonzero((low[of] < doc) & ~whole)
        n = counts[of[some]]
        member = np.repeat(some, n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = first[begin[of[member]] + window] < doc[member]
        member, window = member[hit], window[hit]
        joins = (member[1:] == member[:-1]) & (window[1:] == window[:-1] + 1)
        head = np.flatnonzero(np.concatenate([[True], ~joins])) if len(member) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:] - 1, [len(member) - 1]]) if len(member) else head
        at = np.concatenate([np.flatnonzero(whole), member[head]])
        start = np.concatenate([lo[whole], lo[member[head]] + window[head]]).astype(np.uint32)
        end = (np.concatenate([lo[whole] + counts[of[whole]] - 1, lo[member[tail]] + window[tail]]) + length).astype(np.uint32)
        row = _joined(group["row"], "u4")[at]
        rows = [
            {"part": p, "row": _planes(row[i]), "lo": _planes(start[i]), "hi": _planes(end[i])} for p, i in _split(part[at])
        ]
        return pa.Table.from_pylist(rows, SPAN)

    return judge


def _rounds(found: DataFrame, size: int, length: int) -> int:
    """Rounds in which the candidates ``found`` in ``size`` bytes of text are judged."""
    members = found.agg(F.coalesce(F.sum(F.octet_length("more")), F.lit(0))).head()[0]
    return max(1, -(-_snippet_bytes(members, length) // max(size, ROUND_BYTES)))


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: int) -> list[list[tuple[int, int]]]:
    """The spans of each of ``rows`` rows in order, those that meet as one."""
    order = np.lexsort((lo, row))
    high = row[order].astype(np.uint64) << np.uint64(32)
    first, last = high | lo[order], np.maximum.accumulate(high | hi[order])
    head = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]])) if len(order) else order
    tail = np.concatenate([head[1:], [len(order)]])[: len(head)] - 1
    low = np.uint64((1 << 32) - 1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    for at, a, b in zip((row[order][head]).tolist(), (first[head] & low).tolist(), (last[tail] & low).tolist()):
        out[at].append((a, b))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def with_spans(docs: DataFrame, make: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema: str, length: int = LENGTH) -> DataFrame:
    """``make`` gets rows of ``docs`` as an Arrow table, and each row's repeated spans of bytes.

    A span is a maximal run of bytes covered by windows of ``length`` bytes that also
    start in a document of a smaller id. Null texts are empty, and texts shorter than
    a window have no span. Rows of a null id have none either, and start none
    elsewhere. Rows that repeat an id do not count as smaller than each other.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    group = min(max(GROUP_BYTES, size // 256), MOST_GROUP_BYTES)
    parts = max(1, -(-size // group))
    for name in ("tag", "part"):
        if name in docs.columns:
            raise ValueError(f"the column {name} has to be renamed first")
    dealt = docs.withColumn("tag", F.xxhash64("text")).withColumn("part", _part(parts))
    texts = dealt.select("doc_id", "tag", "part", "text").filter("doc_id is not null")
    found = (
        texts.select("doc_id", "text").filter("text is not null").mapInArrow(_find_anchors(BUCKETS_A_PART * parts, length), _ddl(ANCHOR))
        .groupBy("bucket")
        .applyInArrow(_shared_anchors(parts), _ddl(CANDIDATE))
    )
    found = stored(found, "anchors")
    rounds = min(BUCKETS_A_PART * parts, _rounds(found, size, length))

    def judged(own: DataFrame) -> DataFrame:
        snippets = texts.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_cut_snippets(length), _ddl(SNIPPET))
        return stored(snippets.groupBy("bucket").applyInArrow(_repeated(length), _ddl(SPAN)), "spans")

    spans = reduce(DataFrame.unionAll, [judged(found.filter(F.floor(F.col("bucket") / SLICES) % rounds == i)) for i in range(rounds)])

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        own: list[list[tuple[int, int]]] = [[] for _ in range(rows.num_rows)]
        order = _in_order(rows)
        for i, spans in zip(order, merged(*(_joined(found[c], "u4") for c in ("row", "lo", "hi")), len(order))):
            own[i] = spans
        return make(rows.drop_columns(["tag", "part"]), own)

    return dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(finish, schema)


def _digests(rows: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
    texts = [(t or "").encode("utf-8", "replace") for t in rows["text"].to_pylist()]
    return pa.table(
        {
            "doc_id": rows["doc_id"],
            "n_bytes": pa.array(map(len, texts), pa.int64()),
            "n_removed": pa.array((sum(b - a for a, b in s) for s in spans), pa.int64()),
            "n_spans": pa.array(map(len, spans), pa.int64()),
            "kept_sha256": pa.array((hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans)), pa.string()),
        }
    )


def _rewritten(rows: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
    texts = [
        kept_bytes(t.encode("utf-8", "replace"), s).decode("utf-8", "ignore") if s else t
        for t, s in zip(rows["text"].to_pylist(), spans)
    ]
    return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; ``n_chars`` follows the text. A character cut in two goes as a whole.

    Other columns stay as they are, whatever their names.
    """
    inner, back = set_aside(docs, ["doc_id", "text", "n_chars"])
    out = with_spans(inner, _rewritten, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema))
    length = F.length(F.coalesce("text", F.lit(""))).cast(dict(docs.dtypes)["n_chars"])
    return back(out.withColumn("n_chars", length))


SQL = f"""
with b as (select doc_id, hex(encode(coalesce(text,''))) h from documents),
w as (select doc_id, i, substr(h, 2*i+1, {2 * LENGTH}) w from b, unnest(range(0, greatest(len(h)//2-{LENGTH - 1},0))) r(i)),
m as (select w, min(doc_id) m from w group by w),
c as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i), 999999) gap
  from w join m using (w) where m < doc_id),
s as (select doc_id, i, sum((gap > {LENGTH})::int) over (partition by doc_id order by i) k from c),
r as (select doc_id, k, min(i) a, max(i)+{LENGTH} z from s group by doc_id, k),
x as (select doc_id, sum(z-a) removed, count(*) spans, list(a order by a) a, list(z order by a) z from r group by doc_id)
select b.doc_id, (len(h)//2)::BIGINT n_bytes, coalesce(removed,0)::BIGINT n_removed, coalesce(spans,0)::BIGINT n_spans,
  sha256(unhex(case when a is null then h else array_to_string(list_transform(range(0, len(a)+1),
    lambda j: substr(h, 2*(case when j = 0 then 0 else z[j] end)+1,
      2*((case when j = len(a) then len(h)//2 else a[j+1] end)-(case when j = 0 then 0 else z[j] end)))), '') end)) kept_sha256
from b left join x using (doc_id)"""


@query("op9_repeats", SQL)
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs, _digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
