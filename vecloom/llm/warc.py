"""WARC archives with a two-level capture index.

Records are gzip members of archives, one archive per task. The index sorts captures
by a key, the host's names in reverse before the path, and keeps them in compressed
blocks; a sparse directory has the first key and the place of each block. A look-up
finds the block by binary search in the directory, the captures by binary search in
the block, and the record by one range read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.frames import stored
from vecloom.llm.registry import query
from vecloom.plans.catalog import table
from vecloom.scratch import fresh_path
from vecloom.sources.tars import _open_fs

# Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
BLOCK_LINES = 1000
# Captures of one index part, which one task sorts, writes and looks up.
PART_ROWS = 20_000
OPEN_FILES = 16


def search_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path, then the page's number, so that no two captures of one address tie."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url or "", flags=re.I)
    host, slash, path = rest.partition("/")
    host, colon, port = host.lower().rpartition("@")[2].partition(":")
    name = ",".join(reversed(host.split("."))) + colon + port + ")" + slash + path
    return f"{quote(name, safe='!$&()*+,-./:;=?@_~%')} {-1 if page_id is None else page_id:020d}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit holds the digest and the size of a payload kept elsewhere."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Ranges:
    """Range reads; keeps a few files open."""

    def __init__(self) -> None:
        self.files: OrderedDict = OrderedDict()

    def __call__(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            files, inner = _open_fs(path)
            self.files[path] = files.open_input_file(inner)
        self.files.move_to_end(path)
        return self.files[path].read_at(length, offset)


def revisits(pages: DataFrame) -> DataFrame:
    """Of pages with equal payloads of enough bytes, all but that of the largest id: ``page_id, digest, refers_to``."""
    facts = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
    facts = facts.filter(F.col("n") >= LEAST_REVISIT).select("page_id", "digest")
    groups = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return facts.join(groups, "digest").filter("page_id < refers_to or (page_id is null and refers_to is not null)").select(
        "page_id", "digest", "refers_to"
    ).distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages, one archive per task; captures as ``key, path, offset, length``.

    A task that is tried again writes another file; captures name those that count.
    """
    marked = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = revisits(pages).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    marked = marked.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sink, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for frame in batches:
                rows = []
                for page_id, url, text, refers_to in zip(*(frame[c] for c in ("page_id", "url", "html", "refers_to"))):
                    page_id, refers_to = (None if x != x or x is None else int(x) for x in (page_id, refers_to))
                    if sink is None:
                        files, inner = _open_fs(path)
                        files.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = files.open_output_stream(inner, compression=None)
                    data = record(page_id, url, text.encode("utf-8", "replace"), refers_to)
                    sink.write(data)
                    rows.append((search_key(url, page_id), path, offset, len(data)))
                    offset += len(data)
                yield pd.DataFrame(rows, columns=["key", "path", "offset", "length"])
        finally:
            if sink is not None:
                sink.close()

    columns = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return columns.mapInPandas(write, "key string, path string, offset bigint, length bigint")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into blocks; the directory as ``part, first_key, path, offset, length``, a row per block.

    ``captures`` has to be stored, as sorting by ranges reads it twice.
    """
    parts = max(1, -(-captures.count() // PART_ROWS))
    ordered = captures.repartitionByRange(parts, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sink, at = f"{folder}/{uuid.uuid4().hex}.cdx.gz", None, 0
        rows: list[tuple] = []
        held: list[tuple] = []

        def flush() -> None:
            nonlocal sink, at
            if sink is None:
                files, inner = _open_fs(path)
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = files.open_output_stream(inner, compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, line)) for line in held).encode())
            sink.write(data)
            rows.append((path, held[0][0], path, at, len(data)))
            at += len(data)
            held.clear()

        try:
            for frame in batches:
                for line in frame.itertuples(index=False):
                    held.append(tuple(line))
                    if len(held) >= BLOCK_LINES:
                        flush()
            if held:
                flush()
        finally:
            if sink is not None:
                sink.close()
        yield pd.DataFrame(rows, columns=["part", "first_key", "path", "offset", "length"])

    return ordered.mapInPandas(write, "part string, first_key string, path string, offset bigint, length bigint")


def look_up(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the captures with the given ``key`` values, each key once.

    The first keys of the index's parts go to the driver, one row per ``PART_ROWS``
    captures; a key's captures may reach from one part into the next.
    """
    firsts = [(r["first"], r["part"]) for r in directory.groupBy("part").agg(F.min("first_key").alias("first")).collect()]
    firsts.sort()
    starts, names = [f for f, _ in firsts], [p for _, p in firsts]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [
                (names[i], key)
                for key in frame["key"]
                for i in range(max(bisect.bisect_left(starts, key) - 1, 0), bisect.bisect_right(starts, key))
            ]
            yield pd.DataFrame(rows, columns=["part", "key"])

    def read(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["first_key", "offset"], ignore_index=True)
        first_keys = blocks["first_key"].tolist()
        fetch = Ranges()
        captures, held, lines, line_keys = [], -1, [], []
        for key in sorted(asked["key"]):
            b = max(bisect.bisect_left(first_keys, key) - 1, 0)
            while b < len(first_keys) and first_keys[b] <= key:
                if held != b:
                    held, where = b, blocks.loc[b]
                    data = zlib.decompress(fetch(where["path"], int(where["offset"]), int(where["length"])))
                    lines = [x.split("\t") for x in data.decode().split("\n")]
                    line_keys = [x[0] for x in lines]
                captures += lines[bisect.bisect_left(line_keys, key) : bisect.bisect_right(line_keys, key)]
                b += 1
        rows = []
        for _, path, offset, length in sorted(captures, key=lambda x: (x[1], int(x[2]))):
            fields, payload = parsed(fetch(path, int(offset), int(length)))
            page = fields["WARC-Record-ID"][10:-1]
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            size = int(fields["WARC-Payload-Length"])
            if fields["WARC-Type"] == "response":
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
            refers = fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
            rows.append((page, size, digest, fields["WARC-Type"], refers))
        return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    routed = keys.select("key").mapInPandas(route, "part string, key string")
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    found = routed.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(read, schema)
    number = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, then read each back through the index.

    Null html is an empty payload; null addresses share the empty key; a null id is
    written as such. Repeated rows give repeated records, all of them responses if
    they have the largest id of their payload.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captures = stored(write_archives(pages, folder), "captures")
    directory = stored(write_index(captures, folder), "directory")
    return look_up(directory, captures.select("key").distinct())


SQL = f"""
with p as (select page_id, strlen(coalesce(html,'')) n, sha1(coalesce(html,'')) d from pages),
m as (select d, max(page_id) m from p where n >= {LEAST_REVISIT} group by d)
select page_id, n::BIGINT payload_bytes, d payload_digest,
  case when n >= {LEAST_REVISIT} and page_id < m then 'revisit' else 'response' end record_type,
  case when n >= {LEAST_REVISIT} and page_id < m then m end refers_to
from p left join m using (d)"""


@query("op5_warc", SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
