"""The first pass of the repeats holds little of a batch at a time."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from vecloom.llm import repeats
from vecloom.llm.repeats import LENGTH, _find_anchors


def test_anchors_of_a_large_batch_take_little_memory():
    # 12 MB of text in one batch; characters beyond Latin-1 take two bytes each once decoded.
    texts = pa.array([f"{i:08d} " + "".join(chr(256 + (i * j) % 500) for j in range(1500)) for i in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), texts], ["doc_id", "text"])
    find = _find_anchors(64, LENGTH)
    tracemalloc.start()
    try:
        blocks = sum(1 for _ in find(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert blocks > 4 and peak < 80 << 20, peak


def test_buckets_are_smaller_than_parts(spark, monkeypatch):
    seen = {}

    def noted(buckets, length, find=repeats._find_anchors):
        seen["buckets"] = buckets
        return find(buckets, length)

    def parted(parts, share=repeats._shared_anchors):
        seen["parts"] = parts
        return share(parts)

    monkeypatch.setattr(repeats, "GROUP_BYTES", 2000)
    monkeypatch.setattr(repeats, "_find_anchors", noted)
    monkeypatch.setattr(repeats, "_shared_anchors", parted)
    passage = "a passage of over fifty bytes that stands in every document twice"
    docs = spark.createDataFrame([(i, f"{i:040d} {passage} {i:030d} {passage}") for i in range(40)], "doc_id bigint, text string")
    rows = repeats.with_spans(docs, repeats._digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()
    assert seen["buckets"] > seen["parts"] > 1
    assert {r.doc_id: r.n_spans > 0 for r in rows} == {i: i > 0 for i in range(40)}
