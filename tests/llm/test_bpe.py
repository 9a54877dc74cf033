"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vecloom.llm import bpe
from vecloom.llm.registry import ENTRIES


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def _ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash_is_minimal(vocab):
    assert sorted(vocab.places(vocab.tokens).tolist()) == list(range(len(vocab.tokens)))
    assert (vocab.whole(vocab.tokens) == vocab.ids).all()
    others = [b"", b"\x00\x01\x02", b"q" * 500]
    assert [i for i in vocab.whole(others) if i >= 0] == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50])
def test_perfect_hash_of_few_keys(n):
    keys = [f"k{i}".encode() for i in range(n)]
    found = bpe.PerfectHash(keys)
    if n:
        assert found(keys).tolist() == list(range(n))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def _merged_plainly(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_heap_merges_as_a_plain_search_does(vocab):
    rng = random.Random(0)
    for _ in range(400):
        letters = rng.choice([b"ab", b"aeinrst ", bytes(range(256)), "éüあ🙂".encode()])
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert vocab.merged(piece) == _merged_plainly(vocab.ranks, piece)


TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world, it's 2024!", "aaaa" * 5000, "a b" * 70_000, "\x1c\x1d x\x85y\xa0z", "<|endoftext|> x",
    "日本語のテキスト 🙂🙂 é", "x" * 3000 + " " * 3000, "don't DON'T we'll  ", " 　 ab", "0123456789" * 50, "Ünïcödé çà",
]


def test_texts_as_the_library_encodes_them(vocab, library, monkeypatch):
    rng = random.Random(1)
    letters = "abcXYZ 0'.,\n\t\r\x1céあ🙂́ "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    want = [library.encode_ordinary(text or "") for text in texts]
    assert [_ids(found) for found in bpe.Encoder(vocab)(texts)] == want
    # Long texts go in parts, and a full memory is emptied, without a change.
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "WAITING", 20)
    assert [_ids(found) for found in bpe.Encoder(vocab)(texts)] == want


def test_columns_ids_and_bytes(spark, library):
    rows = [(i, t, None if i % 2 else "x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "ids bigint, text string, k0 string")
    out = bpe.encoded(docs, ["ids", "k0"], ids="packed").withColumn("back", bpe.decoded("packed")).collect()
    assert len(out) == len(rows)
    for row in out:
        text = TEXTS[row["ids"]] or ""
        assert _ids(row["packed"]) == library.encode_ordinary(text)
        assert bytes(row["back"]) == text.encode() and row["k0"] == (None if row["ids"] % 2 else "x")
    assert bpe.encoded(docs.limit(0), ["ids"]).count() == 0
    unknown = spark.range(1).select(F.lit(b"\xff\xff\xff\xff").alias("ids")).select(bpe.decoded("ids"))
    with pytest.raises(Exception, match="4294967295"):
        unknown.collect()


def test_query_on_whole_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ENTRIES["op11_byte_bpe"].run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
