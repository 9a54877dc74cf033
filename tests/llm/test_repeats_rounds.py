"""The repeats judge their buckets in rounds and slices, so that snippets take bounded disk and memory."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.test_operators import brute_repeats
from vecloom.llm import repeats

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _copied(n: int) -> list[tuple[int | None, str | None]]:
    """Texts of which nearly all stands in another one too, some cut or changed, with a repeated id, nulls and short ones."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghij é", k=draw.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 120))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t[draw.randint(0, 40) :]) for i, t in enumerate(texts)]
    return rows + [(3, texts[5]), (None, texts[0]), (2000, None), (2001, "short"), (-5, texts[9] + " " + texts[10])]


def test_rounds_give_the_repeats_of_all_windows(documents, monkeypatch):
    made, stored = [], repeats.stored

    def noted(df, name):
        found = stored(df, name)
        made.append((name, found))
        return found

    monkeypatch.setattr(repeats, "stored", noted)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 5000)
    monkeypatch.setattr(repeats, "SORT_BYTES", 4000, raising=False)
    monkeypatch.setattr(repeats, "ROUND_BYTES", 5000, raising=False)
    rows = _copied(40)
    found = repeats.with_spans(documents(rows), repeats._digests, SCHEMA).collect()
    assert Counter(tuple(r) for r in found) == brute_repeats(rows)
    spans = [df for name, df in made if name == "spans"]
    # Snippets are some four times the text here, and each round has its own.
    assert len(spans) > 2 and all(df.count() for df in spans)


def test_texts_that_repeat_little_take_one_round(documents, monkeypatch):
    names, stored = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = [(i, f"{i * 7919:060d}" + "a passage that two documents share, of over fifty bytes" * (i < 2)) for i in range(20)]
    found = repeats.with_spans(documents(rows), repeats._digests, SCHEMA).collect()
    assert Counter(tuple(r) for r in found) == brute_repeats(rows)
    assert names == ["anchors", "spans"]


def test_a_full_bucket_is_dealt_to_slices(monkeypatch):
    monkeypatch.setattr(repeats, "SORT_BYTES", 20_000, raising=False)
    hashes = np.repeat(np.arange(5000, dtype=np.uint32) * np.uint32(2654435761), 2)
    doc, lo = np.tile([-4, 9], 5000), np.arange(10_000, dtype=np.uint32)
    row = {"bucket": 3, "hash": hashes.tobytes(), "doc": repeats._planes(doc), "lo": repeats._planes(lo), "more": bytes(10_000)}
    out = repeats._shared_anchors(4)(pa.Table.from_pylist([row], repeats.ANCHOR))
    members, places = Counter(), []
    for r in out.to_pylist():
        members[r["bucket"]] += len(r["more"])
    for column, kind in (("lo", "u4"), ("doc", "i8")):
        places.append(repeats._joined(out[column], kind))
    assert sorted(zip(*(p.tolist() for p in places))) == sorted(zip(lo.tolist(), doc.tolist()))
    assert max(members.values()) * 67 < 2 * 20_000
    # Both members of a hash stay together.
    of = {int(a): r["bucket"] for r in out.to_pylist() for a in repeats._numbers(pa.chunked_array([[r["lo"]]]), "u4")[0]}
    assert all(of[2 * i] == of[2 * i + 1] for i in range(5000))


def test_spans_are_merged_by_row():
    draw = random.Random(3)
    for n in (0, 1, 400):
        spans = [(draw.randrange(6), a, a + draw.randint(1, 30)) for a in (draw.choice([draw.randrange(900), 4_294_967_000]) for _ in range(n))]
        covered = [set() for _ in range(7)]
        for row, a, b in spans:
            covered[row].update(range(a, b))
        row, lo, hi = (np.array([s[i] for s in spans], np.uint32) for i in range(3))
        out = repeats.merged(row, lo, hi, 7)
        assert [set().union(*(range(a, b) for a, b in s)) for s in out] == covered
        assert all(b < c for s in out for (_, b), (c, _) in zip(s, s[1:]))
