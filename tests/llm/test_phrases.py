"""Phrases against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import phrases
from vecloom.llm.registry import ENTRIES


def _plain(rows, max_words=3, min_count=10, absorbed=50, top=2000):
    """The first phrases of each language from all occurrences, by the definition."""
    found, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = found.setdefault(lang, Counter())
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in found.items():
        chosen = []
        for p, a in counts.items():
            if len(p) < 2 or a < min_count:
                continue
            holders = [q for q, f in counts.items() if len(q) > len(p) and f >= min_count and 100 * f >= absorbed * a]
            if any(q[i : i + len(p)] == p for q in holders for i in range(len(q) - len(p) + 1)):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            chosen.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(chosen)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def _texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "x y", "a\x1cb", "日本"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]
    rows = []
    for _ in range(n):
        text = "".join(w + rng.choice(ends) for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + " New York City" * rng.randint(0, 3)))
    return rows + [("en", None), ("de", ""), ("de", " . "), (None, None)]


def _found(spark, texts, **options):
    docs = spark.createDataFrame([(lang, text, 1, "s") for lang, text in texts], "lang string, text string, n int, word string")
    out = phrases.mined(docs.repartition(3), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_against_a_plain_count(spark):
    rows = _texts(0)
    assert _found(spark, rows) == _plain(rows)


@pytest.mark.parametrize("ranked", [0, 3, 40])
def test_units_beyond_the_ranked_ones_are_counted(spark, ranked):
    rows = _texts(1)
    assert _found(spark, rows, ranked=ranked) == _plain(rows)


def test_longer_phrases_and_other_bounds(spark):
    texts = _texts(2)
    options = {"max_words": 4, "min_count": 4, "absorbed": 80, "ranked": 30}
    assert _found(spark, texts, rows=7, **options) == _plain(texts, 4, 4, 80, 7)


def test_ties_go_by_bytes(spark):
    rows = [("en", f"{a} {b}") for a, b in [("é", "z"), ("z", "é"), ("ｚ", "b"), ("😀", "b2"), ("", "b3")] for _ in range(10)]
    assert _found(spark, rows) == _plain(rows)


def test_small_memory_changes_nothing(spark, monkeypatch):
    rows = _texts(3)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    monkeypatch.setattr(phrases, "REMEMBERED", 10)
    monkeypatch.setattr(phrases, "AT_ONCE", 50)
    monkeypatch.setattr(phrases, "BLOB", 40)
    assert sorted(tuple(r) for r in phrases.mined(docs).collect()) == _plain(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.mined(docs).count() == 0
    assert _found(spark, [(None, None), ("en", "one two")]) == []


def test_dense_and_sparse_tiles_agree(monkeypatch):
    rng = np.random.default_rng(0)
    left, right = (rng.zipf(1.3, 50_000) % 5000 for _ in range(2))
    want = Counter(zip(left.tolist(), right.tolist()))
    for dense in (1, 500, 10**9):
        monkeypatch.setattr(phrases, "DENSE", dense)
        got = Counter()
        for a, b, n in phrases.tiled(left, right, 5000):
            for key in zip(a.tolist(), b.tolist(), n.tolist()):
                assert key[:2] not in got
                got[key[:2]] = key[2]
        assert got == want


def test_equal_hashes_are_told_apart(monkeypatch):
    members = np.array([[3, 4], [1, 2]])
    level = phrases.Level(phrases.phrase_hash(members), members, None)
    words = np.array([[1, 2], [3, 4], [4, 3]])
    assert level.phrases(words).tolist() == [1, 0, phrases.NONE]
    monkeypatch.setattr(phrases, "phrase_hash", lambda w, seed=0: np.full(len(w), 7))
    assert phrases.Level(np.array([7]), members[:1], None).phrases(words).tolist() == [phrases.NONE, 0, phrases.NONE]


def test_query_agrees_with_its_sql(spark):
    from tests.oracle import connect, differences

    entry = ENTRIES["op12_phrases"]
    sf = "/root/testdata/sf0.001"
    assert differences(entry.run(spark, sf), connect(sf), entry.sql) == []
