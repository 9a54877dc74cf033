"""The operators on Spark, against plain versions on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from tests.oracle import connect, differences
from vecloom.llm import contamination, html_text, language, near, order_minhash, packing, repeats, rollup, tokens, toxicity, warc
from vecloom.llm.registry import ENTRIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RNG = random.Random(4)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "Über", "naïve"]


def sentence(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY) + str(RNG.randrange(40)) for _ in range(n))


def edited(text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        words[RNG.randrange(len(words))] = "edit" + str(RNG.randrange(999))
    return " ".join(words)


def corpus() -> list[tuple]:
    base = [sentence(60) for _ in range(6)]
    passage = sentence(14)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, edited(base[0], 4)) for i in range(12)]
    rows += [(30, base[1]), (31, base[1].upper()), (32, base[2] + " " + passage), (33, passage + " " + base[3])]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "ONE"), (45, "two words"), (46, "x" * 300), (47, "x" * 300), (48, "é" * 60)]
    rows += [(49, sentence(3000)), (None, base[4]), (50, "a b"), (51, "a b"), (51, "a b")]
    RNG.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_against_sql(spark, name):
    result = registered.queries()[name](spark, SMALL)
    assert differences(result, connect(SMALL), ENTRIES[name].sql) == []


def test_all_operators_and_the_pipeline_are_registered():
    names = set(registered.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {name.partition("_")[0] + "_" for name in names} and "pipeline" in names


# Near duplicates.


def brute_components(rows: list[tuple], k: int) -> dict:
    sets = {}
    for i, (_, text) in enumerate(rows):
        words = near.word_hashes(text, defaultdict(str)) if False else [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(len(words) - k + 1, 1))} if words else set()
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(documents, k):
    rows = corpus()
    found = near.linked(documents(rows), k).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)


def test_buckets_without_a_link_and_long_chains(documents, spark):
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.linked(documents(chain), 2).collect()) == brute_components(chain, 2)
    assert near.linked(documents([]), 2).count() == 0


def test_a_common_edit_makes_no_pairs(documents, spark, monkeypatch):
    met = []
    plain = near.candidates
    monkeypatch.setattr(near, "candidates", lambda *a: met.append(plain(*a)) or met[-1])
    rows = [(i, "very common pair very common words here " + t) for i, t in family([24 + i % 8 for i in range(300)])[1:]]
    rows.append((1000, family([])[0][1]))
    found = near.linked(documents(rows), 2).collect()
    assert len({r["component_id"] for r in found}) > 150 and met[-1].count() <= 300


def family(edits: list[int], size: int = 160, shared: int = 0) -> list[tuple]:
    """Copies of one text with so many own edits each; some edits are drawn from a few that copies share."""
    base = [f"b{i}" for i in range(size)]
    rows = [(1000, " ".join(base))]
    for n, count in enumerate(edits):
        words = list(base)
        for at in RNG.sample(range(size), count):
            words[at] = f"s{at}" if shared and RNG.randrange(100) < shared else f"e{n}x{at}"
        rows.append((n, " ".join(words)))
    return rows


@pytest.mark.parametrize("shared", [0, 60, 95])
def test_families_around_the_similarity(documents, shared):
    rows = family([RNG.randrange(1, 60) for _ in range(160)], shared=shared)
    found = near.linked(documents(rows), 2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows, 2)


def test_a_family_without_links_hardly_meets(documents, spark, monkeypatch):
    met = []
    plain = near.candidates
    monkeypatch.setattr(near, "candidates", lambda *a: met.append(plain(*a)) or met[-1])
    sizes = []
    for n in (100, 400):
        rows = family([24 + i % 8 for i in range(n)])
        assert len({r["component_id"] for r in near.linked(documents(rows), 2).collect()}) > n // 2
        sizes.append(met[-1].count())
    assert sizes[1] <= 400 and sizes[0] <= 100


def test_differences_are_exact(spark):
    sets = [sorted(RNG.sample(range(60), RNG.randrange(20, 40))) for _ in range(40)]
    pack = lambda v: bytearray(np.array(v, np.uint64).tobytes())
    name = lambda i: bytearray(f"{i:02d}".encode())
    table_ = spark.createDataFrame([(name(i), pack(v)) for i, v in enumerate(sets)], "node binary, elements binary")
    pairs = spark.createDataFrame([(name(0), name(i)) for i in range(1, 40)], "a binary, b binary")
    for similarity in (40, 60, 80):
        got = near.measured(pairs, table_, similarity)
        alike = lambda i, j: 100 * len(set(sets[i]) & set(sets[j])) >= similarity * len(set(sets[i]) | set(sets[j]))
        assert {int(bytes(r["b"])): r["linked"] for r in got.collect()} == {i: alike(0, i) for i in range(1, 40)}
        met = near.candidates(got.withColumn("comp", F.when(F.col("linked"), F.lit(b"00")).otherwise(F.col("b"))), similarity)
        found = {(int(bytes(r["a"])), int(bytes(r["b"]))) for r in met.collect()}
        wanted = {(i, j) for i in range(1, 40) for j in range(i + 1, 40) if alike(i, j) and not (alike(0, i) and alike(0, j))}
        assert wanted <= found


def test_components_of_paths_and_stars(spark):
    name = lambda i: bytearray(f"{i:04d}".encode())
    pairs = [(name(i), name(i + 1)) for i in range(40)] + [(name(100), name(100 + i)) for i in range(1, 30)] + [(name(3), name(3))]
    found = near.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()
    comps = {bytes(r["node"]): bytes(r["comp"]) for r in found}
    assert len(found) == 41 + 30
    assert {comps[bytes(name(i))] for i in range(41)} == {b"0000"} and {comps[bytes(name(100 + i))] for i in range(30)} == {b"0100"}


# Repeats.


def brute_repeats(rows: list[tuple]) -> Counter:
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49 if doc is not None else 0):
            w = data[i : i + 50]
            first[w] = min(doc, first.get(w, doc))
    out = Counter()
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49 if doc is not None else 0):
            if first[data[i : i + 50]] < doc:
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats_against_all_windows(documents):
    rows = corpus()
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = repeats.with_spans(documents(rows), repeats._digests, schema)
    assert Counter(tuple(r) for r in found.collect()) == brute_repeats(rows)
    assert repeats.with_spans(documents([]), repeats._digests, schema).count() == 0


def test_repeats_in_many_groups(documents, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    rows = corpus()
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = repeats.with_spans(documents(rows), repeats._digests, schema)
    assert Counter(tuple(r) for r in found.collect()) == brute_repeats(rows)


def test_repeats_stage_keeps_columns_and_whole_characters(documents, spark):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, None)]
    found = {r["doc_id"]: r for r in repeats.stage(spark, documents(rows).withColumn("bucket", F.lit(1)), "").collect()}
    assert found[2]["text"] == "xy" and found[2]["n_chars"] == 2 and found[1]["n_chars"] == 60 and found[3]["text"] is None
    assert found[1]["bucket"] == 1


# Contamination.


def test_contamination_against_every_window(documents, spark):
    items = [(i, sentence(n)) for i, n in enumerate((14, 30, 30, 57, 5, 3))] + [(6, None), (7, "")]
    rows = corpus() + [(100 + i, sentence(20) + " " + t + " " + sentence(9)) for i, t in items[:5]]
    rows += [(200, edited(items[3][1], 1)), (201, sentence(40) + items[0][1].upper()), (202, items[5][1]), (203, "and " + items[5][1])]
    known = near.WordHashes()
    expected = set()
    for doc, text in rows:
        words = near.word_hashes(text, known)
        found = near.shingles(words, 5)
        for item, passage in items:
            own = near.shingles(near.word_hashes(passage, known), 5)
            n = len(near.word_hashes(passage, known))
            if 0 < n < 5 or 0 < len(words) < 5:
                hit = n == len(words) and n > 0 and list(found) == list(own)
            else:
                size = len(own)
                hit = size > 0 and any(contamination.weighted_similarity(found[i : i + size], own) >= 0.8 for i in range(len(found) - size + 1))
            if hit and doc is not None:
                expected.add((doc, item))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.contaminated(documents(rows), table)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected and len(expected) >= 7
    clean = contamination.without_benchmark(documents(rows), table)
    kept = Counter(r["doc_id"] for r in clean.collect())
    assert set(kept) & {d for d, _ in expected} == set() and sum(kept.values()) == len(rows) - len({d for d, _ in expected})
    assert contamination.contaminated(documents(rows), table.filter("false")).count() == 0


def test_items_in_blocks_give_the_same(documents, spark, monkeypatch):
    items = [(i, sentence(20)) for i in range(9)]
    docs = documents([(i, t + " more") for i, t in items])
    table = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = list(contamination.item_blocks(table, 2))
    assert len(blocks) == 5 and sum(len(s.ids) for b in blocks for s in b.sizes.values()) == 9
    assert contamination.contaminated(docs, table).count() == 9


# Packing.


def test_packing_places_every_token_once(documents):
    rows = corpus()
    encoder = tokens.Encoder()
    found = packing.pack(documents(rows)).collect()
    expected, total = Counter(), 0
    for doc, text in rows:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > first else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(doc, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.1 * total / 2048 + 2
    assert packing.pack(documents([])).count() == 0


# Fingerprints.


def brute_fingerprint(text: str) -> str:
    if not text:
        return ""
    wrap = lambda x: x & 0xFFFFFFFFFFFFFFFF
    high = wrap(~0x7FFFFFFF)
    seen, chosen = Counter(), defaultdict(list)
    white = r" \t\n\x0b\f\r"
    units = re.findall(rf"[^{white}]{{1,16}}[{white}]*|[{white}]+", text)
    runs = [units[i : i + 2] for i in range(max(len(units) - 1, 1))]
    for place, run in enumerate(runs):
        h = 42
        for unit in run:
            h = xxhash.xxh64_intdigest(unit.encode(), h)
        h &= high
        number = seen[h]
        seen[h] += 1
        g = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) & high
        chosen[g >> 58].append((g, place))
    out = []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    every = sorted((item for items in chosen.values() for item in items), key=lambda x: signed(x[0] | x[1]))
    for b in range(64):
        if len(chosen[b]) >= 2:
            least = sorted(chosen[b], key=lambda x: signed(x[0] | x[1]))[:2]
            acc = 42
            for g, _ in sorted(least, key=lambda x: x[1]):
                acc = number(g, number(acc, 42))
        else:
            # The two least of all runs by a hash of the bin's own; a single run is its own pair.
            own = sorted(signed(number(b, number(g, 42))) for g, _ in every)
            first = lambda h: next(p for g, p in every if signed(number(b, number(g, 42))) == h)
            pair = sorted({own[0], *[h for h in own if h != own[0]][:1]}, key=first)
            acc = 42
            for h in pair:
                acc = number(wrap(h), acc)
        out.append(f"{acc:016x}")
    return "".join(out)


def test_fingerprints_against_a_plain_version(documents):
    rows = sorted({d: t for d, t in corpus() if d is not None}.items())
    found = {r["doc_id"]: r for r in order_minhash.fingerprints(documents(rows)).collect()}
    assert len(found) == len(rows)
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == brute_fingerprint(text) and r["edited_fingerprint"] == brute_fingerprint(changed)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text == after:
            assert r["near_next"] == 1.0


def test_fingerprints_of_few_and_odd_rows(documents):
    assert order_minhash.fingerprints(documents([])).count() == 0
    (one,) = order_minhash.fingerprints(documents([(7, "abc def")])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abc abc").hexdigest()
    rows = [(None, "x"), (None, "y"), (3, "z" * 50), (3, "z" * 50), (2**62, "w"), (-(2**62), None)]
    assert Counter(r["doc_id"] for r in order_minhash.fingerprints(documents(rows)).collect()) == Counter(d for d, _ in rows)


def test_order_of_passages_matters(spark):
    a, b = sentence(200), sentence(200)
    row = spark.createDataFrame([(a + " " + b, b + " " + a, a + " " + b)], "x string, y string, z string")
    marked = order_minhash.with_fingerprints(row, {"x": "fx", "y": "fy", "z": "fz"})
    near_, same = marked.select(order_minhash.likeness("fx", "fy"), order_minhash.likeness("fx", "fz")).head()
    assert same == 1.0 and 0.2 < near_ < 0.9


def independent_likeness(a: str, b: str, hashes: int = 64) -> float:
    """Order MinHash as it is defined: the two least runs of each of many hashes, in the order of the text."""

    def tuples(text: str) -> list[tuple]:
        words = text.split()
        runs = list(zip(words, words[1:]))
        hashed = lambda i, r: xxhash.xxh64_intdigest(" ".join(r), i)
        return [tuple(sorted(sorted(runs, key=lambda r: hashed(i, r))[:2], key=runs.index)) for i in range(hashes)]

    return sum(x == y for x, y in zip(tuples(a), tuples(b))) / hashes


def test_order_of_passages_matters_in_short_texts(spark):
    sizes = (20, 40, 60, 100)
    rows = []
    for n in sizes:
        for k in range(25):
            words = [f"w{n}x{k}x{i}" for i in range(n)]
            # A unit ends with its space, so the last word has one, too.
            rows.append((n, "".join(w + " " for w in words), "".join(w + " " for w in words[n // 2 :] + words[: n // 2])))
    marked = order_minhash.with_fingerprints(spark.createDataFrame(rows, "n int, x string, y string"), {"x": "fx", "y": "fy"})
    found = marked.select("n", "fx", order_minhash.likeness("fx", "fy").alias("near")).collect()
    assert all(len(r["fx"]) == 64 * 16 for r in found)
    for n in sizes:
        near_ = [r["near"] for r in found if r["n"] == n]
        expected = [independent_likeness(x, y) for m, x, y in rows if m == n]
        assert abs(sum(near_) / 25 - sum(expected) / 25) < 0.09, n


def test_likeness_of_short_rows_sees_their_order(documents):
    words = [f"w{i}" for i in range(30)]
    swapped = " ".join(words[15:] + words[:15])
    rows = order_minhash.fingerprints(documents([(1, " ".join(words)), (2, swapped), (3, "one")])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["near_next"] < 0.65
    # The likeness is that of the fingerprints returned.
    for one, after in ((1, 2), (2, 3), (3, 1)):
        cut = [[by_id[i]["fingerprint"][k : k + 16] for k in range(0, 1024, 16)] for i in (one, after)]
        assert by_id[one]["near_next"] == sum(x == y for x, y in zip(*cut)) / 64


def test_far_and_missing_ids_are_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    rows = rows.unionByName(spark.sql("select 1L << 60 doc_id, 'far' text"))
    placed = order_minhash.with_next(rows)
    assert placed.filter("_copy = 0").count() == 3001
    assert placed.groupBy("_at").count().agg(F.max("count")).head()[0] < 300


# Token counts.


def test_rollup_counts_batches_once(documents, spark, tmp_path):
    docs = documents(corpus())
    box = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert box.totals().count() == 0
    assert box.commit("a", rollup.inserts(docs)) and not box.commit("a", rollup.inserts(docs))
    encoder = tokens.Encoder()
    expected = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        for version, n in (("byte_bpe_50k", len(encoder.packed(r["text"])) // 4), ("words", len((r["text"] or "").split()))):
            expected[(r["source"], r["lang"], version)][0] += 1
            expected[(r["source"], r["lang"], version)][1] += n
    totals = lambda: {(r["source"], r["lang"], r["version"]): [r["documents"], r["tokens"]] for r in box.totals().collect()}
    assert totals() == expected
    old = docs.filter("doc_id < 20")
    new = old.withColumn("text", F.lit("one two three")).withColumn("lang", F.lit("fr"))
    assert box.commit("b", rollup.revisions(old, new))
    assert totals()[("s", "fr", "words")][1] == 3 * old.filter("source = 's'").count()
    assert box.commit("c", rollup.deletes(new)) and box.commit("d", rollup.inserts(old)) and totals() == expected
    assert box.commit("e", rollup.deletes(docs)) and totals() == {}
    with pytest.raises(ValueError):
        box.commit("no/name", docs)


def test_an_unfinished_batch_does_not_count(documents, spark, tmp_path):
    box = rollup.Rollup(spark, f"file://{tmp_path}/r")
    box.commit("a", rollup.inserts(documents([(1, "a b")])))
    (tmp_path / "r" / "batch=a" / "_SUCCESS").unlink()
    assert box.totals().count() == 0
    assert box.commit("a", rollup.inserts(documents([(1, "a b")]))) and box.totals().filter("version = 'words'").head()["tokens"] == 2


# Pages.


def test_pages_survive_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "PART_ROWS", 7)
    big, other = "<p>é</p>" * 200, "b" * 1000
    rows = [(i, f"http://h{i % 3}.example.org/{i % 2}", big) for i in range(8)] + [(20, "u", other), (21, None, other), (22, "u", "b" * 999), (23, "u", "b" * 999)]
    rows += [(30, "u", None), (31, "u", ""), (None, "u", big), (40, "u", "new"), (40, "u", "new"), (41, "u\n", other), (41, "u\n", other)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    top = {big: 7, other: 41}
    expected = Counter()
    for page, _, text in rows:
        data = (text or "").encode()
        least = top.get(text)
        again = least is not None and (page is None or page < least)
        expected[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", least if again else None)] += 1
    assert found == expected
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_html_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x</article>"), (3, "u", "<article>" + "<p>word</p>" * 20000)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["n_chars"], r["text"][:1]) for r in found) == [(0, ""), (0, ""), (1, "x"), (99999, "w")]
    assert all(r["text"] is not None for r in found)


# Classifiers, on held-out documents.


def test_language_of_held_out_documents(spark):
    found = ENTRIES["op7_language"].run(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right > 0.97
    assert found.filter("score < 0 or score > 1").isEmpty()


def test_language_of_odd_rows(documents, spark):
    docs = documents([(1, None), (2, ""), (3, "12 34"), (None, "alpha beta"), (4, "gamma")])
    out = language.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {None, 4}
    assert language.stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_toxicity_separates_held_out_documents(spark):
    found = ENTRIES["op1_toxicity"].run(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = [(r["score"], r["toxic"]) for r in found.filter("held_out").collect()]
    pos, neg = [s for s, x in rows if x], [s for s, x in rows if not x]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.95


def test_toxicity_without_labels(documents, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    found = toxicity.scores(documents([(1, None), (2, ""), (3, "a"), (None, "b")]), toxicity.fit(documents([(1, "a")]), labels)).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)


# Pipeline.


def test_stages_keep_the_columns_and_take_effect(documents, spark, tmp_path):
    rows = corpus()
    (tmp_path / "t").mkdir()
    passage = sentence(30)
    rows += [(60, "lead " + passage), (61, sentence(50))]
    docs = documents(rows).withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, f"{tmp_path}/t")
        if name != "packing":
            assert docs.schema.names == before.schema.names
    ids = {r["doc_id"] for r in docs.collect()}
    assert 60 not in ids and 61 in ids and not ids & {30, 40, 41, 42}
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, f"{tmp_path}/t").drop("sequence_id", "offset").collect()) == Counter(
        tuple(r) for r in docs.drop("sequence_id", "offset").collect()
    )


# Columns whose names the stages use themselves.


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_keep_columns_that_clash(spark, documents, stage, tmp_path):
    name, run = stage
    names = ["score", "lang_pred", "_copy", "_text", "part", "tag", "node", "bucket", "row", "a", "b", "size", "copy", "text ", "kept", "_n"]
    plain = documents([(i, sentence(60)) for i in range(20)] + [(30, None), (31, "")])
    docs = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names])
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = run(spark, docs, str(tmp_path)).collect()
    assert len(out) >= 20
    if name != "packing":
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in out for c in names) and out[0].asDict().keys() == set(docs.columns)


def test_rollup_of_copies_and_stutters(spark, documents):
    docs = documents([(1, "a b\na b\nc"), (2, "x"), (3, "x"), (4, None), (5, "a\n\n\nb"), (6, "x"), (7, "")])
    assert sorted(r["doc_id"] for r in rollup.copies(docs).collect()) == [3, 6]
    old, new = rollup.without_stutter(docs)
    assert {r["doc_id"]: r["text"] for r in new.collect()} == {1: "a b\nc", 5: "a\n\nb"} and old.count() == 2
    got = rollup.maintained(spark, docs, {"words": None}).agg(F.sum("documents"), F.sum("tokens")).head()
    assert tuple(got) == (5, 6)
    assert rollup.maintained(spark, docs.limit(0), {"words": None}).count() == 0


def test_scores_and_languages_of_odd_tables(spark, documents):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id bigint, toxic int")
    rows = [(i, ("bad stuff " if i % 2 else "nice thing ") * (1 + i % 5)) for i in range(60)]
    docs = documents([*rows, (61, None), (62, ""), (63, "x" * 200_000), (64, "nice thing " * 30_000), (65, rows[0][1]), (65, rows[0][1])])
    params = toxicity.train([t for _, t in rows], [i % 2 for i, _ in rows], steps=3)
    found = toxicity.scores(docs, params).collect()
    assert len(found) == 66 and all(0 <= r["score"] <= 1 for r in found)
    same = {r["score"] for r in found if r["doc_id"] in (0, 65)}
    assert len(same) == 1
    assert toxicity.scores(docs.limit(0), params).count() == 0
    nothing = toxicity.fit(docs.limit(0), labels.limit(0))
    assert len({r["score"] for r in toxicity.scores(docs, nothing).collect()}) == 1
    model = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, model, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None)], "page_id bigint, url string, html string")
    assert sorted(r["text"] for r in html_text.extract(pages).collect()) == ["", "a", "a"] and html_text.extract(pages.limit(0)).count() == 0
