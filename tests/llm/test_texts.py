"""Edges of the operators on single texts, without Spark."""

from __future__ import annotations

import random
import warnings
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import contamination, html_text, language, near, packing, recurrent, repeats, shingles, tokens, toxicity, warc


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    table, u = rng.standard_normal((9, 5)), rng.standard_normal((3 * 3, 3))
    ids = rng.integers(0, 5, (4, 6))
    mask = (np.arange(4)[:, None] < rng.integers(1, 5, 6)).astype(np.float32)
    weight = rng.standard_normal((4, 3, 6))

    def loss(t, v):
        return float((recurrent.run(t.astype(np.float32), v.astype(np.float32), ids, mask, False) * weight).sum())

    _, kept = recurrent.run(table.astype(np.float32), u.astype(np.float32), ids, mask, False, keep=True)
    d_x, d_u = recurrent.back(u.astype(np.float32), mask, kept, weight.astype(np.float32))
    d_table = recurrent.scatter(d_x, ids, 5)
    for array, grad in ((table, d_table), (u, d_u)):
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in array.shape)
            before, step = array[at], 1e-2
            array[at] = before + step
            high = loss(table, u)
            array[at] = before - step
            low = loss(table, u)
            array[at] = before
            assert abs((high - low) / (2 * step) - grad[at]) < 2e-2


def test_toxicity_gradients_agree_with_differences():
    p = toxicity._init(3)
    items, ids, owner = toxicity._windows([[b"aa", b"b", b"cc"] * 15, [b"d"]])
    labels = np.array([1.0, 0.0])

    def loss():
        logits = toxicity.window_logits(p, toxicity.word_tables(p, items), ids)
        doc = []
        for i in range(2):
            own = logits[owner == i].astype(float)
            w = np.exp(2 * (own - own.max()))
            doc.append((w * own).sum() / w.sum())
        s = 1 / (1 + np.exp(-np.array(doc)))
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    grads = toxicity._gradients(p, items, ids, owner, labels)
    for name in ("o", "av", "aw"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        before = p[name][at]
        p[name][at] = before + 1e-2
        high = loss()
        p[name][at] = before - 1e-2
        low = loss()
        p[name][at] = before
        assert (high - low) * grads[name][at] > 0


def test_scores_do_not_depend_on_the_company():
    p = toxicity._init(1)
    texts = ["one two three", "", None, "word " * 200, "x" * 100, "one two three"]
    together = toxicity.Scorer(p)(texts)
    alone = [toxicity.Scorer(p)([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)
    assert together[0] == together[5]
    assert ((together >= 0) & (together <= 1)).all()


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 200):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered


def test_every_window_of_words_is_scored():
    p = toxicity._init(5)
    found = [f"w{i % 37}x{i}" for i in range(90)]
    windows = [" ".join(found[i : i + toxicity.WINDOW]) for i in range(90 - toxicity.WINDOW + 1)]
    scores = toxicity.Scorer(p)(windows)
    whole, other, part = toxicity.Scorer(p)([" ".join(found), "lead " * 50, " ".join(found[1:72])])
    assert abs(whole - scores.max()) < 1e-6 and abs(part - scores[1:41].max()) < 1e-6
    # The greatest window counts wherever it stands; windows at each 24th or 16th word miss it.
    best = int(scores.argmax())
    for lead in range(24):
        text = found[max(best - lead, 0) : best + toxicity.WINDOW + 9]
        assert abs(toxicity.Scorer(p)([" ".join(text)])[0] - scores.max()) < 1e-6


def test_language_edges():
    model = language.train(["uno dos tres"] * 5 + ["eins zwei drei"] * 5, ["es"] * 5 + ["de"] * 5, steps=30)
    langs, scores = language.Labeller(*model)([None, "", "123 !?", "uno", "drei " * 1000, "uno"])
    assert langs[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    assert langs[3] == langs[5] == "es" and langs[4] == "de"
    assert language.Labeller([], {})(["uno"]) == (["und"], [0.0])


def test_every_coordinate_of_a_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 2, 100, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        sketch = near.sketch_sets([a, a.copy()])
        assert (sketch != np.iinfo(np.uint64).max).all() and (sketch[0] == sketch[1]).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sketch = near.sketch_sets([a, b])
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1200) < 0.15


def test_word_rules():
    assert shingles.words("A\x0bB\x1cC D É") == [b"a", "b\x1cc d".encode(), "É".encode()]
    known = shingles.WordHashes()
    assert len(shingles.shingles(shingles.word_hashes("a b c", known), 2)) == 2
    assert len(shingles.shingles(shingles.word_hashes("a", known), 2)) == 1
    assert len(shingles.shingles(shingles.word_hashes(None, known), 2)) == 0


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh ", bytes(range(250))])
def test_two_stage_sort_groups_equal_windows(letters):
    rng = random.Random(len(letters))
    found = [bytes(rng.choice(letters) for _ in range(rng.randint(50, 84))) for _ in range(40)]
    found += [b"a" * 70, b"a" * 60 + b"b" * 20, b"b" * 55, found[0][:60]]
    classes, owner, offset = repeats.window_classes(found, 50)
    windows = [found[o][f : f + 50] for o, f in zip(owner, offset)]
    assert len(set(zip(classes, windows))) == len(set(windows)) == len(set(classes))


def test_two_stage_sort_is_a_suffix_sort():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(400)) + b"\xff"
    order = repeats.two_stage(np.frombuffer(data + bytes(80), np.uint8), len(data), 60)
    expected = sorted(range(len(data)), key=lambda i: data[i : i + 60])
    assert [data[i : i + 60] for i in order] == [data[i : i + 60] for i in expected]


def _brute_sequences(counts: dict[int, int]) -> int:
    return -(-sum(n * c for n, c in counts.items()) // packing.CAPACITY)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 800) if seed % 2 else np.minimum(rng.geometric(0.002, 3000), 2048)
    counts = dict(Counter(lengths.tolist()))
    plan = packing.Plan(counts)
    placed, ranks = {}, {}
    for length, rank, n, sequence, offset in plan.runs:
        for i in range(n):
            placed.setdefault(sequence + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for items in placed.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(placed) <= 1.03 * _brute_sequences(counts) + 3


def test_plan_of_nothing_and_of_one_length():
    assert packing.Plan({}).runs == []
    assert packing.Plan({1: 5000}).sequences == 3
    assert packing.Plan({2048: 7}).sequences == 7
    assert packing.Plan({1025: 4}).sequences == 4


def test_tokens_are_those_of_the_tokenizer():
    encoder = tokens.Encoder()
    texts = ["", "I'll say: don't!  \n\n x", "été ×÷ ²³ ½", "日本語 テスト", "a\x1cb\x1fc\x85d\xa0e　f", "<|endoftext|> x", " 's 'S", "tab\t\tend \r\n", "１２ Ⅳ ª º"]
    for text in texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == ids, text
    assert encoder.packed(None) == b""


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a &amp; b</p><p>c\n d</p>", "a & b c d"),
        ("<article><h1>T</h1><p>x <b>y</b>z<div class='ad'>Buy this now</div><p>w</article>", "T x yz w"),
        ("<script>if (a<b) {}</script><article>x<script>1", "x"),
        ("<nav><a href=/>Home</a></nav><article>x</article><div id='comments'>" + "I agree. " * 40 + "</div>", "x"),
        ("<article>1 < 2 and <!-- gone --> so<!-- open", "1 < 2 and so"),
        ("<p title=\"a > b\">x</p>", "x"),
        ("<title>t</title><style>p{}</style>", ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_html_of_many_open_brackets_is_quick():
    assert html_text.main_text("<p>x" + "<a '" * 2000).startswith("x")


def test_contamination_edges():
    item = " ".join(f"w{i}" for i in range(40))
    index = contamination.Index([(1, item), (2, "two words"), (3, None), (4, "  "), (5, item.upper())])
    known = shingles.WordHashes()
    hits = lambda text: index.hits(shingles.word_hashes(text, known))
    assert set(hits("before it " + item + " after it")) == {1, 5}
    assert hits("before it " + item)[1] == (1.0, 2, 40)
    assert hits("these are two words") == {} and set(hits("Two words")) == {2}
    assert hits(None) == hits("") == hits("w1 w2 w3 w4 w5 w6") == {}
    assert set(hits(item.replace("w39", "other"))) == {1, 5}
    assert hits(item.replace("w20", "other")) == {}


def test_contamination_of_truncated_items():
    passage = [f"w{i}" for i in range(50)]
    index = contamination.Index([(1, " ".join(passage)), (2, " ".join(f"v{i}" for i in range(50)))])
    known = shingles.WordHashes()
    hits = lambda found: index.hits(shingles.word_hashes(" ".join(found), known))
    assert hits(passage[:45]) == {1: (41 / 46, 0, 45)} and hits(passage[5:]) == {1: (41 / 46, 0, 45)}
    assert hits(passage[3:44]) == {1: (37 / 46, 0, 41)}
    assert hits(passage[:40]) == hits(passage[:5]) == hits(["x"] * 45) == {}


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    sized = contamination.SizeClass(list(range(50)), [rng.integers(0, 2**63, 20).astype(np.uint64) for _ in range(50)])
    sized.freeze()
    for _ in range(200):
        i = int(rng.integers(50))
        flips = rng.choice(64, int(rng.integers(0, contamination.RADIUS + 1)), replace=False)
        print_ = int(sized.prints[i])
        for f in flips:
            print_ ^= 1 << int(f)
        near_ = sized.near(print_)
        assert i in near_
        assert all((int(sized.prints[j]) ^ print_).bit_count() <= contamination.RADIUS for j in near_)


def test_records_survive_the_round_trip():
    payload = "<p>é\r\n\r\n</p>".encode()
    fields, body = warc.parsed(warc.record(7, "http://a.b/ü\n?x=1", payload, None))
    assert body == payload and fields["WARC-Type"] == "response"
    fields, body = warc.parsed(warc.record(None, None, payload, 9))
    assert body == b"" and fields["WARC-Refers-To"] == "<urn:page:9>" and fields["WARC-Record-ID"] == "<urn:page:null>"
    assert warc.search_key("https://a.Example.org:80/P?q=\t", 3).startswith("org,example,a:80)/P?q=%09 ")


def test_a_body_outside_the_teasers():
    body = ["Title of it", "Body words go on and on. " * 20, "More of the body text here. " * 15, "Short end."]
    inner = "".join(f"<p>{x}</p>" for x in body)
    teasers = "".join(f'<article><h2><a href="{i}">Teaser card {i}</a></h2></article>' for i in range(6))
    want = " ".join(" ".join(x.split()) for x in body)
    for page in (f'<div id="content">{inner}</div>{teasers}', f'{teasers}<div id="content">{inner}</div>', f'{teasers}<div>{inner}</div>{teasers}'):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == want


def test_an_article_keeps_its_short_parts():
    parts = ["Head", "Long text of the article. " * 30, "ok", "Another long part here. " * 30, "End."]
    page = '<article><div class="advert">Buy this now, it is cheap and very good for you.</div>'.join(f"<p>{x}</p>" if i else f"<article><p>{x}</p>" for i, x in enumerate(parts))
    assert html_text.main_text(f"<main>{page}</main>") == " ".join(" ".join(x.split()) for x in parts)


def plain_main_text(blocks: list[tuple[int, str]]) -> str:
    """Blocks of (article, text), an empty text for a gap of three lines, by the rule as it is stated."""
    flat = [line for article, text in blocks for line in ([(article, text)] if text else [(0, "")] * 3)]
    weigh = lambda line: len(line[1]) * (5 if line[0] else 1)
    sums = [sum(map(weigh, flat[i : i + 3])) for i in range(len(flat))]
    sums = [sum(map(weigh, flat[max(i - 2, 0) : i + 1])) for i in range(2, len(flat) + 2)]
    runs, current = [], []
    for i, total in enumerate(sums):
        if total:
            current.append(i)
        elif current:
            runs.append(current)
            current = []
    runs += [current] if current else []
    top = max(sums, default=0)
    out = []
    for run in runs:
        own = {flat[i][0] for i in run if i < len(flat) and flat[i][0]}
        peak = max(max(sums[i] for i in other) for other in runs if other is run or own & {flat[i][0] for i in other if i < len(flat)})
        if peak * 5 >= top:
            out += [flat[i][1] for i in run if i < len(flat) and flat[i][1]]
    return " ".join(out)


def test_pages_of_lines_against_the_rule():
    rng = random.Random(5)
    for _ in range(300):
        blocks, page = [], []
        for number in range(rng.randint(1, 6)):
            article = number + 1 if rng.random() < 0.4 else 0
            texts = ["w" * rng.choice([3, 20, 90, 400]) for _ in range(rng.randint(1, 4))]
            lines = "".join(f"<p>{t}</p>" for t in texts)
            if article:
                page.append(f"<article>{lines}</article>")
                blocks += [(0, ""), *((article, t) for t in texts), (0, "")]
            else:
                page.append(f"<div>{lines}</div><nav>menu</nav>")
                blocks += [*((0, t) for t in texts), (0, ""), (0, "")]
        assert html_text.main_text("".join(page)) == plain_main_text(blocks), page


def test_sliding_windows_agree_with_one_window_at_a_time(monkeypatch):
    p = {k: v.astype(np.float64) for k, v in toxicity._init(4).items()}
    rng = np.random.default_rng(4)
    tables = [rng.standard_normal((3 * toxicity.WORD_HIDDEN, 50)).astype(np.float32) for _ in "fb"]
    for table in tables:
        # Gates and candidates far out of the range of exp.
        table[:, 7], table[:, 8] = 300, -300
    run = rng.integers(1, 50, toxicity.WINDOWS_AT_ONCE + 3 * toxicity.WINDOW)
    run[100:140] = 7
    run[110] = 8

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def logit(window):
        states = []
        for table, d in zip(tables, "fb"):
            h, seen, u = np.zeros(toxicity.WORD_HIDDEN), [], p["wu" + d]
            for word in window if d == "f" else window[::-1]:
                (xr, xz, xn), (gr, gz, gn) = np.split(table[:, word].astype(float), 3), np.split(u @ h, 3)
                z = sigmoid(xz + gz)
                h = (1 - z) * np.tanh(xn + sigmoid(xr + gr) * gn) + z * h
                seen.append(h)
            states.append(seen if d == "f" else seen[::-1])
        h = np.concatenate([np.array(s) for s in states], axis=1)
        share = np.exp(np.tanh(h @ p["aw"].T) @ p["av"][0])
        return p["o"][0] @ (share @ h / share.sum()) + p["c"][0, 0]

    at = [*range(60, 150), *range(toxicity.WINDOWS_AT_ONCE - 5, toxicity.WINDOWS_AT_ONCE + 2 * toxicity.WINDOW + 1)]
    expected = [logit(run[i : i + toxicity.WINDOW]) for i in at]
    single = {k: v.astype(np.float32) for k, v in p.items()}
    # The costliest function of the old way is not called at all, and numbers too great are no trouble.
    monkeypatch.setattr(np, "tanh", None)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = toxicity.sliding_logits(single, tables, run)
        short = toxicity.sliding_logits(single, tables, run[60 : 60 + toxicity.WINDOW])
    assert len(found) == len(run) - toxicity.WINDOW + 1 and np.isfinite(found).all()
    assert np.allclose(found[at], expected, atol=1e-5) and np.allclose(short, expected[:1], atol=1e-5)
