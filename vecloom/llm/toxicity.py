"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the states of a small recurrent network over its characters (its
UTF-8 bytes) at both ends, and as a vector by hash of the word. Windows of ``WINDOW``
words, one from every word on, go through the word network; attention pools its states
into the window's score. A document's score is the greatest of its windows, which is
also how the network learns from labels of whole documents: the windows share the
gradient by a softmax of their scores. The fit takes windows that overlap by half.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm import recurrent as net
from vecloom.llm.frames import Numbered, held_out
from vecloom.llm.registry import FOLDS, query
from vecloom.plans.catalog import table

WINDOW = 32
STRIDE = 1
FIT_STRIDE = 16
CHAR_HIDDEN = 6
WORD_HIDDEN = 8
BUCKETS = 4096
WORD_BYTES = 24
# The fit sees at most so many documents of each label; a text of more characters than
# ``FIT_CHARS`` gives it pieces from end to end.
FIT_DOCS = 1200
FIT_CHARS = 100_000
FIT_PIECES = 64
# Windows of a document that a step of the fit sees, drawn from all of them.
FIT_WINDOWS = 512
STEPS = 400
# Share of words that a step of the fit knows by their characters alone.
UNKNOWN = 0.5
BATCH = 32
RATE = 0.04
# Distinct words a task keeps, and windows it scores at a time.
WORDS_KEPT = 300_000
WINDOWS_AT_ONCE = 2048

PAD = 0
WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case words of letters, digits and whatever is not ASCII; one longer than ``WORD_BYTES`` counts as several."""
    out = WORD.findall(text.lower().encode("utf-8", "replace")) if text else []
    if max(map(len, out), default=0) > WORD_BYTES:
        out = [w[i : i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out


def window_starts(n: int, stride: int = STRIDE) -> range:
    """First words of windows; the last reaches the end, a text without words has one of padding."""
    return range(0, max(n - WINDOW + stride, 1), stride)


def _init(seed: int) -> net.Params:
    rng = np.random.default_rng(seed)
    p: net.Params = {}
    for d in "fb":
        p["cg" + d] = net.init(rng, 3 * CHAR_HIDDEN, 256, scale=0.3)
        p["cu" + d] = net.init(rng, 3 * CHAR_HIDDEN, CHAR_HIDDEN)
        p["wc" + d] = net.init(rng, 3 * WORD_HIDDEN, 2 * CHAR_HIDDEN)
        p["we" + d] = net.init(rng, 3 * WORD_HIDDEN, BUCKETS, scale=0.1)
        p["wu" + d] = net.init(rng, 3 * WORD_HIDDEN, WORD_HIDDEN)
    p["aw"] = net.init(rng, WORD_HIDDEN, 2 * WORD_HIDDEN)
    p["av"] = net.init(rng, 1, WORD_HIDDEN)
    p["o"] = net.init(rng, 1, 2 * WORD_HIDDEN)
    p["c"] = np.full((1, 1), -1.0, np.float32)
    return p


def buckets(items: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in items), np.int64, len(items))


def word_tables(p: net.Params, items: list[bytes], keep: bool = False, known: np.ndarray | None = None):
    """Input columns of distinct words for both directions; column 0 is padding.

    ``known`` weighs the vectors by hash; a word without one is known by its characters alone.
    """
    ids, mask = net.padded(items)
    kept, ends = [], []
    for d in "fb":
        states = net.run(p["cg" + d], p["cu" + d], ids, mask, d == "b", keep=keep)
        if keep:
            states, steps = states
            kept.append(steps)
        ends.append(states[0] if d == "b" else states[-1])
    vectors = np.concatenate(ends)
    at = buckets(items)
    tables = []
    for d in "fb":
        own = p["we" + d][:, at]
        columns = p["wc" + d] @ vectors + (own if known is None else own * known)
        tables.append(np.concatenate([np.zeros((3 * WORD_HIDDEN, 1), np.float32), columns], axis=1))
    return (tables, (ids, mask, kept, vectors, at)) if keep else tables


def window_logits(p: net.Params, tables: list[np.ndarray], ids: np.ndarray, keep: bool = False):
    """Logit of each window; ``ids`` are columns of the tables, ``(WINDOW, n)``, 0 for padding."""
    mask = (ids != PAD).astype(np.float32)
    runs = [net.run(tables[i], p["wu" + d], ids, mask, d == "b", keep=keep) for i, d in enumerate("fb")]
    h = np.concatenate([r[0] if keep else r for r in runs], axis=1)
    logits, pooling = _pooled(p, h, mask)
    return (logits, (mask, [r[1] for r in runs], h, *pooling)) if keep else logits


def sliding_logits(p: net.Params, tables: list[np.ndarray], run: np.ndarray) -> np.ndarray:
    """Logit of the window from each place of a run of columns on, as far as whole windows go."""
    out = np.empty(len(run) - WINDOW + 1)
    # Of the states, attention and output need these products only, which add up over the directions.
    taps = np.split(np.concatenate([2 * p["aw"], p["o"]]), 2, axis=1)
    # As tanh(a) is 1 - 2 / (1 + exp(2 a)); what all energies of a window have in common does not count.
    av = -2 * p["av"]
    one = np.array(1, np.float32)
    size = min(WINDOWS_AT_ONCE + WINDOW - 1, len(run))
    forward = np.empty((WINDOW, WORD_HIDDEN + 1, size), np.float32)
    energy, value = np.empty((2, WINDOW, size), np.float32)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), WINDOWS_AT_ONCE):
            part = run[a : a + size]
            n = len(part)
            for t, seen in net.slide(tables[0][:, part], p["wuf"], taps[0], WINDOW, False):
                forward[t, :, :n] = seen
            for t, seen in net.slide(tables[1][:, part], p["wub"], taps[1], WINDOW, True):
                np.add(seen, forward[t, :, :n], out=seen)
                tanh = seen[:-1]
                np.exp(tanh, out=tanh)
                np.add(tanh, one, out=tanh)
                np.reciprocal(tanh, out=tanh)
                energy[t, :n] = (av @ tanh)[0]
                value[t, :n] = seen[-1]
            n -= WINDOW - 1
            share = np.exp(energy[:, :n] - energy[:, :n].max(axis=0))
            out[a : a + n] = (share * value[:, :n]).sum(axis=0) / share.sum(axis=0) + p["c"][0, 0]
    return out


def _pooled(p: net.Params, h: np.ndarray, mask: np.ndarray | None):
    """Logits of windows of states ``(WINDOW, 2 * WORD_HIDDEN, n)`` by attention, and what the gradients need."""
    tanh = np.matmul(p["aw"], h)
    np.tanh(tanh, out=tanh)
    energy = np.matmul(p["av"], tanh)[:, 0]
    if mask is not None:
        energy += (mask - 1) * 1e4
    energy = np.exp(energy - energy.max(axis=0))
    share = energy / energy.sum(axis=0)
    pooled = (h * share[:, None]).sum(axis=0)
    return (p["o"] @ pooled + p["c"])[0], (tanh, share, pooled)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gradients(
    p: net.Params, items: list[bytes], ids: np.ndarray, owner: np.ndarray, labels: np.ndarray, known: np.ndarray | None = None
) -> net.Params:
    """Gradients of the cross entropy of documents, each the soft maximum of its windows."""
    tables, (cids, cmask, ckept, vectors, at) = word_tables(p, items, keep=True, known=known)
    logits, (mask, kept, h, tanh, share, pooled) = window_logits(p, tables, ids, keep=True)
    top = np.full(len(labels), -np.inf)
    np.maximum.at(top, owner, logits)
    weight = np.exp(2 * (logits - top[owner]))
    weight /= np.bincount(owner, weight, len(labels))[owner]
    doc = np.bincount(owner, weight * logits, len(labels))
    d_logit = ((_sigmoid(doc) - labels)[owner] * weight / len(labels)).astype(np.float32)[None, :]
    g = {"o": d_logit @ pooled.T, "c": d_logit.sum(axis=1, keepdims=True)}
    d_pool = p["o"].T @ d_logit
    d_share = (h * d_pool).sum(axis=1)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    d_tanh = p["av"].T[None] * d_energy[:, None] * (1 - tanh * tanh)
    g["av"] = np.einsum("tn,tkn->k", d_energy, tanh, optimize=True)[None, :]
    g["aw"] = np.einsum("tkn,thn->kh", d_tanh, h, optimize=True)
    d_h = d_pool[None] * share[:, None] + np.matmul(p["aw"].T, d_tanh)
    d_vectors = np.zeros_like(vectors)
    for i, d in enumerate("fb"):
        part = d_h[:, i * WORD_HIDDEN : (i + 1) * WORD_HIDDEN]
        d_x, g["wu" + d] = net.back(p["wu" + d], mask, kept[i], part)
        columns = net.scatter(d_x, ids, tables[i].shape[1])[:, 1:]
        g["wc" + d] = columns @ vectors.T
        g["we" + d] = net.scatter((columns if known is None else columns * known)[None], at[None], BUCKETS)
        d_vectors += p["wc" + d].T @ columns
    for i, d in enumerate("fb"):
        states = np.zeros((len(cids), CHAR_HIDDEN, cids.shape[1]), np.float32)
        states[0 if d == "b" else -1] = d_vectors[i * CHAR_HIDDEN : (i + 1) * CHAR_HIDDEN]
        d_x, g["cu" + d] = net.back(p["cu" + d], cmask, ckept[i], states)
        g["cg" + d] = net.scatter(d_x, cids, 256)
    return g


def _windows(docs: list[list[bytes]], rng: np.random.Generator | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, windows of their columns, and each window's document."""
    index = Numbered()
    columns, owner = [], []
    for i, found in enumerate(docs):
        at = np.fromiter(map(index.__getitem__, found), np.int64, len(found)) + 1
        starts = np.array(window_starts(len(at), FIT_STRIDE))
        if rng is not None and len(starts) > FIT_WINDOWS:
            starts = rng.choice(starts, FIT_WINDOWS, replace=False)
        padded = np.concatenate([at, np.full(WINDOW + FIT_STRIDE, PAD)])
        columns.append(padded[np.arange(WINDOW)[:, None] + starts])
        owner += [i] * len(starts)
    return list(index) or [b""], np.concatenate(columns, axis=1), np.array(owner)


def train(texts: list[str], labels: list[int], seed: int = 11, steps: int = STEPS) -> net.Params:
    """Parameters; a batch has as many toxic documents as others."""
    p = _init(seed)
    rng = np.random.default_rng(seed)
    known: dict[bytes, bytes] = {}
    docs = [[known.setdefault(w, w) for w in words(t)] for t in texts]
    sides = [[i for i, x in enumerate(labels) if (x == 1) == side and docs[i]] for side in (False, True)]
    if not all(sides):
        p["o"][:] = 0
        return p
    adam = net.Adam(p, RATE)
    for step in range(steps):
        chosen = [side[i] for side in sides for i in rng.integers(0, len(side), BATCH // 2)]
        items, ids, owner = _windows([docs[i] for i in chosen], rng)
        y = np.array([labels[i] == 1 for i in chosen], np.float64)
        # Vectors of random words are left out, so that their characters have to tell; the rest make up for it.
        known = ((rng.random(len(items)) >= UNKNOWN) / (1 - UNKNOWN)).astype(np.float32)
        adam.step(_gradients(p, items, ids, owner, y, known), 1 - 0.9 * step / steps)
    return p


class Scorer:
    """Scores texts; keeps the input columns of words it has seen, up to ``WORDS_KEPT``."""

    def __init__(self, p: net.Params) -> None:
        self.p = p
        self._clear()

    def _clear(self) -> None:
        self.index = Numbered()
        self.tables = [np.zeros((3 * WORD_HIDDEN, 1), np.float32) for _ in "fb"]

    def _score(self, docs: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        new = list(itertools.islice(self.index, self.tables[0].shape[1] - 1, None))
        if new:
            # By length, so that little is padded, and back in the order of arrival.
            order = np.argsort(np.fromiter(map(len, new), np.int64, len(new)), kind="stable")
            grown = [np.empty((3 * WORD_HIDDEN, len(new)), np.float32) for _ in "fb"]
            for i in range(0, len(new), 4096):
                at = order[i : i + 4096]
                for grid, part in zip(grown, word_tables(self.p, [new[k] for k in at])):
                    grid[:, at] = part[:, 1:]
            self.tables = [np.concatenate([t, g], axis=1) for t, g in zip(self.tables, grown)]
        short = [(i, at) for i, at in docs if len(at) <= WINDOW]
        for a in range(0, len(short), WINDOWS_AT_ONCE):
            part = short[a : a + WINDOWS_AT_ONCE]
            columns = np.full((WINDOW, len(part)), PAD)
            for k, (_, at) in enumerate(part):
                columns[: len(at), k] = at
            out[[i for i, _ in part]] = window_logits(self.p, self.tables, columns)
        # The others stand in one run; windows across their borders belong to none.
        long = [(i, at) for i, at in docs if len(at) > WINDOW]
        if long:
            logits = sliding_logits(self.p, self.tables, np.concatenate([at for _, at in long]))
            first = 0
            for i, at in long:
                out[i] = logits[first : first + len(window_starts(len(at)))].max()
                first += len(at)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        docs: list[tuple[int, np.ndarray]] = []
        held = 0
        index = self.index
        for i, text in enumerate(texts):
            found = words(text)
            docs.append((i, np.fromiter(map(index.__getitem__, found), np.int64, len(found)) + 1))
            held += len(found)
            if held > 500_000 or len(index) > WORDS_KEPT:
                self._score(docs, out)
                docs, held = [], 0
                if len(index) > WORDS_KEPT:
                    self._clear()
                    index = self.index
        if docs:
            self._score(docs, out)
        return _sigmoid(out)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, folds: int = FOLDS) -> net.Params:
    """Train on the first ``fit_docs`` labelled rows of each label, by hash of the id."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out("doc_id", folds))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = marks.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= fit_docs)
    piece = f"substring(text, int(1 + i * bigint(length(text)) div {FIT_PIECES}), {fit_chars // FIT_PIECES})"
    pieces = f"array_join(transform(sequence(0, {FIT_PIECES - 1}), i -> {piece}), ' ')"
    # At most two bounded groups, so the choice may go to every task.
    rows = (
        docs.join(F.broadcast(chosen), "doc_id")
        .filter("text is not null")
        .select("doc_id", F.expr(f"if(length(text) <= {fit_chars}, text, {pieces})").alias("text"), "toxic")
        .orderBy("doc_id", "text")
        .toPandas()
    )
    params = train(rows["text"].tolist(), rows["toxic"].tolist())
    toxic, every = marks.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)), F.count("*")).head()
    if 0 < toxic < every:
        # Batches hold both labels alike; the scores are to hold for the labels' true shares.
        params["c"] -= np.float32(np.log((every - toxic) / toxic))
    return params


def scores(docs: DataFrame, params: net.Params) -> DataFrame:
    """``doc_id`` and ``score`` of each row. A null or empty text scores as a window of nothing."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(params)
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": scorer(frame["text"].tolist())})

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id bigint, score double")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
