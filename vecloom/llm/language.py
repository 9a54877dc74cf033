"""Language by a bidirectional gated recurrent network over bytes.

A document is read as runs of bytes between white space, of at most ``RUN`` bytes.
The network labels every byte of a run from both directions; a document's
probabilities are the mean over its bytes. Equal runs have equal labels, so each
task labels the distinct runs of a batch once and counts them per document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm import recurrent as net
from vecloom.llm.frames import Numbered, held_out, set_aside
from vecloom.llm.registry import FOLDS, query
from vecloom.plans.catalog import table

HIDDEN = 8
RUN = 32
# The fit sees at most so many documents of a language, and so many characters of each.
FIT_DOCS = 400
FIT_CHARS = 3000
STEPS = 260
BATCH = 512
# Distinct runs a task keeps at a time.
RUNS_AT_ONCE = 400_000
UNDETERMINED = "und"


def runs(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "replace").split()
    if max(map(len, words), default=0) <= RUN:
        return words
    return [w[i : i + RUN] for w in words for i in range(0, len(w), RUN)]


def _init(classes: int, seed: int) -> net.Params:
    rng = np.random.default_rng(seed)
    p = {f"{k}{d}": v for d in "fb" for k, v in (("g", net.init(rng, 3 * HIDDEN, 256, scale=0.3)), ("u", net.init(rng, 3 * HIDDEN, HIDDEN)))}
    return p | {"o": net.init(rng, classes, 2 * HIDDEN), "c": np.zeros((classes, 1), np.float32)}


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis=axis, keepdims=True))
    return x / x.sum(axis=axis, keepdims=True)


def _loss_grads(p: net.Params, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> net.Params:
    """Gradients of the mean cross entropy over all bytes of a batch."""
    hf, kf = net.run(p["gf"], p["uf"], ids, mask, False, keep=True)
    hb, kb = net.run(p["gb"], p["ub"], ids, mask, True, keep=True)
    h = np.concatenate([hf, hb], axis=1)
    d = _softmax(np.matmul(p["o"], h) + p["c"], 1)
    d[:, labels, np.arange(len(labels))] -= 1
    d *= mask[:, None] / mask.sum()
    g = {"o": np.einsum("tcn,thn->ch", d, h, optimize=True), "c": d.sum(axis=(0, 2))[:, None]}
    dh = np.matmul(p["o"].T, d)
    for way, kept, part in (("f", kf, dh[:, :HIDDEN]), ("b", kb, dh[:, HIDDEN:])):
        dx, g["u" + way] = net.back(p["u" + way], mask, kept, part)
        g["g" + way] = net.scatter(dx, ids, 256)
    return g


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = STEPS) -> tuple[list[str], net.Params]:
    """Classes in order and parameters. Every class gives equally many runs to a batch."""
    classes = sorted(set(langs))
    if not classes:
        return [], {}
    pools: list[list[bytes]] = [[] for _ in classes]
    for text, lang in zip(texts, langs):
        pools[classes.index(lang)].extend(runs(text))
    pools = [pool or [b"?"] for pool in pools]
    rng, p = np.random.default_rng(seed), _init(len(classes), seed)
    adam = net.Adam(p, 0.01)
    for step in range(steps if len(classes) > 1 else 0):
        labels = rng.integers(0, len(classes), BATCH)
        batch = [pools[c][i] for c, i in zip(labels, (rng.random(BATCH) * [len(pools[c]) for c in labels]).astype(int))]
        ids, mask = net.padded(batch)
        adam.step(_loss_grads(p, ids, mask, labels), 1 - 0.9 * step / steps)
    return classes, p


def label_runs(p: net.Params, items: list[bytes], classes: int, block: int = 2048) -> np.ndarray:
    """Sum over the bytes of each run of their label probabilities, ``(runs, classes)``."""
    out = np.zeros((len(items), classes), np.float64)
    order = np.argsort(np.fromiter(map(len, items), np.int64, len(items)), kind="stable")
    for start in range(0, len(order), block):
        at = order[start : start + block]
        ids, mask = net.padded([items[i] for i in at])
        h = np.concatenate([net.run(p["gf"], p["uf"], ids, mask, False), net.run(p["gb"], p["ub"], ids, mask, True)], axis=1)
        probs = _softmax(np.matmul(p["o"], h) + p["c"], 1)
        out[at] = (probs * mask[:, None]).sum(axis=0).T
    return out


class Labeller:
    """Labels texts; remembers the runs it has labelled, up to ``RUNS_AT_ONCE``."""

    def __init__(self, classes: list[str], p: net.Params) -> None:
        self.classes, self.p = classes, p
        self.index = Numbered()
        self.sums = np.zeros((0, len(classes)))
        self.sizes = np.zeros(0, np.int64)

    def _label_new(self) -> None:
        new = list(itertools.islice(self.index, len(self.sizes), None))
        self.sums = np.concatenate([self.sums, label_runs(self.p, new, len(self.classes))])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and pooled probability of each text."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        docs: list[tuple[int, np.ndarray]] = []
        index = self.index

        def settle() -> None:
            self._label_new()
            for i, found in docs:
                totals = self.sums[found].sum(axis=0) / self.sizes[found].sum()
                best = int(totals.argmax())
                langs[i], scores[i] = self.classes[best], float(min(totals[best], 1.0))
            docs.clear()

        for i, text in enumerate(texts):
            if self.classes and text and any(map(str.isalpha, text)):
                found = runs(text)
                docs.append((i, np.fromiter(map(index.__getitem__, found), np.int64, len(found))))
                if len(index) > RUNS_AT_ONCE:
                    settle()
                    index.clear()
                    self.sums, self.sizes = self.sums[:0], self.sizes[:0]
        settle()
        return langs, scores


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, folds: int = FOLDS) -> tuple[list[str], net.Params]:
    """Train on a bounded sample: per language the first ``fit_docs`` rows by hash of the id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = (
        docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", folds))
        .select("doc_id", "lang", F.substring("text", 1, fit_chars).alias("text"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= fit_docs)
        .orderBy("lang", "_n")
        .select("text", "lang")
        .toPandas()
    )
    return train(sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, model: tuple[list[str], net.Params], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``.

    Null text, or text without a letter: ``und`` with score 0. The text alone
    decides; equal rows get equal labels. Very long texts are read whole.
    """
    classes, params = model
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(classes, params)
        for frame in batches:
            langs, scores = label(frame["_text"].tolist())
            yield frame.drop(columns="_text").assign(lang_pred=langs, score=scores)

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "lang_pred string, score double"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(labelled, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; the rest carry the predicted one in ``lang``. Other columns stay, whatever their names."""
    inner, back = set_aside(docs, ["doc_id", "text", "lang"])
    model = fit(inner)
    seen = inner.withColumn("_copy", F.col("text"))
    labelled = predict(seen, model, [*[c for c in inner.columns if c != "text"], "_copy"])
    kept = labelled.filter(F.col("lang_pred") != UNDETERMINED)
    return back(kept.withColumnsRenamed({"_copy": "text"}).withColumn("lang", F.col("lang_pred")))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs), ["doc_id"]).select(
        "doc_id", held_out("doc_id", FOLDS).alias("held_out"), "lang_pred", "score"
    )
