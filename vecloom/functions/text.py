"""Text to padded token ids and to a default embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.arrow import to_lists, to_matrix, vector_udf

# Longest token row and number of hashed ids; id 0 is padding.
MAX_LENGTH = 128
VOCABULARY = 32000


# Fixed rule: words end at these characters, whatever else counts as white space elsewhere.
_SPACES = re.compile("[ \\t\\n\\x0b\\f\\r]+")
# White space to ``str.split`` but not by the rule.
_OTHER_SPACES = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def _words(text: str) -> list[str]:
    if _OTHER_SPACES.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


class _Hashes(dict):
    """Id of a word, worked out when it is first met."""

    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        number = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.vocabulary + 1
        return number


def tokenize_pad(col: Column | str, max_length: int = MAX_LENGTH, vocabulary: int = VOCABULARY) -> Column:
    """Struct of ``ids`` and ``mask``, both ``max_length`` long, and ``n_tokens`` of the whole text.

    Spark lowers the case; a text is cut once, in a task, and each distinct word that
    counts is hashed once in a batch.
    """
    col = F.col(col) if isinstance(col, str) else col

    @vector_udf("struct<ids:array<int>,mask:array<int>,n_tokens:int>")
    def pad(texts: pa.Array) -> pa.Array:
        present = np.asarray(texts.is_valid())
        words = [_words(t) for t in texts.to_pylist() if t is not None]
        counts = np.array([len(w) for w in words], np.int32)
        numbers = _Hashes(vocabulary)
        mask = np.arange(max_length) < counts[:, None]
        ids = np.zeros(mask.shape, np.int32)
        ids[mask] = np.fromiter((numbers[w] for some in words for w in some[:max_length]), np.int32, int(mask.sum()))
        lists = [to_lists(m, present, pa.int32()) for m in (ids, mask.astype(np.int32))]
        whole = np.zeros(len(present), np.int32)
        whole[present] = counts
        absent = pa.array(~present)
        return pa.StructArray.from_arrays([*lists, pa.array(whole, mask=~present)], ["ids", "mask", "n_tokens"], mask=absent)

    return pad(F.lower(col))


def hash_embed(ids: Column, dim: int) -> Column:
    """Signed counts of token ids in ``dim`` buckets; padding (0) does not count."""

    @vector_udf("array<float>")
    def count(tokens: pa.Array) -> pa.Array:
        matrix, present = to_matrix(tokens)
        number = matrix.astype(np.int64)
        sign = np.where(number // dim % 2 == 0, 1.0, -1.0) * (number > 0)
        rows = np.arange(len(number))[:, None] * dim
        flat = np.bincount(
            (rows + number % dim).reshape(-1), weights=sign.reshape(-1), minlength=len(number) * dim
        )
        return to_lists(flat.reshape(len(number), dim), present, pa.float32())

    return count(ids)
