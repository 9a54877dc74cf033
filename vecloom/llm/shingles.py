"""Words and word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from vecloom.llm.frames import mixed

# Fixed rule: A-Z become a-z, everything else stays; words end at space and \x09-\x0D.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Distinct words a task remembers.
REMEMBERED = 1_000_000


class WordHashes(dict):
    """Word to number; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One number per run of ``k`` words; a shorter text is one shingle as a whole, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = mixed(hashes[: n - k + 1], k)
    for i in range(1, k):
        out = mixed(out ^ hashes[i : n - k + 1 + i], i)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
