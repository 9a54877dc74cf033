"""Token ids of a byte-level BPE vocabulary, packed as 32-bit numbers, little-endian on the machines Spark runs on."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

# The vocabulary, whose ranks stand in a file of the same name.
VOCABULARY = "byte_bpe_50k.json"
# The pre-tokenizer's pattern for texts of these letters and ASCII without separators 28 to 31: a
# compiled class is faster than Unicode properties, and finds the same there.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
NOT_SIMPLE = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LETTERS}]")
# Distinct pre-tokens a task remembers.
REMEMBERED = 500_000


class Encoder(dict):
    """Pre-token to packed ids. Pre-tokens are encoded one by one, so each is looked up once.

    Single pre-tokens go through the merge ranks, which is faster and gives the same
    ids; texts that hold a special token's name go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.single = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self[piece] = array("I", self.single(piece)).tobytes()
        return packed

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._encode(text)
        found = self.split(text) if NOT_SIMPLE.search(text) else SIMPLE.findall(text)
        return b"".join(map(self.__getitem__, found))
