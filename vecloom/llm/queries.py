"""Importing this module registers the queries of this subpackage."""

from vecloom.llm import (  # noqa: F401
    bpe,
    contamination,
    conversations,
    html_text,
    language,
    near,
    order_minhash,
    packing,
    phrases,
    repeats,
    rollup,
    toxicity,
    warc,
)
from vecloom.llm.registry import ENTRIES  # noqa: F401
