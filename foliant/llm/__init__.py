"""Operators for preparing training data, each with a query that applies it to its whole table."""

from foliant.llm import (  # noqa: F401
    contamination,
    digests,
    lengths,
    mixing,
    neardup,
    negatives,
    packing,
    recompression,
    shared_terms,
    suffixes,
    threshold,
    toxicity,
    warc,
)
from foliant.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
