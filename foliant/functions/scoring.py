"""BM25 as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def length_share(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What occurrences of a word bring in a page of a length, before the word's own weight; below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_term(n_docs: Column, avgdl: Column, df: Column, tf: Column, dl: Column) -> Column:
    """Share of one word or phrase in the score of a page; negative, smaller is better."""
    return -(idf(n_docs, df) * length_share(tf, dl, avgdl))
