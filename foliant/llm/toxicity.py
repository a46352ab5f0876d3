"""Severity of toxicity by cumulative-link ordinal regression on the words and word beginnings of a text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight per feature, shared by all grades, and rising thresholds. The model
is fitted on a bounded sample of labelled documents and scores every whole text in the scan's tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import in_batches, lean, picked, query, texts_of
from foliant.plans.sizing import written

if TYPE_CHECKING:
    import pyarrow as pa

SAMPLE = 20_000  # labelled documents that the fit uses at most
LEAST_DOCS = 4  # sample documents a feature must be in
LEAST_Z = 5.0  # standard errors by which its share of toxic documents must differ from the overall share
FEATURES = 4_096
BEGINNINGS = (4, 6)  # bytes of words' beginnings, which catch words made from one stem
MARKER_SHARE = 0.9  # share of toxic documents among those with a marker word
SEVERE_MARKERS = 3
CUT = 0.5

# ASCII letters lower-cased, digits and all bytes of longer characters as they are, the rest blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def beginnings(words: list[bytes], wanted: frozenset[bytes] | None = None) -> set[bytes]:
    """Beginnings of longer words as features, and once more if at least two words of the text have one.

    ``wanted`` limits them to those that matter.
    """
    found = set()
    for size in BEGINNINGS:
        if wanted is None:
            starts = [w[:size] for w in words if len(w) > size]
        else:
            starts = [b for w in words if len(w) > size and (b := w[:size]) in wanted]
        for start, n in Counter(starts).items():
            found.add(b"%s*%d" % (start, size))
            if n > 1:
                found.add(b"%s*%d+" % (start, size))
    return found


@dataclass(frozen=True)
class Severity:
    """Feature weights and rising thresholds; grades are 0 .. len(thresholds)."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    @cached_property
    def _starts(self) -> frozenset[bytes]:
        return frozenset(w.rpartition(b"*")[0] for w in self.weights if b"*" in w)

    def strength(self, text: bytes) -> float:
        words = words_of(text)
        found = self.weights.keys() & (set(words) | beginnings(words, self._starts))
        return float(sum(sorted(self.weights[w] for w in found)))


def fit_thresholds_and_weights(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, steps: int = 500, ridge: float = 5e-6, rate: float = 0.2
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model for a 0/1 matrix given by its cells.

    Adam on the mean negative log-likelihood with a ridge penalty; deterministic.
    """
    n, k = len(grades), max(int(grades.max(initial=0)), 1)
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], columns[order]
    share = np.array([(grades <= g).mean() for g in range(k)]).clip(1e-3, 1 - 1e-3)
    base = np.log(share / (1 - share))
    # The first threshold is free, the steps between thresholds are exponentials, so thresholds rise.
    theta = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    params = np.concatenate([np.zeros(n_columns), theta])
    first, second = np.zeros_like(params), np.zeros_like(params)

    def thresholds(free: np.ndarray) -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-x.clip(-35, 35)))

    for step in range(1, steps + 1):
        w, free = params[:n_columns], params[n_columns:]
        cut = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
        score = np.bincount(rows, weights=w[columns], minlength=n)
        upper = np.where(grades == k, 1.0, sigmoid(cut[grades + 1] - score))
        lower = np.where(grades == 0, 0.0, sigmoid(cut[grades] - score))
        p = (upper - lower).clip(1e-9)
        d_up, d_low = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        grad_w = np.bincount(columns, weights=(d_up - d_low)[rows], minlength=n_columns) + ridge * w
        by_cut = np.bincount(grades[grades < k], weights=-d_up[grades < k], minlength=k)
        by_cut = by_cut + np.bincount(grades[grades > 0] - 1, weights=d_low[grades > 0], minlength=k)
        tails = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tails[:1], tails[1:] * np.exp(free[1:])])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:n_columns], thresholds(params[n_columns:])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each of its words and beginnings; equal texts have one key."""
    import hashlib

    import pyarrow as pa

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = words_of(text)
                key = hashlib.sha256(b" ".join(words)).digest()[:16]
                yield key, toxic, None, 0
                held = Counter(words)
                yield from ((key, toxic, w, n) for w, n in sorted(held.items()))
                yield from ((key, toxic, b, 0) for b in sorted(beginnings(words)) if b not in held)

    yield from in_batches(rows(), pa.schema([("text_key", pa.binary()), ("toxic", pa.int32()), ("word", pa.binary()), ("times", pa.int32())]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Severity:
    """Fit on at most ``sample`` labelled documents, those with the smallest hash of their id.

    Labels say only toxic or not. The severity grades are made from them: 0 not toxic, 1 toxic, 2 toxic with at least
    ``SEVERE_MARKERS`` occurrences of words found in at least ``LEAST_DOCS`` sample texts of which ``MARKER_SHARE`` or
    more are toxic. Equal texts count once in the fit, so that copies of one text do not make its words count. Rows
    with a null id or label are left out. With no labelled document at all, every text has severity 0.
    """
    spark = docs.sparkSession
    marked = (
        picked(labels, doc_id=id_col, toxic=label_col)
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    slim = picked(docs, doc_id=id_col, text=text_col)
    # At most ``sample`` pairs of numbers are broadcast.
    sampled = slim.join(F.broadcast(marked), "doc_id").select("toxic", "text")
    seen = written(sampled.mapInArrow(lean(_word_rows), "text_key binary, toxic int, word binary, times int"), "toxicity-sample")
    # Equal texts have the same words as often, so one row for each text and word is left of any number of copies.
    once = seen.where("word IS NULL").groupBy("text_key").agg(F.max("toxic").alias("toxic"))
    cells = seen.where("word IS NOT NULL").groupBy("text_key", "word").agg(F.max("toxic").alias("toxic"), F.max("times").alias("times"))
    cells = written(cells, "toxicity-cells")
    total = once.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not total["n"]:
        return Severity({}, (35.0, 36.0))
    n, t = total["n"], total["t"]
    share = max(t, 1) / n
    z = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    features = (
        cells.groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
        .where((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z))
        .orderBy(z.desc(), "word")
        .limit(FEATURES)
        .collect()  # at most FEATURES features
    )
    names = [bytes(r["word"]) for r in features]
    marker = np.array([r["bad"] >= MARKER_SHARE * r["n"] for r in features], bool)
    known = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word binary, f int")
    # The sample's rows, each with its few features: bounded by the sample.
    held = (
        cells.join(F.broadcast(known), "word")
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("f", "times"))).alias("cells"))
    )
    rows = once.select("text_key", "toxic").join(held, "text_key", "left").orderBy("text_key").drop("text_key").toArrow()
    toxic = rows.column("toxic").to_numpy()
    lists = rows.column("cells").combine_chunks()
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    flat = lists.flatten()
    columns = flat.field("f").to_numpy(zero_copy_only=False).astype(np.int64)
    times = flat.field("times").to_numpy(zero_copy_only=False)
    index = np.repeat(np.arange(len(toxic)), sizes)
    marks = np.bincount(index, weights=times * marker[columns], minlength=len(toxic)) if len(names) else np.zeros(len(toxic))
    grades = np.where(toxic > 0, 1 + (marks >= SEVERE_MARKERS), 0).astype(np.int64)
    weights, thresholds = fit_thresholds_and_weights(index, columns, grades, len(names))
    return Severity({w: float(x) for w, x in zip(names, weights, strict=True) if abs(x) > 1e-4}, tuple(float(x) for x in thresholds))


def _scoring(model: Severity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            strengths = [model.strength(t) for t in texts_of(batch.column("text"))]
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(strengths, pa.float64())], [*columns, "strength"]
            )

    return score


def scored(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_severity, p_grade_1, p_grade_2 .. (of that grade or more), grade, toxic.

    Null and empty texts have no words and get the severity of the thresholds alone, which is near 0 as most documents
    are clean. grade is the most probable one; toxic says that grade 1 or more is at least as probable as ``CUT``.
    """
    slim = picked(docs, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(_scoring(model), f"doc_id {kind}, strength double")
    above = [F.lit(1) / (F.lit(1) + F.exp(F.lit(t) - F.col("strength"))) for t in model.thresholds]
    each = [a - b for a, b in zip([F.lit(1.0), *above], [*above, F.lit(0.0)], strict=True)]
    best = F.greatest(*each)
    grade = F.lit(None).cast("int")
    for g in reversed(range(len(each))):
        grade = F.when(each[g] == best, F.lit(g)).otherwise(grade)
    return rows.select(
        "doc_id",
        sum(above[1:], above[0]).alias("expected_severity"),
        *[a.alias(f"p_grade_{g}") for g, a in enumerate(above, 1)],
        grade.alias("grade"),
        (above[0] >= CUT).alias("toxic"),
    )


def _keeping(model: Severity, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import math

    # Grade 1 or more is as probable as CUT where strength - threshold is the logit of CUT.
    bound = model.thresholds[0] + math.log(CUT / (1 - CUT))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            clean = [model.strength(t) < bound for t in texts_of(batch.column(text_col))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def without_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The whole rows of the documents that ``scored`` does not call toxic, in one pass."""
    return docs.mapInArrow(lean(_keeping(model, text_col)), docs.schema)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
