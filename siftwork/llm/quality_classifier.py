"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k | text) = sigmoid(w . x - threshold_k): one weight vector over hashed text features is shared by all
grades, and the thresholds are ordered (each is the one before plus an exponential). From these come the expected
grade and the tail probability of a chosen grade, by which documents are selected.

The model is fitted on at most SAMPLE_ROWS rated rows of each grade, in the order of a hash of their doc_id; rows
are weighted back to the grades' true shares. Rows without text, rating or doc_id are not learned from. With fewer
than two grades there is nothing to learn: every document has the grade's own probability. Null and empty texts are
scored on their (absent) words like any other.

Rating of the query: 0 for low quality, 1 for good quality but toxic, 2 for good quality without toxicity; a
document is kept if P(grade >= 1) is at least KEEP.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

KEEP = 0.5
TAIL = 1
PENALTY = 0.3
LEAST = 3
SCALE = 10.0


@dataclass
class Model:
    """Grades in order, one weight for each slot, and the thresholds between neighbouring grades."""

    grades: list[int]
    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold: one row a text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + self.tails(score) @ steps if len(self.grades) > 1 else np.full(len(score), float(self.grades[0]))

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= `grade`)."""
        below = sum(g < grade for g in self.grades)
        if below == 0 or below == len(self.grades):
            return np.full(len(score), float(below == 0))
        return self.tails(score)[:, below - 1]


def fit(matrix: linear.Sparse, y: np.ndarray, share: np.ndarray, penalty: float = PENALTY) -> Model:
    """Maximum penalised likelihood; y are grades, share weighs each row."""
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Model(grades or [0], {}, np.zeros(0))
    k = np.searchsorted(grades, y)
    cuts, size = len(grades) - 1, len(matrix.columns)
    total = share.sum()

    def thresholds(t: np.ndarray) -> np.ndarray:
        return np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = x[:size], x[size:]
        th = thresholds(t)
        score = matrix.times(w)
        edge = np.concatenate(([-np.inf], th, [np.inf]))
        low, high = edge[k] - score, edge[k + 1] - score  # P(y) = s(high) - s(low)
        s_low, s_high = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (low, high))
        p = np.maximum(s_high - s_low, 1e-12)
        d_low, d_high = s_low * (1 - s_low) * np.isfinite(low), s_high * (1 - s_high) * np.isfinite(high)
        loss = -(share * np.log(p)).sum() / total + penalty * (w @ w) / (2 * len(y))
        d_score = share * (d_high - d_low) / p / total
        g_th = np.bincount(k, weights=-share * d_high / p / total, minlength=cuts + 1)[:cuts] + np.bincount(k, weights=share * d_low / p / total, minlength=cuts + 1)[1:]
        g_t = np.empty(cuts)
        g_t[0] = g_th.sum()
        for j in range(1, cuts):
            g_t[j] = g_th[j:].sum() * np.exp(t[j])
        return float(loss), np.concatenate((matrix.back(d_score) + penalty * w / len(y), g_t))

    x = linear.minimise(value, np.zeros(size + cuts))
    return Model(grades, linear.named(matrix.columns, x[:size] * SCALE), thresholds(x[size:]))


def learn(documents: DataFrame, ratings: DataFrame, rows: int = linear.SAMPLE_ROWS) -> Model:
    """Fit on ratings(doc_id, grade) of the documents."""
    ids, totals = linear.sample_ids(ratings, "grade", rows)
    if not ids:
        return Model([0], {}, np.zeros(0))
    matrix, y = linear.vectors(linear.sampled(documents, ids), False, LEAST)
    if matrix.values is not None:
        matrix.values = matrix.values * np.float32(SCALE)
    met = np.bincount(y, minlength=max(totals) + 1) if len(y) and min(totals) >= 0 else None
    share = np.array([totals[g] / (met[g] if met is not None else 1) for g in y.tolist()]) if len(y) else np.zeros(0)
    return fit(matrix, y, share)


def grade(documents: DataFrame, model: Model, tail: int = TAIL) -> DataFrame:
    """Per document: doc_id, expected_grade and tail_probability of `tail` or better."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = linear.Scorer(own.weights)
        for batch in batches:
            for part in common.text_slices(batch, 1):
                score = np.array([scorer.of_counts(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.expected(score)), pa.array(own.tail(score, tail))], names=["doc_id", "expected_grade", "tail_probability"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings (doc_id, grade) from the quality and toxicity marks of labels."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept; learned from rows that are not held out."""
    documents = common.table(spark, sf_dir, "documents")
    rated = ratings(common.table(spark, sf_dir, "labels")).where(~common.held_out())
    out = grade(documents, learn(documents, rated))
    return out.select("doc_id", common.held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"))
