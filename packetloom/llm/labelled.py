"""Bounded labelled samples and the small logistic fit that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hash of their doc_id.
SAMPLE_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by their doc_id alone; a null doc_id is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels (``label`` as 0 or 1) of at most ``rows`` labelled documents that are not held out.

    The doc_ids are no more than ``rows``, so they are broadcast, and no text is shuffled.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (intercept last) by Newton steps; ``x`` should be scaled."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * max(1, len(x)))
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
