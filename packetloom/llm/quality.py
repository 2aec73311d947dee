"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a log-odds from a small classifier over the form of its text, fitted on a bounded labelled
sample.  Hosts and paths then give evidence of their own: the mean probability of all their documents, by grouped sums
with map-side combine.  A host's posterior is shrunk toward the global prior and a path's toward its host's, both by a
strength that is estimated from the spread between sites (method of moments), so sparse sites say little.  The
posterior log-odds of a document are its evidence moved by its path's posterior against the global prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.labelled import SAMPLE_ROWS, fit_logistic, labelled_sample
from packetloom.llm.text import SPACES, Words, slices, small_batches, utf8
from packetloom.session import cut

FEATURES = ["words", "mean_word", "symbols", "digits", "capitals", "bars", "line_words", "repeats"]
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1e6
#: How much of a site's distance from the prior counts for a document: its own text is the better witness.
SITE_SHARE = 0.5
THRESHOLD = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?|"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def form(column: pa.Array) -> np.ndarray:
    """Features of the whole texts, one row each, in the order of ``FEATURES``; an empty text gives zeros."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(FEATURES)))
    for begin, end in slices(offsets):
        base = offsets[begin]
        part, own = data[base : offsets[end]], offsets[begin : end + 1] - base
        words = Words(part, own, SPACES)
        size = np.maximum(1, np.diff(own))
        n = np.diff(words.first)
        repeats = np.zeros(len(words.hashes), dtype=bool)
        if len(repeats):
            repeats[1:] = words.hashes[1:] == words.hashes[:-1]
        lines = _per_row(part == 0x0A, own) + 1
        rows = out[begin:end]
        rows[:, 0] = np.log1p(n)
        rows[:, 1] = np.minimum(20, _per_row(~SPACES[part], own) / np.maximum(1, n))
        for k, table in ((2, _SYMBOL), (3, _DIGIT), (4, _CAPITAL)):
            rows[:, k] = _per_row(table[part], own) / size
        rows[:, 5] = _per_row(part == 0x7C, own) / np.maximum(1, n)
        rows[:, 6] = np.log1p(n / lines)
        rows[:, 7] = _per_row(repeats, words.first) / np.maximum(1, n)
    return out


def _shape(x: np.ndarray) -> np.ndarray:
    """Features with their squares: both very short and very long words, say, speak against a text."""
    x = x * np.array([0.2, 0.1, 10, 10, 5, 5, 0.3, 3])
    return np.c_[x, x * x]


def fit(sample: DataFrame) -> np.ndarray:
    """Weights of the shaped features, intercept last; of one class only, its base rate alone."""

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(form(batch.column(1))), pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("y", "text").mapInArrow(measure, "y int, x array<double>").toPandas()
    width = 2 * len(FEATURES)
    if not len(rows) or rows["y"].nunique() < 2:
        good = float((rows["y"].sum() + 1) / (len(rows) + 2)) if len(rows) else 0.5
        return np.r_[np.zeros(width), np.log(good / (1 - good))]
    return fit_logistic(_shape(np.stack(rows["x"].to_list())), rows["y"].to_numpy(), ridge=1e-4)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> Column:
    """Prior rows that a site's parent is worth: the spread within sites over the spread between them."""
    n, total, squares = F.sum("n"), F.sum("s"), F.sum(F.col("s") * F.col("s") / F.col("n"))
    mean, sites = total / n, F.count("*")
    within = F.greatest(F.lit(1e-6), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.lit(1.0), n - sites))
    # The size of a site that stands for all, where sizes differ.
    size = (n - F.sum(F.col("n") * F.col("n")) / n) / F.greatest(F.lit(1.0), sites - 1.0)
    between = (squares - n * mean * mean) / F.greatest(F.lit(1.0), sites - 1.0) - within
    ratio = within * F.greatest(F.lit(1.0), size) / F.greatest(F.lit(1e-9), between)
    return F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), ratio))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """host, path, host_mean, path_mean and the global mean, from rows (host, path, p)."""
    paths = cut(evidence.groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    # One row each: numbers that describe the whole corpus.
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("prior"), _strength(hosts).alias("host_strength"))
    paths_whole = paths.agg(_strength(paths).alias("path_strength"))
    first, second = whole.first(), paths_whole.first()
    prior = first["prior"] if first["prior"] is not None else 0.5
    strong, path_strong = first["host_strength"] or MIN_STRENGTH, second["path_strength"] or MIN_STRENGTH
    host_means = hosts.select(F.col("host").alias("__h"), ((F.col("s") + strong * prior) / (F.col("n") + strong)).alias("host_mean"))
    return paths.join(host_means, F.col("host").eqNullSafe(F.col("__h"))).select(
        "host", "path", "host_mean",
        ((F.col("s") + path_strong * F.col("host_mean")) / (F.col("n") + path_strong)).alias("path_mean"), F.lit(float(prior)).alias("prior"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, score (0 to 1) and keep for every document.

    Without urls, a document's source is its host and its language within the source its path.  A null host or path is a
    site of its own.  A null or empty text has the evidence of an empty form.  Labels are (doc_id, quality); null or other
    values teach nothing, and one class only leaves its base rate.  Repeated rows are rows of their own.  No rows: no rows.
    """
    small_batches(docs.sparkSession)
    weights = fit(labelled_sample(docs, labels, "quality", text, rows))
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    names = ["doc_id", "host", "path", "evidence"]

    def run(batches):
        for batch in batches:
            x = _shape(form(batch.column(3)))
            z = np.clip(x @ weights[:-1] + weights[-1], -12, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    evidence = cut(narrow.mapInArrow(run, f"doc_id {kind}, host string, path string, evidence double"))
    sites = cut(site_posteriors(evidence.select("host", "path", (1 / (1 + F.exp(-F.col("evidence")))).alias("p"))))
    named = sites.withColumnsRenamed({"host": "__host", "path": "__path"})
    moved = F.col("evidence") + SITE_SHARE * (_logit(F.col("path_mean")) - _logit(F.col("prior")))
    joined = evidence.join(named, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    return joined.select(
        "doc_id", "host", "path", "evidence", "host_mean", "path_mean", (1 / (1 + F.exp(-moved))).alias("score"),
    ).withColumn("keep", F.col("score") >= THRESHOLD)


