"""Line deduplication over a sharded minimal perfect hash of all distinct lines.

1. Every document gives each of its distinct line keys once; keys are 128 bits of hash, never the line.
2. Counts per key (documents, largest doc_id) are combined before and after one shuffle.
3. Each shard of keys becomes a minimal perfect hash with arrays: fingerprints, counts, keepers.
4. Documents probe the arrays: (document, key) rows go to the shard, and only the hits come back.  A shard that very
   many documents probe is copied to as many tasks as its counts ask for, so a line that every document has is spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.text import grouped, mix, small_batches
from packetloom.session import cut

MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 100_000
PROBES_PER_TASK = 1_000_000

#: What is stripped from lines.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: levels of bit arrays, where a value that meets no other stays.

    ``find`` gives each value a place below the number of values; values outside the set get any place.
    """

    LEVELS = 40

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left) and len(self.levels) < self.LEVELS:
            places = self._places(left, len(self.levels), 2 * len(left) + 1)
            hits = np.bincount(places, minlength=2 * len(left) + 1)
            self.levels.append(hits == 1)
            left = left[hits[places] != 1]
        self.rest = {int(k): i for i, k in enumerate(left)}
        self.before = np.cumsum([0, *(int(level.sum()) for level in self.levels)])
        self.ranks = [np.cumsum(level) - 1 for level in self.levels]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            places = self._places(keys[open_], k, len(level))
            hit = level[places]
            out[open_[hit]] = self.before[k] + self.ranks[k][places[hit]]
            open_ = open_[~hit]
        for i in open_.tolist():
            out[i] = self.before[-1] + self.rest.get(int(keys[i]), 0) if self.rest else 0
        return out


class Shard:
    """Arrays of one shard: fingerprint, count and keeper at each key's place."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> None:
        self.hash = PerfectHash(self._value(first, second))
        at = self.hash.find(self._value(first, second))
        self.fingerprints = np.zeros(len(first), np.uint64)
        self.counts = np.zeros(len(first), np.int64)
        self.keepers = np.zeros(len(first), np.int64)
        self.fingerprints[at], self.counts[at], self.keepers[at] = second, counts, keepers

    @staticmethod
    def _value(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(first) ^ second

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if the key is not of the shard) and keeper of each key."""
        if not len(self.counts):
            return np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at = self.hash.find(self._value(first, second))
        known = self.fingerprints[at] == second
        return np.where(known, self.counts[at], 0), self.keepers[at]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(29), key).alias("h2")]


def _line_hashes(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    keyed = F.transform(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars), lambda k: F.struct(*_hashes(k)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(keyed)).alias("k")).select("doc_id", "k.*")


def build_and_probe(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, h1, h2) of the lines that ``doc_id`` loses."""
    spark = lines.sparkSession
    counts = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")))
    keys, probes_in_all = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, ceil(keys / KEYS_PER_SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    most = max(1, min(PROBES_PER_TASK, ceil(1.5 * probes_in_all / shards)))
    shard = F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)).cast("int")
    keyed = counts.withColumn("shard", shard)
    # One number per shard: into how many copies it goes, by the probes that will reach it.
    copies = keyed.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(most)).cast("int").alias("copies"))
    index = keyed.join(F.broadcast(copies), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("doc_id"), "h1", "h2", "n", "keeper")
    # Any copy answers any probe, so rows are dealt by their place: equal ones, as of null doc_ids, do not meet in one.
    dealt = F.pmod(F.monotonically_increasing_id(), F.col("copies")).cast("int")
    probes = lines.withColumn("shard", shard).join(F.broadcast(copies), "shard").select(
        "shard", dealt.alias("copy"), F.lit(1).alias("kind"),
        "doc_id", "h1", "h2", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("keeper"))
    order = ["shard", "copy", "kind"]
    ready = index.union(probes).repartition("shard", "copy").sortWithinPartitions(*order)

    def run(batches) -> Iterator[pa.RecordBatch]:
        arrays, at = None, None
        for table in grouped(batches, order):
            place = table["shard"][0].as_py(), table["copy"][0].as_py()
            h1 = table["h1"].to_numpy().view(np.uint64)
            h2 = table["h2"].to_numpy().view(np.uint64)
            if table["kind"][0].as_py() == 0:
                missing = table["keeper"].is_null().to_numpy()
                keepers = np.where(missing, np.iinfo(np.int64).min, table["keeper"].fill_null(0).to_numpy())
                arrays, at = Shard(h1, h2, table["n"].to_numpy(), keepers), place
                continue
            if at != place:
                raise RuntimeError("probes without their shard")
            count, keeper = arrays.probe(h1, h2)
            none = table["doc_id"].is_null().to_numpy()
            doc = np.where(none, np.iinfo(np.int64).min, table["doc_id"].fill_null(0).to_numpy())
            lose = (count >= min_docs) & (doc != keeper)
            yield from table.filter(pa.array(lose)).select(["doc_id", "h1", "h2"]).combine_chunks().to_batches(1 << 20)

    return ready.mapInArrow(run, "doc_id long, h1 long, h2 long")


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(text: pd.Series, h1: pd.Series, h2: pd.Series, lost: pd.Series) -> pd.DataFrame:
    kept, dropped = [], []
    for value, a, b, gone in zip(text, h1, h2, lost, strict=True):
        if gone is None:
            kept.append(None)
            dropped.append(0)
            continue
        bad = {(k["h1"], k["h2"]) for k in gone}
        lines = (value or "").split("\n")
        left = [line for line, x, y in zip(lines, a, b, strict=True) if (x, y) not in bad]
        kept.append("\n".join(left))
        dropped.append(len(lines) - len(left))
    return pd.DataFrame({"kept": kept, "n_dropped": dropped})


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text of kept lines, and ``n_lines`` (before) and ``n_dropped`` beside its own columns.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents stays in the largest doc_id
    that holds it, all its lines there, and goes elsewhere.  A null or empty text is one empty line, which stays (null
    becomes empty).  Each row counts as a document; rows of the largest doc_id all keep the line.  A null doc_id is below
    all others.  Columns named like the two new ones are replaced; other columns pass through.  No rows: no rows.
    """
    small_batches(docs.sparkSession)
    lost = build_and_probe(cut(_line_hashes(docs, text, min_chars)), min_docs).groupBy("doc_id").agg(
        F.collect_set(F.struct("h1", "h2")).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("__lost_id"), F.col("lost").alias("__lost"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    hit = F.col("__lost").isNotNull()
    first = F.when(hit, F.transform(lines, lambda x: _hashes(line_key(x))[0]))
    second = F.when(hit, F.transform(lines, lambda x: _hashes(line_key(x))[1]))
    joined = docs.select(*own).join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__lost_id")), "left")
    done = joined.withColumn("__done", _without(F.when(hit, whole), first, second, F.col("__lost")))
    return done.select(
        *(F.when(hit, F.col("__done.kept")).otherwise(whole).alias(c) if c == text else F.col(c) for c in own),
        F.size(lines).cast("long").alias("n_lines"),
        F.col("__done.n_dropped").alias("n_dropped"),
    )
