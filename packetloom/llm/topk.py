"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are dealt to blocks.  In a block, each dimension has posting segments: rows whose quantised value is at one level.
For a query all segments of all dimensions are processed by descending impact (weight times distance from the value that
is worst for it).  When all impacts above a height are read, what is unread adds to a row at most the lesser of that height
and the dimension's highest impact, for each dimension not met yet.  Reading stops when this bound proves all but so few
rows out that scoring those exactly takes fewer values than postings are left, or at the end; the rows that may still be
among the k best are then scored exactly.  The best of all blocks are merged.

Equal rows are one posting with their count.  A block is copied once per 8,192 queries, a query once per block.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import cut

SCALE = 256
K = 5
LEVELS = 16
BLOCK_ROWS = 32_768
LEAST_BLOCK_ROWS = 8_192
QUERY_ROWS = 8_192
#: Parts of all postings after which the bound is tried.
STOPS = (0.2, 0.4, 0.55, 0.7, 0.85, 1.0)
FEW = 64


class Index:
    """Posting segments of the rows of one block."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.copies, self.values = ids, copies, values
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.reach = self.high - self.low
        self.width = np.maximum(1, -(-(self.reach + 1) // LEVELS))
        level = (values - self.low) // self.width
        order = np.argsort(level, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T)
        ordered = np.take_along_axis(level, order, axis=0)
        self.bounds = np.stack([np.searchsorted(ordered[:, d], np.arange(LEVELS + 1)) for d in range(values.shape[1])])
        self.sizes = np.diff(self.bounds, axis=1)

    def _segments(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(dimension, level, impact) of the segments by descending impact."""
        levels = np.arange(LEVELS)
        # The most that a row of this level can have over the worst value of its dimension.
        up = np.minimum((levels + 1) * self.width[:, None] - 1, self.reach[:, None])
        down = self.reach[:, None] - levels * self.width[:, None]
        impact = np.abs(query)[:, None] * np.maximum(np.where(query[:, None] > 0, up, down), 0)
        dim, level = np.nonzero(self.sizes)
        order = np.argsort(-impact[dim, level], kind="stable")
        dim, level = dim[order], level[order]
        return dim, level, impact[dim, level].astype(float)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores that hold the k best of the block (ties included), and others."""
        n, dims = self.values.shape
        mine = self.ids == own
        if n <= FEW or not dims:
            rows = np.flatnonzero(~mine)
            return rows, self.values[rows] @ query
        dim, level, impact = self._segments(query)
        base = float(np.where(query > 0, query * self.low, query * self.high).sum())
        top = np.zeros(dims)
        np.maximum.at(top, dim, impact)
        size, begin = self.sizes[dim, level], self.bounds[dim, level]
        end, read = begin + size, np.cumsum(size)
        over, met = np.zeros(n), np.zeros(n)
        best, height, done = -np.inf, 0.0, 0
        for stop in np.unique(np.searchsorted(read, read[-1] * np.array(STOPS)) + 1).tolist():
            part = slice(done, min(stop, len(dim)))
            done = part.stop
            rows = np.concatenate([self.postings[d, a:b] for d, a, b in zip(dim[part].tolist(), begin[part].tolist(), end[part].tolist(), strict=True)])
            before, height = height, impact[done] if done < len(dim) else 0.0
            # ``over`` is a row's impact above the present height, which every met dimension is sure to have.
            over += (before - height) * met + np.bincount(rows, np.repeat(impact[part] - height, size[part]), n)
            bound = base + np.minimum(top, height).sum() + over
            bound[mine] = -np.inf
            some = np.argpartition(bound, n - FEW)[n - FEW :]
            some = some[~mine[some]]
            if len(some) >= k:
                best = max(best, float(np.partition(self.values[some] @ query, len(some) - k)[len(some) - k]))
            possible = bound >= best
            if np.count_nonzero(possible) * dims <= read[-1] - read[done - 1]:
                break
            met += np.bincount(rows, minlength=n)
        rows = np.flatnonzero(possible & ~mine)
        return rows, self.values[rows] @ query


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of each component, for vectors without null or non-finite components."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by ``every``.

    Candidates are all rows with another vec_id and the same number of components; repeated rows are candidates each, and
    a query that is repeated is answered once.  Null vectors, vectors with null or non-finite components and null vec_ids
    take no part.  Scores must fit a long and their parts 53 bits.  No rows: no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    base = cut(quantised(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v")))
    asks = base.where(F.col("vec_id") % every == 0)
    rows, queries = base.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    # As many blocks as the cluster has partitions for, but none very small or large.
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / LEAST_BLOCK_ROWS))
    blocks, groups = max(1, least, ceil(rows / BLOCK_ROWS)), max(1, ceil(queries / QUERY_ROWS))
    # Every block meets every group of queries: blocks are copied once per group, groups once per block.
    left = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asks.drop("copies").withColumn("batch", F.pmod(F.xxhash64("v", "vec_id"), F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(part: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if part.num_rows and ask.num_rows:
            dims = part["dims"][0].as_py()
            index = Index(part["vec_id"].to_numpy(), part["copies"].to_numpy(), _matrix(part, dims))
            asked = _matrix(ask, dims)
            for a, (own, query) in enumerate(zip(ask["vec_id"].to_pylist(), asked, strict=True)):
                found, scores = index.search(own, query, k)
                first = np.lexsort((index.ids[found], -scores))[:k]
                first = np.repeat(first, np.minimum(index.copies[found[first]], k))[:k]
                for column, values in zip(out, (np.full(len(first), own), np.full(len(first), a), index.ids[found[first]], scores[first]), strict=True):
                    column.append(values)
        q, a, v, s = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out)
        marks = ask["mark"].to_numpy()[a] if len(a) else np.zeros(0, np.int64)
        return pa.table({"query_id": q, "mark": marks, "vec_id": v, "score": s})

    keys = ["dims", "block", "batch"]
    asked = right.withColumn("mark", F.xxhash64("v"))
    found = left.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dims)
