"""Limits that keep what fits and list everything else as skips."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import row_number, running_count, running_sum, scan, spread_join
from packetloom.session import cut, small_partitions

# Keys of more rows than this are settled by scans, the others by a walk over their rows in order.
HOT_ROWS = 1 << 20
# Wide columns of keys of more bytes than this stay behind in the walk and are joined by position.
HOT_BYTES = 64 << 20
# What the walk says of a row: taken, over the bytes that are left, or after the last one that may be taken.
KEPT, BYTES, ROW = range(3)


def _outcome(marked: DataFrame, kept: str, reason: str) -> tuple[DataFrame, DataFrame]:
    skips = marked.where(f"NOT ({kept})").withColumn("reason", F.lit(reason))
    return marked.where(kept), skips


def limit_rows(
    df: DataFrame, keys: Sequence[str], position: str, limit: int, reason: str = "row-limit", ties: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """First ``limit`` rows of every key in order; the rest are skips."""
    ranked = scan(df, keys, position, {"__rank": row_number()}, ties)
    kept, skips = _outcome(ranked, f"__rank <= {int(limit)}", reason)
    return kept.drop("__rank"), skips.drop("__rank")


def limit_groups(
    df: DataFrame, scope: Sequence[str], group: Sequence[str], position: str, limit: int, reason: str = "group-limit"
) -> tuple[DataFrame, DataFrame]:
    """Admit the ``limit`` groups seen first in each scope; rows of later groups are skips."""
    keys = [*scope, *group]
    firsts = df.groupBy(*keys).agg(F.min(position).alias("__first"))
    admitted = scan(firsts, scope, "__first", {"__order": row_number()}, ties=list(group)).select(*keys, "__order")
    marked = spread_join(df, admitted, keys, position)
    kept, skips = _outcome(marked, f"__order <= {int(limit)}", reason)
    return kept.drop("__order"), skips.drop("__order")


def byte_budget(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    size: str,
    limit: int,
    mode: str = "prefix",
    reason: str = "byte-budget",
    ties: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Rows whose sizes fit the budget of their key.

    ``prefix`` stops at the first row that does not fit.  ``greedy`` passes over a row that does not fit
    and still takes later, smaller rows.
    """
    if mode == "prefix":
        summed = scan(df, keys, position, {"__upto": running_sum(F.col(size).cast("long"))}, ties)
        kept, skips = _outcome(summed, f"__upto <= {int(limit)}", reason)
        return kept.drop("__upto"), skips.drop("__upto")
    if mode != "greedy":
        raise ValueError(f"unknown budget mode {mode}")
    marked = _greedy(df, list(keys), position, size, int(limit))
    kept, skips = _outcome(marked, "__kept", reason)
    return kept.drop("__kept"), skips.drop("__kept")


def _greedy(df: DataFrame, keys: list[str], position: str, size: str, limit: int) -> DataFrame:
    """Exact greedy admission: rows with ``__kept``, written once since both outcomes read them."""
    small_partitions(df.sparkSession)
    crowded = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > HOT_ROWS).select(*keys))
    if crowded.isEmpty():
        return cut(_walked(df, keys, position, size, limit))
    walked = _walked(df.join(crowded, keys, "left_anti").select(*df.columns), keys, position, size, limit)
    return cut(walked).unionByName(_scanned(df.join(crowded, keys, "left_semi").select(*df.columns), keys, position, size, limit))


def greedy_limits(
    df: DataFrame, keys: Sequence[str], position: str, size: str, max_bytes: int, max_rows: int, wide: Sequence[str] = (),
    byte_reason: str = "byte-budget", row_reason: str = "row-limit",
) -> DataFrame:
    """Rows with the ``reason`` why they are left out, null where they are kept; the ``wide`` columns of those left out are null.

    In order, a row that would pass ``max_bytes`` is passed over and later, smaller ones are still taken; after ``max_rows`` are
    taken all others are left out.  ``wide`` columns are shuffled once, in the walk; those of keys of more than ``HOT_BYTES`` are joined
    by position instead, so that no task gets a long key's.  ``position`` must be unique within a key.  The result is written once.
    """
    keys = list(keys)
    small_partitions(df.sparkSession)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.col(size).cast("long")).alias("__bytes"))
    hot = cut(totals.where((F.col("__rows") > HOT_ROWS) | (F.col("__bytes") > HOT_BYTES)).select(*keys))
    reason = F.when(F.col("__code") == ROW, row_reason).when(F.col("__code") == BYTES, byte_reason).alias("reason")
    columns = [*df.columns, reason]
    if hot.isEmpty():
        return cut(_admitted(df, keys, position, size, max_bytes, max_rows, wide).select(*columns))
    light = _admitted(df.join(hot, keys, "left_anti").select(*df.columns), keys, position, size, max_bytes, max_rows, wide).select(*columns)
    long = df.join(hot, keys, "left_semi").select(*df.columns)
    marked = _greedy(cut(long.drop(*wide)), keys, position, size, max_bytes)
    counted = scan(marked, keys, position, {"__taken": running_count(F.col("__kept"), inclusive=False)})
    code = F.when(F.col("__taken") >= max_rows, ROW).when(~F.col("__kept"), BYTES).otherwise(KEPT).cast("byte")
    settled = cut(counted.select(*[c for c in df.columns if c not in wide], code.alias("__code")))
    place = [*keys, position]
    kept = long.join(settled.where(F.col("__code") == KEPT).select(*place, "__code"), place)
    over = settled.where(F.col("__code") != KEPT).withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in wide})
    return cut(light.unionByName(kept.select(*columns)).unionByName(over.select(*columns)))


def _walker(keys: list[str], limit: int, most: int | None = None, wide: Sequence[str] = ()):
    """Task function over rows sorted by key and position; of what came before only the last key and its rest are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, free = None, limit, most
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, dtype=bool)
            starts[0] = tuple(batch[key][0].as_py() for key in keys) != last
            for key in keys:
                values = batch[key].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] |= values[1:] != values[:-1]
            codes = []
            for start, size in zip(starts.tolist(), batch["__size"].to_pylist()):
                if start:
                    left, free = limit, most
                if free == 0:
                    codes.append(ROW)
                elif size is None or size > left:
                    codes.append(BYTES)
                else:
                    left -= size
                    free = None if free is None else free - 1
                    codes.append(KEPT)
            last = tuple(batch[key][batch.num_rows - 1].as_py() for key in keys)
            names = [name for name in batch.schema.names if name != "__size"]
            code = pa.array(codes, pa.int8())
            kept = pc.equal(code, KEPT)
            values = (pc.if_else(kept, batch[name], pa.scalar(None, batch[name].type)) if name in wide else batch[name] for name in names)
            yield pa.RecordBatch.from_arrays([*values, code], names=[*names, "__code"])

    return run


def _admitted(
    df: DataFrame, keys: list[str], position: str, size: str, limit: int, most: int | None = None, wide: Sequence[str] = ()
) -> DataFrame:
    """Rows with what the walk says of them (``__code``).  They are shuffled once and walked in order, a key in one task."""
    dealt = df.withColumn("__size", F.col(size).cast("long")).repartition(*keys).sortWithinPartitions(*keys, position)
    fields = [T.StructField(f.name, f.dataType, f.nullable or f.name in wide) for f in df.schema.fields]
    return dealt.mapInArrow(_walker(keys, limit, most, wide), T.StructType([*fields, T.StructField("__code", T.ByteType())]))


def _walked(df: DataFrame, keys: list[str], position: str, size: str, limit: int) -> DataFrame:
    walked = _admitted(df, keys, position, size, limit)
    return walked.select(*df.columns, (F.col("__code") == KEPT).alias("__kept"))


def _scanned(df: DataFrame, keys: list[str], position: str, size: str, limit: int) -> DataFrame:
    """Exact greedy admission without a row-by-row fold.

    While the remaining budget lies in ``[2^k, 2^(k+1))`` every row smaller than ``2^k`` fits, every row of
    at least ``2^(k+1)`` does not, and at most one row in between can be taken, since it leaves less than
    ``2^k``.  So one ordered scan settles one power of two, and the number of scans is the bit length of
    the limit, whatever the number of rows.  ``position`` must be unique within a key.
    """
    work = df.withColumn("__size", F.col(size).cast("long")).withColumn("__left", F.lit(limit).cast("long"))
    columns = [*df.columns, "__size", "__left"]
    done: DataFrame | None = None
    for power in range(limit.bit_length() - 1, -1, -1):
        low, high = 1 << power, 1 << (power + 1)
        live = F.col("__left") >= low
        small = live & (F.col("__size") < low)
        marked = scan(
            work.withColumn("__small", F.when(small, F.col("__size")).otherwise(F.lit(0))),
            keys, position, {"__before": running_sum(F.col("__small"), inclusive=False)},
        )
        budget = F.col("__left") - F.col("__before")
        running = live & (budget >= low)
        middle = running & F.col("__size").between(low, high - 1) & (F.col("__size") <= budget)
        # The step ends at the first middle row taken, or at the small row that leaves less than 2^k.
        drops = running & (F.col("__size") < low) & (budget - F.col("__size") < low)
        ends = marked.withColumn("__end", F.when(middle | drops, F.col(position))).withColumn("__after", budget - F.col("__size"))
        closing = ends.groupBy(*keys).agg(F.min("__end").alias("__stop"), F.min_by("__after", "__end").alias("__rest"))
        closed = spread_join(ends, closing, keys, position)
        settled = live & (F.col("__stop").isNull() | (F.col(position) <= F.col("__stop")))
        taken = (F.col("__size") < low) | (F.col(position) == F.col("__stop"))
        step = cut(
            closed.select(
                *df.columns, "__size",
                F.when(live, F.col("__rest")).otherwise(F.col("__left")).alias("__left"),
                settled.alias("__settled"), F.coalesce(taken, F.lit(False)).alias("__kept"),
            )
        )
        part = step.where("__settled").select(*df.columns, "__kept")
        done = part if done is None else done.unionByName(part)
        work = step.where("NOT __settled").select(*columns)
    rest = work.select(*df.columns, F.coalesce(F.col("__size") == 0, F.lit(False)).alias("__kept"))
    return rest if done is None else done.unionByName(rest)


def skip_counts(skips: DataFrame, scope: Sequence[str]) -> DataFrame:
    """How many rows each scope lost for each reason."""
    return skips.groupBy(*scope, "reason").agg(F.count(F.lit(1)).alias("skipped"))

