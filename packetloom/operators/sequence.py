"""Wrapping sequence numbers, block transfers and packet quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import group_first, lag, running_peak, running_sum, scan, span_of
from packetloom.session import cut

MODULUS = 65_536


def unwrap_seq(df: DataFrame, keys: Sequence[str], position: str, seq: str = "seq", modulus: int = MODULUS) -> DataFrame:
    """Add ``extended``: the value congruent to ``seq`` that lies nearest the highest value so far.

    Let ``U`` be the running sum of the folded steps between neighbours and ``M`` the highest ``U`` before a
    row.  ``U`` is the answer for a key exactly when ``U - M`` stays within half the modulus on all its rows.
    Keys where it does not are settled by ``_unwrap_rest``.
    """
    keys = list(keys)
    half = modulus // 2
    stepped = scan(df, keys, position, {"__prev": lag(F.col(seq))})
    raw = F.col(seq).cast("long")
    folded = F.pmod(raw - F.col("__prev") + half, F.lit(modulus)) - half
    step = F.when(F.col("__prev").isNull(), raw).otherwise(folded)
    highest = scan(
        stepped.withColumn("__step", step), keys, position,
        {"extended": running_sum(F.col("__step")), "__high": running_peak(F.col("__step"), inclusive=False)},
    )
    off = (F.col("__high").isNotNull()) & ~(F.col("extended") - F.col("__high")).between(-half, half - 1)
    checked = cut(highest.select(*df.columns, "extended", F.coalesce(off, F.lit(False)).alias("__off")))
    settled = checked.drop("__off")
    strays = checked.where("__off").select(*keys).distinct()
    if strays.isEmpty():
        return settled
    plain = settled.join(strays, keys, "left_anti")
    rest = settled.join(strays, keys, "left_semi").drop("extended")
    return plain.unionByName(_unwrap_rest(rest, keys, position, seq, modulus))


def _span_effect(numbers: np.ndarray, modulus: int) -> np.ndarray:
    """How far each possible residue of the highest value is carried by a run of numbers."""
    half = modulus // 2
    gain = np.zeros(modulus, dtype=np.int64)
    chain = np.arange(modulus)  # residue -> chain it has joined
    state = np.arange(modulus, dtype=np.int64)  # chain -> residue it is at
    moved = np.zeros(modulus, dtype=np.int64)  # chain -> distance since the last merge
    for count, number in enumerate(numbers):
        ahead = (number - state) % modulus
        step = np.where(ahead < half, ahead, 0)
        moved += step
        state = (state + step) % modulus
        if count % 64 == 0 and len(state) > 1:
            # Chains at the same residue behave alike from here on.
            gain += moved[chain]
            state, merged = np.unique(state, return_inverse=True)
            chain = merged[chain]
            moved = np.zeros(len(state), dtype=np.int64)
    return gain + moved[chain]


def _pack(gain: np.ndarray) -> bytes:
    """Run-length form: residues that meet share their end value, residues that stay share gain zero."""
    residues = np.arange(len(gain), dtype=np.int64)
    label = np.where(gain == 0, -1, residues + gain)
    starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    return np.stack([starts, label[starts]]).astype(np.int64).tobytes()


def _apply(packed: bytes, high: np.ndarray, modulus: int) -> np.ndarray:
    starts, labels = np.frombuffer(packed, dtype=np.int64).reshape(2, -1)
    residue = high % modulus
    label = labels[np.searchsorted(starts, residue, side="right") - 1]
    return np.where(label < 0, high, high - residue + label)


FAN_IN = 1024


def _unwrap_rest(df: DataFrame, keys: list[str], position: str, seq: str, modulus: int) -> DataFrame:
    """Exact values where neighbours jump by half the modulus or more.

    The highest value moves only when a number lies ahead of it, so what a span of packets does to it
    depends on its residue alone.  Spans are reduced to that map, maps are joined ``FAN_IN`` at a time, the
    joined maps are applied in order, and the start of every span follows; no task sees a whole key.
    """
    half = modulus // 2
    spanned = df.withColumn("__span", span_of(position))
    head = [df.schema[k] for k in keys] + [T.StructField("__span", T.LongType())]

    def row(group: pd.DataFrame, level: int, **values: object) -> pd.DataFrame:
        fixed = {k: group[k].iloc[0] for k in keys}
        return pd.DataFrame([{**fixed, "__span": int(group["__span"].iloc[0]) // level, **values}])

    def reduce_span(group: pd.DataFrame) -> pd.DataFrame:
        numbers = group.sort_values(position)[seq].to_numpy(dtype=np.int64)
        return row(group, 1, effect=_pack(_span_effect(numbers, modulus)), first=int(numbers[0]))

    def reduce_block(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("__span")
        residues = np.arange(modulus, dtype=np.int64)
        high = residues
        for effect in ordered["effect"]:
            high = _apply(effect, high, modulus)
        return row(ordered, FAN_IN, effect=_pack(high - residues), first=int(ordered["first"].iloc[0]))

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("__span")
        given = ordered["start"].iloc[0] if "start" in ordered else np.nan
        high = int(ordered["first"].iloc[0]) if pd.isna(given) else int(given)
        values = []
        for effect in ordered["effect"]:
            values.append(high)
            high = int(_apply(effect, np.array([high]), modulus)[0])
        return ordered[[*keys, "__span"]].assign(start=values)

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(position)
        high = int(ordered["start"].iloc[0])
        values = []
        for number in ordered[seq].tolist():
            value = high + (int(number) - high + half) % modulus - half
            values.append(value)
            high = max(high, value)
        return ordered.drop(columns=["start", "__span"]).assign(extended=values)

    effect_schema = T.StructType([*head, T.StructField("effect", T.BinaryType()), T.StructField("first", T.LongType())])
    start_schema = T.StructType([*head, T.StructField("start", T.LongType())])
    block = (F.col("__span") / FAN_IN).cast("long")
    spans = cut(spanned.groupBy(*keys, "__span").applyInPandas(reduce_span, schema=effect_schema))
    blocks = spans.groupBy(*keys, block.alias("__block")).applyInPandas(reduce_block, schema=effect_schema)
    block_starts = blocks.groupBy(*keys).applyInPandas(starts, schema=start_schema).withColumnRenamed("__span", "__block")
    span_starts = (
        spans.withColumn("__block", block)
        .join(block_starts, [*keys, "__block"])
        .groupBy(*keys, "__block")
        .applyInPandas(starts, schema=start_schema)
    )
    schema = T.StructType([*df.schema.fields, T.StructField("extended", T.LongType())])
    return spanned.join(span_starts, [*keys, "__span"]).groupBy(*keys, "__span").applyInPandas(follow, schema=schema)


def first_copies(df: DataFrame, keys: Sequence[str], position: str, data: str) -> DataFrame:
    """Mark each packet as the first of its number, a copy of it, or in conflict with it."""
    marked = scan(
        df.withColumn("__digest", F.sha2(F.col(data).cast("binary"), 256)),
        [*keys, "extended"], position,
        {"__first": group_first(F.struct(F.col(position).alias("at"), F.col("__digest").alias("digest")))},
    )
    role = (
        F.when(F.col(position) == F.col("__first.at"), "first")
        .when(F.col("__digest") == F.col("__first.digest"), "duplicate")
        .otherwise("conflict")
    )
    return marked.select(*df.columns, role.alias("copy_role"))


def rtp_quality(packets: DataFrame, keys: Sequence[str], position: str, data: str) -> DataFrame:
    """Packets, copies, conflicts and missing numbers per stream.

    Missing numbers between the lowest and highest are their distance less the distinct numbers in it, so
    no ordering is needed for them.
    """
    marked = first_copies(unwrap_seq(packets, keys, position), keys, position, data)
    totals = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(F.col("copy_role") == "first", 1)).alias("unique_packets"),
        F.count(F.when(F.col("copy_role") == "duplicate", 1)).alias("duplicate_packets"),
        F.count(F.when(F.col("copy_role") == "conflict", 1)).alias("conflicting_packets"),
        F.min("extended").alias("lowest"),
        F.max("extended").alias("highest"),
    )
    return totals.withColumn("missing_packets", F.col("highest") - F.col("lowest") + 1 - F.col("unique_packets"))


def usable_rtp(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets of the two supported payload types with payload, and the others with a reason."""
    supported = F.col("payload_type").isin(0, 8)
    filled = F.octet_length("payload") > 0
    reason = F.when(~supported, "unsupported-payload-type").when(~F.coalesce(filled, F.lit(False)), "empty-payload")
    marked = packets.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def reassemble_blocks(
    packets: DataFrame, sessions: DataFrame, keys: Sequence[str], position: str, data: str, skips: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Block transfers: the first packet of every block, and one status row per transfer.

    ``packets(keys, position, seq, data)``; ``sessions(keys, block_size, server_port, error_code)``, one row
    per key.  Blocks count from one, so numbers before the lowest seen are missing too.  ``skips(keys)`` lists packets that a
    limit kept out before: a transfer with any is ``budget-limited``, unless it failed or was never answered.
    """
    keys = list(keys)
    marked = cut(first_copies(unwrap_seq(packets, keys, position), keys, position, data))
    size = F.octet_length(F.col(data))
    first = F.col("copy_role") == "first"
    number = F.when(first, F.col("extended"))
    totals = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(number).alias("blocks"),
        F.count(F.when(F.col("copy_role") == "conflict", 1)).alias("conflicting_blocks"),
        F.min(number).alias("lowest"),
        F.max(number).alias("highest"),
        F.max_by(size, number).alias("last_size"),
        F.sum(F.when(first, size)).cast("long").alias("payload_bytes"),
    )
    joined = sessions.join(totals, keys, "left")
    if skips is not None:
        lost = skips.groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped_packets"))
        joined = joined.join(lost, keys, "left").fillna(0, ["skipped_packets"])
    limited = F.lit(False) if skips is None else F.col("skipped_packets") > 0
    missing = F.greatest(F.col("lowest") - 1, F.lit(0)) + F.col("highest") - F.col("lowest") + 1 - F.col("blocks")
    measured = joined.select(
        "*",
        (F.col("packets") - F.col("blocks")).alias("duplicate_packets"),
        missing.alias("missing_blocks"),
        (F.col("last_size") < F.col("block_size")).alias("terminal_block_seen"),
    )
    status = (
        F.when(F.col("error_code").isNotNull(), "server-error")
        .when(F.col("server_port").isNull(), "unresolved")
        .when(limited, "budget-limited")
        .when(F.col("packets").isNull(), "no-data")
        .when(F.col("conflicting_blocks") > 0, "conflicting")
        .when((F.col("missing_blocks") > 0) | (F.col("lowest") != 1) | ~F.col("terminal_block_seen"), "partial")
        .when(F.col("payload_bytes") == 0, "empty")
        .otherwise("complete")
    )
    blocks = marked.where(first).drop("copy_role")
    return blocks, measured.withColumn("status", status)
