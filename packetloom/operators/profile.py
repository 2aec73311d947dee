"""Protocol observations, conversation profiles, roles and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.sources.fields import direction, endpoint

# Labels a stream may carry and still count as plain data.
PLAIN_LABELS = ["data", "eth", "ethertype", "ip", "ipv6", "linux-sll", "null", "sll", "sll2", "tcp", "tcp.segments", "vlan"]
# Labels that need no analyzer.
BASE_LABELS = ["frame", "eth", "ethertype", "ip", "ipv6", "tcp", "udp"]
INCOMPLETE = ["partial", "truncated", "conflicting"]


def normalize_frames(df: DataFrame) -> DataFrame:
    """Label array, endpoints and direction of each frame; UDP payload is the datagram less its header."""
    return df.select(
        "*",
        F.filter(F.split("protocols", ":"), lambda label: label != "").alias("labels"),
        endpoint(F.col("source"), F.col("source_port")).alias("endpoint_a"),
        endpoint(F.col("destination"), F.col("destination_port")).alias("endpoint_b"),
        direction(F.col("source"), F.col("source_port"), F.col("destination"), F.col("destination_port")).alias("direction"),
    )


def protocol_observations(frames: DataFrame) -> DataFrame:
    """Frames, first and last frame of every label of a capture."""
    labelled = frames.select("capture_id", "frame_number", F.explode("labels").alias("label"))
    return labelled.groupBy("capture_id", "label").agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
    )


def stream_roles(frames: DataFrame) -> DataFrame:
    """Who opened each TCP stream: the sender of the first SYN without ACK, else unknown."""
    opening = F.when((F.col("transport") == "tcp") & F.col("syn") & ~F.col("ack"), F.col("frame_number"))
    return (
        frames.where("stream_index IS NOT NULL")
        .groupBy("capture_id", "transport", "stream_index")
        .agg(
            F.min_by("endpoint_a", opening).alias("initiator"),
            F.min_by("endpoint_b", opening).alias("responder"),
            F.min(opening).alias("syn_frame"),
        )
        .withColumn("midstream", F.col("syn_frame").isNull())
    )


def conversation_profiles(frames: DataFrame) -> DataFrame:
    """Totals of each stream.  Labels are gathered from the distinct labels of a stream, not from its frames."""
    keys = ["capture_id", "transport", "stream_index"]
    usable = frames.where(
        "transport IS NOT NULL AND stream_index IS NOT NULL AND source IS NOT NULL AND destination IS NOT NULL "
        "AND source_port IS NOT NULL AND destination_port IS NOT NULL"
    )
    opening = F.when((F.col("transport") == "tcp") & F.col("syn") & ~F.col("ack"), F.col("frame_number"))
    totals = usable.groupBy(*keys).agg(
        F.min_by("endpoint_a", "frame_number").alias("endpoint_a"),
        F.min_by("endpoint_b", "frame_number").alias("endpoint_b"),
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
        F.min_by("frame_time", "frame_number").alias("first_time"),
        F.max_by("frame_time", "frame_number").alias("last_time"),
        F.count(F.lit(1)).alias("frame_count"),
        F.sum(F.col("captured_length").cast("long")).alias("captured_bytes"),
        F.sum(F.col("frame_length").cast("long")).alias("wire_bytes"),
        F.sum(F.coalesce(F.col("payload_length"), F.lit(0)).cast("long")).alias("payload_bytes"),
        F.min_by("endpoint_a", opening).alias("initiator"),
        F.min_by("endpoint_b", opening).alias("responder"),
    )
    labels = (
        usable.select(*keys, F.explode("labels").alias("label"))
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("label")).alias("labels"))
    )
    return totals.join(labels, keys, "left")


def missing_conversation_fields(frames: DataFrame) -> DataFrame:
    """Frames with a transport but without the fields a conversation needs, as skip rows."""
    return frames.where(
        "transport IS NOT NULL AND (stream_index IS NULL OR source IS NULL OR destination IS NULL "
        "OR source_port IS NULL OR destination_port IS NULL)"
    ).withColumn("reason", F.lit("missing-conversation-fields"))


def select_generic(profiles: DataFrame) -> DataFrame:
    """TCP streams that carry plain data and no label of a known application."""
    allowed = F.array(*[F.lit(label) for label in PLAIN_LABELS])
    lowered = F.transform("labels", F.lower)
    return profiles.where(
        (F.col("transport") == "tcp")
        & (F.col("payload_bytes") > 0)
        & F.array_contains(lowered, "data")
        & (F.size(F.array_except(lowered, allowed)) == 0)
    )


def coverage_status(available: Column, analyzer: Column, reconstruction: Column, budget_limited: Column) -> Column:
    """First rule that applies decides how far a subject was analysed."""
    return (
        F.when(~available, "unavailable")
        .when(analyzer == "failed", "failed")
        .when((analyzer == "budget-limited") | budget_limited, "budget-limited")
        .when(analyzer.isin(INCOMPLETE) | reconstruction.isin(INCOMPLETE), "partial")
        .when((analyzer == "complete") | (reconstruction == "complete"), "complete")
        .otherwise("not-run")
    )


def fold_states(states: DataFrame, keys: Sequence[str], label: str = "status") -> DataFrame:
    """One status per key from the states of its items: failed, partial, complete, or none."""
    state = F.col("state")
    partial = state.isin([*INCOMPLETE, "skipped-budget"])
    return (
        states.groupBy(*keys)
        .agg(
            F.bool_or(state == "failed").alias("__failed"),
            F.bool_or(partial).alias("__partial"),
            F.bool_and(state.isin("complete", "empty")).alias("__complete"),
        )
        .select(
            *keys,
            F.when(F.col("__failed"), "failed").when(F.col("__partial"), "partial").when(F.col("__complete"), "complete").alias(label),
        )
    )


def coverage(
    observations: DataFrame,
    profiles: DataFrame,
    analyzers: DataFrame,
    reconstructions: DataFrame,
    capabilities: Sequence[str],
    budget_limited: bool | DataFrame = False,
) -> DataFrame:
    """Coverage rows of protocols and conversations.

    ``budget_limited`` tells whether a limit cut the frames: for all captures, or by the skip rows (``capture_id``) of a limit.

    ``analyzers(capture_id, label, status)`` and ``reconstructions(capture_id, stream_index, status)`` hold
    one row per subject; ``capabilities`` is the dissector's short list of labels it can decode.
    """
    none = F.lit(None).cast("string")
    if isinstance(budget_limited, DataFrame):
        cut_off = budget_limited.select("capture_id").distinct().withColumn("__limited", F.lit(True))
        observations, profiles = (part.join(cut_off, "capture_id", "left") for part in (observations, profiles))
        limited = F.coalesce("__limited", F.lit(False))
    else:
        limited = F.lit(budget_limited)
    able = F.col("label").isin([*BASE_LABELS, *capabilities])
    protocols = observations.join(analyzers, ["capture_id", "label"], "left").select(
        "capture_id",
        F.lit("protocol").alias("subject_kind"),
        F.col("label").alias("subject_id"),
        coverage_status(able, F.col("status"), none, limited).alias("status"),
    )
    conversations = (
        profiles.join(reconstructions, ["capture_id", "stream_index"], "left")
        .withColumn("status", F.when(F.col("transport") == "tcp", F.col("status")))
        .select(
            "capture_id",
            F.lit("conversation").alias("subject_kind"),
            F.concat_ws(":", "transport", F.col("stream_index").cast("string")).alias("subject_id"),
            coverage_status(F.lit(True), none, F.col("status"), limited).alias("status"),
        )
    )
    return protocols.unionByName(conversations)


def coverage_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("capture_id", "status").agg(F.count(F.lit(1)).alias("subjects"))


def run_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst status and summed counters over the runs of each key."""
    ladder = ["completed", "budget-limited", "partial", "failed"]
    worst = F.max(F.array_position(F.array(*[F.lit(s) for s in ladder]), F.col("status")))
    return runs.groupBy(*keys).agg(
        F.element_at(F.array(*[F.lit(s) for s in ladder]), worst.cast("int")).alias("status"),
        F.sum("processed").cast("long").alias("processed"),
        F.sum("skipped").cast("long").alias("skipped"),
        F.sum("events").cast("long").alias("events"),
        F.count(F.lit(1)).alias("runs"),
    )
