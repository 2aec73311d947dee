"""Review queue: signals from all results, merged with the states people have set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.functions.text import stable_id

SIGNAL = ["capture_id", "subject_kind", "subject_id", "task_kind", "rule", "priority", "detail", "evidence_id", "evidence_role"]
TASK = ["capture_id", "subject_kind", "subject_id", "task_kind"]
STATES = ["open", "resolved", "dismissed"]
REVIEW_STATES = ["unreviewed", "needs_review", "excluded", "key_evidence"]
MAX_UNSUPPORTED = 25

# Protocol labels with their own rule and priority, and labels that never raise a task.
UNSUPPORTED_RULES = {
    "rtp": ("voip-rtp-audio", 75),
    "rtpevent": ("rtp-telephone-event", 70),
    "sip": ("voip-signaling", 60),
    "sdp": ("voip-signaling", 60),
    "snmp": ("snmp-sensitive-values", 65),
    "icmp": ("icmp-side-channel-review", 55),
    "tftp": ("tftp-traffic", 65),
    "tls": ("tls-encrypted-traffic", 55),
}
QUIET_LABELS = ["dns", "ssdp"]
RISKY_TYPES = ["application/zip", "application/vnd.rar", "application/x-rar", "application/x-dosexec"]


def _signal(
    df: DataFrame, subject_kind: str | Column, subject_id: Column, task_kind: str | Column, rule: str | Column,
    priority: int | Column, detail: Column | None = None, evidence: Column | None = None, role: str | Column | None = None,
) -> DataFrame:
    def lit(value):
        return value if isinstance(value, Column) else F.lit(value)

    none = F.lit(None).cast("string")
    return df.select(
        "capture_id",
        lit(subject_kind).alias("subject_kind"),
        subject_id.cast("string").alias("subject_id"),
        lit(task_kind).alias("task_kind"),
        lit(rule).alias("rule"),
        lit(priority).cast("int").alias("priority"),
        (none if detail is None else detail).alias("detail"),
        (none if evidence is None else evidence.cast("string")).alias("evidence_id"),
        (none if role is None else lit(role)).alias("evidence_role"),
    )


def candidate_signals(candidates: DataFrame) -> DataFrame:
    """``candidates(capture_id, candidate_id, kind, score, evidence_id, role)``, one row per evidence link."""
    kind, score = F.col("kind"), F.col("score")
    rule = F.when(score >= 100, "rank-100-known-format").when(kind == "sensitive-field", "sensitive-field").when(
        (kind == "unknown-flag") & (score >= 70), "unknown-flag-like"
    )
    level = F.when(score >= 100, 100).when(kind == "sensitive-field", 80).otherwise(70)
    detail = F.to_json(F.struct(kind.alias("candidate_kind"), score.alias("rank_score")))
    return _signal(candidates.withColumn("__rule", rule).where("__rule IS NOT NULL"), "candidate", F.col("candidate_id"), "candidate-review", F.col("__rule"), level, detail, F.col("evidence_id"), F.col("role"))


def finding_signals(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("detector") == "http-status-body-contradiction", 90).otherwise(85)
    detail = F.to_json(F.struct("detector", "severity"))
    return _signal(findings, "finding", F.col("finding_id"), "finding-review", F.col("detector"), level, detail)


def artifact_signals(artifacts: DataFrame) -> DataFrame:
    """Unreviewed archives and executables, by type or by name."""
    media = F.lower(F.coalesce("detected_type", F.lit("")))
    name = F.lower(F.coalesce("suggested_name", F.lit("")))
    risky = (F.col("review_state") == "unreviewed") & (media.isin(RISKY_TYPES) | F.rlike(name, F.lit("\\.(?:zip|rar|exe|dll)$")))
    detail = F.to_json(F.struct(media.alias("detected_media_type"), name.alias("suggested_name")))
    return _signal(artifacts.where(risky), "artifact", F.col("artifact_id"), "artifact-review", "unreviewed-archive-or-executable", 80, detail, F.col("artifact_id"), "artifact")


def stream_signals(statuses: DataFrame) -> DataFrame:
    doubtful = F.col("status").isin("partial", "conflicting", "truncated") | (F.col("conflict_bytes") > 0) | (F.col("gap_bytes") > 0)
    detail = F.to_json(F.struct("status", "conflict_bytes", "gap_bytes"))
    subject = F.concat_ws(":", F.lit("tcp"), F.col("stream_index").cast("string"))
    return _signal(statuses.where(doubtful), "conversation", subject, "protocol-review", "tcp-conflict-gap-or-partial", 85, detail)


def transaction_signals(tx: DataFrame) -> DataFrame:
    lone = tx.where("status IN ('unmatched-request', 'orphan-response')")
    level = F.when(F.col("status") == "orphan-response", 75).otherwise(70)
    return _signal(lone, "transaction", F.coalesce("request_frame", "response_frame"), "protocol-review", F.col("status"), level)


def trailing_signals(ranges: DataFrame) -> DataFrame:
    trailing = ranges.where("kind = 'trailing-data'")
    subject = F.concat_ws(":", F.col("parent_id").cast("string"), F.col("start").cast("string"))
    return _signal(trailing, "evidence", subject, "artifact-review", "trailing-data", 65, None, subject, "trailing-data")


def dns_signals(scored: DataFrame) -> DataFrame:
    subject = F.concat_ws("|", "source", "destination", "base_domain", "encoding")
    level = F.least(F.greatest("score", F.lit(60)), F.lit(100))
    return _signal(scored, "evidence", subject, "protocol-review", "suspicious-dns-encoded-labels", level, None, subject, "dns-label-stream")


def block_transfer_signals(transfers: DataFrame) -> DataFrame:
    """``transfers(capture_id, transfer_id, status)``."""
    done = F.col("status").isin("complete", "empty")
    return _signal(
        transfers, "evidence", F.col("transfer_id"), F.when(done, "artifact-review").otherwise("protocol-review"),
        F.when(done, "tftp-file-transfer").otherwise("tftp-incomplete-transfer"), F.when(done, 70).otherwise(85),
        None, F.col("transfer_id"), "tftp-transfer",
    )


def attachment_signals(attachments: DataFrame) -> DataFrame:
    """``attachments(capture_id, attachment_id, status)``."""
    done = F.col("status") == "complete"
    return _signal(
        attachments, "smtp-attachment", F.col("attachment_id"), F.when(done, "artifact-review").otherwise("protocol-review"),
        F.when(done, "smtp-mime-attachment").otherwise("smtp-incomplete-attachment"), F.when(done, 70).otherwise(85),
    )


def coverage_signals(coverage: DataFrame) -> DataFrame:
    weak = coverage.where("status IN ('failed', 'partial', 'budget-limited')")
    level = F.when(F.col("status") == "failed", 90).otherwise(85)
    return _signal(weak, F.col("subject_kind"), F.col("subject_id"), "protocol-review", F.concat(F.lit("analysis-"), F.col("status")), level)


def _unsupported(coverage: DataFrame, observations: DataFrame) -> DataFrame:
    """Labels without an analyzer, ranked by frames.  A capture has at most one row per label here."""
    lacking = coverage.where("subject_kind = 'protocol' AND status = 'unavailable'").select("capture_id", F.col("subject_id").alias("label"))
    rows = observations.join(lacking, ["capture_id", "label"]).where(~F.col("label").isin(QUIET_LABELS))
    order = Window.partitionBy("capture_id").orderBy(F.desc("frame_count"), "label")
    return rows.withColumn("__rank", F.row_number().over(order))


def unsupported_skips(coverage: DataFrame, observations: DataFrame, limit: int = MAX_UNSUPPORTED) -> DataFrame:
    """The labels that ``unsupported_signals`` leaves out, one skip row each."""
    return _unsupported(coverage, observations).where(F.col("__rank") > limit).select(
        "capture_id", "label", "frame_count", F.lit("unsupported-label-limit").alias("reason"))


def unsupported_signals(coverage: DataFrame, observations: DataFrame, limit: int = MAX_UNSUPPORTED) -> DataFrame:
    """Most frequent labels without an analyzer; ``unsupported_skips`` lists the others."""
    top = _unsupported(coverage, observations).where(F.col("__rank") <= limit)
    rule, level = F.lit("unsupported-protocol"), F.least(F.lit(60), F.when(F.col("frame_count") > 10, 40).otherwise(30))
    for label, (name, points) in UNSUPPORTED_RULES.items():
        rule = F.when(F.col("label") == label, name).otherwise(rule)
        level = F.when(F.col("label") == label, points).otherwise(level)
    return _signal(top, "protocol", F.col("label"), "protocol-review", rule, level, F.to_json(F.struct("frame_count", F.col("label").alias("protocol_label"))))


SOURCES = {
    "candidates": candidate_signals,
    "findings": finding_signals,
    "artifacts": artifact_signals,
    "streams": stream_signals,
    "transactions": transaction_signals,
    "trailing": trailing_signals,
    "dns": dns_signals,
    "block_transfers": block_transfer_signals,
    "attachments": attachment_signals,
    "coverage": coverage_signals,
}


def queue_signals(results: Mapping[str, DataFrame], observations: DataFrame | None = None) -> DataFrame:
    """All signals of the results at hand, keyed by the names in ``SOURCES``."""
    parts = [SOURCES[name](df) for name, df in results.items()]
    if observations is not None and "coverage" in results:
        parts.append(unsupported_signals(results["coverage"], observations))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def task_id() -> Column:
    return stable_id("manual-task", *[F.col(c) for c in TASK])


def merge_queue(previous: DataFrame, signals: DataFrame) -> DataFrame:
    """Next queue snapshot.  States set by people stay; a task without a current signal gets priority 0.

    ``previous(capture_id, subject_kind, subject_id, task_kind, state)``.
    """
    current = signals.groupBy(*TASK).agg(
        F.max("priority").alias("priority"), F.count_distinct("rule").alias("signal_count"),
        F.count_distinct("evidence_id", "evidence_role").alias("evidence_count"),
    )
    joined = previous.select(*TASK, "state").join(current, TASK, "full")
    return joined.select(
        *TASK, task_id().alias("task_id"),
        F.coalesce("priority", F.lit(0)).alias("priority"),
        F.coalesce("state", F.lit("open")).alias("state"),
        F.coalesce("signal_count", F.lit(0).cast("long")).alias("signal_count"),
        F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"),
    )


def visible(queue: DataFrame) -> DataFrame:
    """Open tasks that no signal supports any more are hidden; reviewed ones stay."""
    return queue.where("NOT (state = 'open' AND priority = 0)")


def merge_marks(previous: DataFrame, updates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Last mark of every subject; marks of unknown subjects and unknown states are refused.

    ``previous`` and ``updates``: subject_kind, subject_id, state, updated_at.  ``subjects``: subject_kind,
    subject_id.
    """
    key = ["subject_kind", "subject_id"]
    known = subjects.select(*key).distinct()
    valid = updates.where(F.col("state").isin(REVIEW_STATES)).join(known, key, "left_semi")
    both = previous.select(*key, "state", "updated_at").unionByName(valid.select(*key, "state", "updated_at"))
    latest = F.struct("updated_at", "state")
    return both.groupBy(*key).agg(F.max(latest).alias("m")).select(*key, "m.state", "m.updated_at")
