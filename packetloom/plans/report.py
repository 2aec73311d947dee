"""Reports, assessments, range exports and incremental work lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.operators.budget import byte_budget


def collection(df: DataFrame, name: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """First rows of a result as sorted JSON with the total: one row per item and one head row.

    ``limit`` bounds the items, so ranking the limited rows in one task is safe.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    items = df.orderBy(*order).limit(limit)
    numbered = items.select(
        F.row_number().over(Window.orderBy(*order)).alias("ordinal"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("item")
    )
    shown = F.least(F.col("total"), F.lit(limit).cast("long"))
    head = total.select(
        F.lit(name).alias("collection"), F.lit(0).alias("ordinal"),
        F.to_json(F.struct(shown.alias("count"), F.lit(limit).alias("limit"), F.col("total"), (shown < F.col("total")).alias("truncated"))).alias("item"),
    )
    return head.unionByName(numbered.select(F.lit(name).alias("collection"), "ordinal", "item"))


def build_report(collections: Mapping[str, tuple[DataFrame, Sequence[Column | str], int]]) -> DataFrame:
    """All collections of a report as rows ``(collection, ordinal, item)`` plus one overview row each."""
    report: DataFrame | None = None
    for name in sorted(collections):
        df, order, limit = collections[name]
        part = collection(df, name, order, limit)
        report = part if report is None else report.unionByName(part)
    if report is None:
        raise ValueError("a report needs at least one collection")
    return report


def write_report(report: DataFrame, path: str) -> None:
    """One folder per collection, lines in item order."""
    report.orderBy("collection", "ordinal").write.mode("error").partitionBy("collection").json(path)


def overview(collections: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("collection"), "total") for name, df in sorted(collections.items())]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def artifact_class(media: Column) -> Column:
    text = F.coalesce(media, F.lit(""))
    return (
        F.when(F.startswith(text, F.lit("image/")), "image")
        .when(F.startswith(text, F.lit("audio/")), "audio")
        .when(F.rlike(text, F.lit("zip|rar|gzip|compressed")), "archive")
        .when(F.contains(text, F.lit("executable")) | (text == "application/x-dosexec"), "executable")
        .otherwise("other")
    )


def behaviour_kind(detector: Column) -> Column:
    return (
        F.when(F.contains(detector, F.lit("sql-injection")), "sql-injection")
        .when(F.contains(detector, F.lit("webshell")), "webshell-activity")
        .when(F.contains(detector, F.lit("ognl")), "web-command-execution")
        .when(detector == "icmp-ttl-oracle", "icmp-ttl-oracle")
        .when(F.startswith(detector, F.lit("image-analyzer")), "image-analysis")
        .otherwise(detector)
    )


# Labels and evidence kinds that are behaviours in themselves.
LABEL_BEHAVIOURS = {"rtp": "voip-traffic", "snmp": "snmp-traffic"}
EVIDENCE_BEHAVIOURS = {"dns-label-stream": "dns-encoded-labels", "tftp-data": "tftp-file-transfer", "smtp-attachment": "smtp-mime-attachment"}


def assessment(artifacts: DataFrame, findings: DataFrame, observations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Counts of artifact classes and of behaviours: ``(section, kind, source, amount)``."""
    count = F.count(F.lit(1)).alias("amount")
    parts = [
        artifacts.groupBy(artifact_class(F.col("detected_type")).alias("kind")).agg(count).select(
            F.lit("artifact").alias("section"), "kind", F.lit("media-type").alias("source"), "amount"
        ),
        findings.groupBy("detector").agg(count).select(
            F.lit("behaviour").alias("section"), behaviour_kind(F.col("detector")).alias("kind"), F.col("detector").alias("source"), "amount"
        ),
    ]
    for label, kind in LABEL_BEHAVIOURS.items():
        parts.append(observations.where(F.col("label") == label).groupBy("label").agg(F.sum("frame_count").alias("amount")).select(
            F.lit("behaviour").alias("section"), F.lit(kind).alias("kind"), F.lit("protocol-inventory").alias("source"), "amount"
        ))
    if evidence is not None:
        for source_kind, kind in EVIDENCE_BEHAVIOURS.items():
            parts.append(evidence.where(F.col("source_kind") == source_kind).groupBy("source_kind").agg(count).select(
                F.lit("behaviour").alias("section"), F.lit(kind).alias("kind"), F.col("source_kind").alias("source"), "amount"
            ))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def export_ranges(
    ranges: DataFrame, content: DataFrame, max_item_bytes: int, max_total_bytes: int, order: str, mode: str = "greedy"
) -> tuple[DataFrame, DataFrame]:
    """Bytes of each evidence range with hash, and the ranges that cannot be exported with a reason.

    ``ranges(evidence_id, content_hash, offset, length)``; ``content(content_hash, content, complete)``.
    Sound ranges are charged to the total limit in ``order``; ``greedy`` passes over one that does not fit,
    ``prefix`` stops at it.  Sizes are judged first, so bytes are only read for what is exported.
    """
    stored = content.select("content_hash", F.octet_length(F.col("content").cast("binary")).alias("__size"), "complete")
    joined = ranges.join(stored, "content_hash", "left")
    start = F.coalesce("offset", F.lit(0).cast("long"))
    length = F.coalesce(F.col("length"), F.col("__size") - start).cast("long")
    reason = (
        F.when(F.col("offset") < 0, "invalid-offset")
        .when(F.col("length") < 0, "invalid-length")
        .when(F.col("__size").isNull(), "no-stored-bytes")
        .when(~F.col("complete"), "blob-incomplete")
        .when(start + length > F.col("__size"), "range-out-of-bounds")
        .when(length > max_item_bytes, "item-byte-limit")
    )
    columns = dict.fromkeys(["evidence_id", "content_hash", order])
    judged = joined.select(
        *columns, start.alias("__start"), length.alias("byte_length"), F.lit(1).alias("__scope"), reason.alias("__reason")
    )
    sound = judged.where("__reason IS NULL").drop("__reason")
    kept, over = byte_budget(sound, ["__scope"], order, "byte_length", max_total_bytes, mode, "total-byte-limit")
    data = content.select("content_hash", F.col("content").cast("binary").alias("__data"))
    piece = F.substring("__data", (F.col("__start") + 1).cast("int"), F.col("byte_length").cast("int"))
    exported = kept.join(data, "content_hash").select("evidence_id", "byte_length", piece.alias("data")).withColumn("sha256", F.sha2("data", 256))
    skips = judged.where("__reason IS NOT NULL").select("evidence_id", F.col("__reason").alias("reason"))
    return exported, skips.unionByName(over.select("evidence_id", "reason"))


def pending(items: DataFrame, runs: DataFrame, policy: str, key: str) -> DataFrame:
    """Items without a completed run under the policy."""
    done = runs.where((F.col("policy") == policy) & (F.col("status") == "completed")).select(key).distinct()
    return items.join(done, key, "left_anti")
