"""Bounded, ordered pages over results.

A page is a top-k: Spark keeps ``offset + limit`` rows per task and never sorts the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.functions.text import bounded_preview, escaped_preview, octets
from packetloom.operators.parameters import form_fields, query_parameters
from packetloom.plans.queue import visible

MAX_PAGE = 1000


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 100) -> DataFrame:
    if offset < 0:
        raise ValueError("offset cannot be negative")
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    return df.orderBy(*order).offset(offset).limit(limit)


def nested(rows: DataFrame, children: DataFrame, key: str, order: Sequence[Column | str], name: str, limit: int) -> DataFrame:
    """Attach the first ``limit`` children of each row of a page.

    ``rows`` is a page of at most ``MAX_PAGE`` rows, so it is small enough to send to every task; the rank
    filter trims children before they are shuffled.
    """
    wanted = children.join(F.broadcast(rows.select(key)), key, "left_semi")
    ranked = wanted.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__rank") <= limit)
    fields = [c for c in children.columns if c != key]
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__rank", *fields))).alias(name))
    counts = wanted.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_total"))
    joined = rows.join(lists, key, "left").join(counts, key, "left")
    total = F.coalesce(F.col(f"{name}_total"), F.lit(0).cast("long"))
    return joined.withColumn(f"{name}_total", total).withColumn(f"{name}_truncated", total > limit)


def queue_page(
    queue: DataFrame, state: str | None = None, kind: str | None = None, min_priority: int = 0,
    subject_kind: str | None = None, subject_id: str | None = None, offset: int = 0, limit: int = 100,
) -> DataFrame:
    rows = visible(queue).where(F.col("priority") >= min_priority)
    for column, value in (("state", state), ("task_kind", kind), ("subject_kind", subject_kind), ("subject_id", subject_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return page(rows, [F.desc("priority"), "task_id"], offset, limit)


def transaction_rows(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Transactions with counts of message roles and of body states.

    ``bodies(capture_id, frame_number, body_status)``.  Counts are grouped before they are joined.
    """
    tx = F.coalesce(F.col("request_frame"), F.col("response_frame"))
    keyed = pairs.withColumn("tx_frame", tx)
    messages = (
        keyed.where("request_frame IS NOT NULL").select("capture_id", "tx_frame", F.col("request_frame").alias("frame_number"), F.lit("request").alias("message_role")).distinct()
        .unionByName(
            keyed.where("response_frame IS NOT NULL").select("capture_id", "tx_frame", F.col("response_frame").alias("frame_number"), F.col("role").alias("message_role")).distinct()
        )
    )
    key = ["capture_id", "tx_frame"]
    located = messages.join(bodies, ["capture_id", "frame_number"], "left")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = located.groupBy(*key).agg(
        count(F.col("message_role") == "request").alias("requests"),
        count(F.col("message_role") == "response").alias("responses"),
        count(F.col("message_role") == "extra_response").alias("extra_responses"),
        count(F.col("body_status") == "complete").alias("complete_bodies"),
        count((F.col("body_status") != "complete") & F.col("body_status").isNotNull()).alias("other_bodies"),
    )
    heads = keyed.groupBy(*key, "status", "stream_index").agg(
        F.min("request_frame").alias("request_frame"), F.min("response_frame").alias("response_frame")
    )
    return heads.join(counts, key)


def transactions_page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return page(rows, ["tx_frame"], offset, limit)


def streams_page(statuses: DataFrame, spans: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Reconstructions with their counts and the frames that supplied accepted bytes; ``spans`` may be the extents of buckets."""
    key = ["capture_id", "stream_index", "direction"]
    frames = spans.groupBy(*key).agg(
        F.min("frame_number").alias("source_frame_start"), F.max("frame_number").alias("source_frame_end"),
        F.min("start").alias("sequence_start"), F.max("end").alias("sequence_end"),
    )
    return page(statuses.join(frames, key, "left"), ["capture_id", "stream_index", "direction"], offset, limit)


def summary_page(observations: DataFrame, profiles: DataFrame, coverage: DataFrame, limit: int = 100) -> DataFrame:
    """Most frequent labels, busiest conversations and coverage counts, as one table of sections.

    The rows of the two limited sections are counted in a section of totals.
    """
    labels = page(observations, [F.desc("frame_count"), "label"], 0, limit).select(
        F.lit("protocol").alias("section"), F.col("label").alias("item"), F.col("frame_count").alias("amount")
    )
    busiest = page(profiles, [F.desc("frame_count"), "transport", "stream_index"], 0, limit).select(
        F.lit("conversation").alias("section"), F.concat_ws(":", "transport", F.col("stream_index").cast("string")).alias("item"), F.col("frame_count").alias("amount")
    )
    counts = coverage.groupBy("status").agg(F.count(F.lit(1)).alias("amount")).select(
        F.lit("coverage").alias("section"), F.col("status").alias("item"), "amount"
    )
    totals = [
        rows.agg(F.count(F.lit(1)).alias("amount")).select(F.lit("total").alias("section"), F.lit(name).alias("item"), "amount")
        for name, rows in (("protocol", observations), ("conversation", profiles))
    ]
    return labels.unionByName(busiest).unionByName(counts).unionByName(totals[0]).unionByName(totals[1])


def severity_order() -> Column:
    s = F.col("severity")
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).otherwise(3)


def candidates_page(candidates: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return page(candidates, [F.desc("score"), "candidate_id"], offset, limit)


def findings_page(findings: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return page(findings, [severity_order(), F.desc("confidence"), "finding_id"], offset, limit)


def timeline_page(
    events: DataFrame, event_kind: str | None = None, status: str | None = None, frame_start: int | None = None,
    frame_end: int | None = None, include_duplicates: bool = False, offset: int = 0, limit: int = 100,
) -> DataFrame:
    """Events in frame order.  ``events`` come from ``mark_duplicates``, which counts repeats before any event
    is filtered out."""
    rows = events
    if not include_duplicates:
        rows = rows.where("duplicate_of IS NULL")
    if event_kind is not None:
        rows = rows.where(F.col("event_kind") == event_kind)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if frame_start is not None:
        rows = rows.where(F.col("request_frame") >= frame_start)
    if frame_end is not None:
        rows = rows.where(F.col("request_frame") <= frame_end)
    return page(rows, ["request_frame", "event_id"], offset, limit)


def transaction_detail(tx: DataFrame, tx_id: int, max_value_bytes: int = 256, max_parameters: int = 256) -> DataFrame:
    """Parameters of one transaction as bounded previews; the filter on the id reaches the scan.

    ``total`` counts the parameters of the source, and ``list_truncated`` tells whether some of them are not shown.
    """
    chosen = tx.where(F.col("tx_id") == tx_id)
    parts = []
    for source, rows in (("query", query_parameters(chosen, "uri")), ("form", form_fields(chosen, "request_body"))):
        counted = rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("tx_id")))
        parts.append(counted.where(F.col("ordinal") < max_parameters).select(
            "tx_id", F.lit(source).alias("source"), "ordinal",
            bounded_preview(F.col("name"), max_value_bytes).alias("name"),
            bounded_preview(F.col("value"), max_value_bytes).alias("value"),
            (octets(F.col("value")) > max_value_bytes).alias("truncated"),
            "total", (F.col("total") > max_parameters).alias("list_truncated"),
        ))
    return parts[0].unionByName(parts[1])


def notes_page(
    notes: DataFrame, subject_kind: str | None = None, subject_id: str | None = None, offset: int = 0, limit: int = 100, max_body_bytes: int = 65_536
) -> DataFrame:
    """Notes in order of creation with bodies cut on whole characters."""
    rows = notes
    if subject_kind is not None:
        rows = rows.where(F.col("subject_kind") == subject_kind)
    if subject_id is not None:
        rows = rows.where(F.col("subject_id") == subject_id)
    chosen = page(rows, ["created_at", "note_id"], offset, limit)
    size = octets(F.col("body"))
    return chosen.withColumn("body_bytes", size).withColumn("body_truncated", size > max_body_bytes).withColumn(
        "body", bounded_preview(F.col("body"), max_body_bytes)
    )


def dialogue_page(
    records: DataFrame, relations: DataFrame, links: DataFrame, dialogue_offset: int = 0, dialogue_limit: int = 50,
    record_limit: int = 500, preview_bytes: int = 120, relation_limit: int = 100, candidate_limit: int = 100,
    sources: DataFrame | None = None, source_limit: int = 100,
) -> DataFrame:
    """First records of a page of dialogues with previews, relations, linked candidates and, if given, their sources.

    ``relations(record_id, related_id, relation)``; ``links(record_id, candidate_id, score)``; ``sources(record_id, frame_number,
    record_offset, byte_length)``, shown as ``frame@offset+length``.  ``body`` is text or bytes.  Each list comes with its
    total and a flag that tells whether it is cut.
    """
    key = ["capture_id", "dialogue_id"]
    chosen = page(records.groupBy(*key).agg(F.min("record_id").alias("first_record")), [*key], dialogue_offset, dialogue_limit)
    inside = records.join(F.broadcast(chosen.select(*key)), key, "left_semi")
    body = F.col("body") if records.schema["body"].dataType.simpleString() == "binary" else F.encode("body", "UTF-8")
    order = Window.partitionBy(*key).orderBy("record_id")
    counts = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("records_total"))
    shown = inside.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= record_limit).select(
        *key, "record_id", "ordinal", "side", "label",
        escaped_preview(F.substring(body, 1, preview_bytes)).alias("preview"),
        (octets(F.col("body")) > preview_bytes).alias("preview_truncated"),
    ).join(counts, key).withColumn("records_truncated", F.col("records_total") > record_limit)
    named = relations.select("record_id", F.concat_ws(":", "relation", F.col("related_id").cast("string")).alias("item"))
    related = _first(shown, named, "relations", relation_limit, ["item"])
    linked = _first(shown, links.select("record_id", F.col("candidate_id").alias("item"), "score"), "candidates", candidate_limit, [F.desc("score"), "item"])
    lists, paged = ["relations", "candidates"], shown.join(related, "record_id", "left").join(linked, "record_id", "left")
    if sources is not None:
        place = F.format_string("%d@%d+%d", "frame_number", "record_offset", "byte_length")
        supplied = sources.select("record_id", place.alias("item"), "record_offset", "frame_number")
        paged = paged.join(_first(shown, supplied, "sources", source_limit, ["record_offset", "frame_number"]), "record_id", "left")
        lists.append("sources")
    return paged.fillna(0, [f"{name}_total" for name in lists]).fillna(False, [f"{name}_truncated" for name in lists])


def _first(shown: DataFrame, children: DataFrame, name: str, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """The first children of the records shown as one text, with their total and whether the list is cut."""
    wanted = children.join(shown.select("record_id").distinct(), "record_id", "left_semi")
    counts = wanted.groupBy("record_id").agg(F.count(F.lit(1)).alias(f"{name}_total"))
    ranked = wanted.withColumn("__rank", F.row_number().over(Window.partitionBy("record_id").orderBy(*order))).where(F.col("__rank") <= limit)
    items = ranked.groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "item"))), lambda p: p["item"]), ",").alias(name)
    )
    return items.join(counts, "record_id").withColumn(f"{name}_truncated", F.col(f"{name}_total") > limit)
