"""Injected request parameters: signals, clean baselines, events and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.functions.text import bounded_preview, stable_id
from packetloom.operators.ordered import group_first, group_sum, last_value, next_value, scan
from packetloom.operators.parameters import form_fields, query_parameters, target_key, uri_path

# Patterns of the signals and their weights.
PATTERNS = {
    "boolean-expression": "(?is)(?:['\")\\d]|\\b)\\s*(?:or|and)\\s+(?:['\"]?\\w+['\"]?\\s*=\\s*['\"]?\\w+|\\d+\\s*[<>]=?\\s*\\d+)",
    "union-select": "(?is)\\bunion\\s+(?:all\\s+)?select\\b",
    "time-delay": "(?is)\\b(?:sleep|benchmark|pg_sleep)\\s*\\(|\\bwaitfor\\s+delay\\b",
    "stacked-statement": "(?is);\\s*(?:select|insert|update|delete|drop|alter|create|exec(?:ute)?)\\b",
    "metadata-query": "(?is)\\b(?:information_schema|sqlite_master|pg_catalog|sysobjects|syscolumns)\\b",
    "comment-truncation": "(?s)(?:--(?:\\s|$)|#|/\\*)",
}
SELECT = "(?is)\\bselect\\b"
WEIGHTS = {
    "boolean-expression": 0.68,
    "union-select": 0.82,
    "time-delay": 0.88,
    "stacked-statement": 0.78,
    "metadata-query": 0.72,
    "comment-truncation": 0.35,
}
DETECTOR = "http-sql-injection-behavior"
UNUSABLE = ["missing", "partial", "limit-truncated", "length-mismatch"]


def collect_parameters(tx: DataFrame) -> DataFrame:
    """Query and form parameters of every request with their target; form names and values are decoded."""
    keep = ["capture_id", "tx_id", "request_frame", "response_frame", "response_code", "response_length", "body_status", "method", "path"]
    base = tx.withColumn("path", uri_path(F.col("uri"))).withColumn("response_length", F.col("extracted_length"))
    parts = []
    for source, rows in (("query", query_parameters(base, "uri")), ("form", form_fields(base, "request_body"))):
        parts.append(rows.select(*keep, F.lit(source).alias("source"), "ordinal", "name", "value", "value_offset", "raw_length"))
    both = parts[0].unionByName(parts[1])
    return both.withColumn("target", target_key(F.col("method"), F.col("path"), F.col("name")))


def signal_list(value: Column) -> Column:
    found = {name: F.rlike(value, F.lit(pattern)) for name, pattern in PATTERNS.items()}
    found["metadata-query"] = found["metadata-query"] & F.rlike(value, F.lit(SELECT))
    strong = [F.when(found[name], F.lit(name)) for name in PATTERNS if name != "comment-truncation"]
    first = F.array_compact(F.array(*strong))
    quoted = F.contains(value, F.lit("'")) | F.contains(value, F.lit('"'))
    comment = found["comment-truncation"] & (quoted | (F.size(first) > 0))
    return F.when(comment, F.concat(first, F.array(F.lit("comment-truncation")))).otherwise(first)


def sql_signals(params: DataFrame) -> DataFrame:
    """Signals of each value and the confidence they give together."""
    weights = F.create_map(*[F.lit(item) for pair in WEIGHTS.items() for item in pair])
    marked = params.withColumn("signals", signal_list(F.col("value")))
    top = F.coalesce(F.array_max(F.transform("signals", lambda s: weights[s])), F.lit(0.0))
    more = F.size("signals") - 1
    return marked.withColumn(
        "confidence", F.when(more > 0, F.least(F.lit(0.97), top + 0.08 * more)).otherwise(top)
    )


BASELINE_FIELDS = ["request_frame", "response_frame", "response_code", "response_length", "body_status", "row_id"]


def nearest_baseline(params: DataFrame) -> DataFrame:
    """Nearest clean parameter of the same target for every suspicious one: least distance in frames, then
    the lower frame.

    One ordered scan over a target finds the clean neighbour on either side; clean rows come first within
    a frame, so a clean row in the same frame is the one before.
    """
    clean = F.size("signals") == 0
    row_id = F.concat_ws(":", "source", F.lpad(F.col("ordinal").cast("string"), 9, "0"), F.col("tx_id").cast("string"))
    rows = params.withColumn("row_id", row_id).withColumn("__dirty", F.when(clean, 0).otherwise(1))
    # Of several clean rows in one frame the first counts; they all come from one request.
    same = Window.partitionBy("capture_id", "target", "request_frame", "__dirty").orderBy("row_id")
    rows = rows.withColumn("__nth", F.row_number().over(same))
    clean = clean & (F.col("__nth") == 1)
    facts = F.struct(*[F.col(c) for c in BASELINE_FIELDS])
    found = scan(
        rows, ["capture_id", "target"], "request_frame",
        {
            "__back": last_value(F.when(clean, facts)),
            "__ahead": next_value(F.when(clean, facts)),
        },
        ties=["__dirty", "row_id"],
    ).where("__dirty = 1")
    gap_back = F.col("request_frame") - F.col("__back.request_frame")
    gap_ahead = F.col("__ahead.request_frame") - F.col("request_frame")
    use_back = F.col("__back").isNotNull() & (F.col("__ahead").isNull() | (gap_back <= gap_ahead))
    return found.withColumn("baseline", F.when(use_back, F.col("__back")).otherwise(F.col("__ahead"))).drop("__back", "__ahead", "__dirty", "__nth")


def response_diff(rows: DataFrame) -> DataFrame:
    """Whether the response differs from the baseline's: another code, or a clearly different length."""
    base = F.col("baseline")
    code = ~F.col("response_code").eqNullSafe(base["response_code"])
    delta = F.abs(F.col("response_length") - base["response_length"])
    length = (delta >= 32) & (delta >= F.greatest(F.lit(1), F.floor(base["response_length"] / 10)))
    known = base.isNotNull()
    return rows.withColumn("code_changed", known & code).withColumn(
        "length_changed", known & F.coalesce(length, F.lit(False))
    ).withColumn("differs", F.col("code_changed") | F.col("length_changed"))


def _usable(frame: Column, status: Column) -> Column:
    return frame.isNotNull() & ~F.coalesce(status, F.lit("")).isin(UNUSABLE)


def normalize_probe(value: Column) -> Column:
    """Lower case and single blanks, of the whole value."""
    return F.trim(F.regexp_replace(F.lower(value), "\\s+", " "))


def injection_events(params: DataFrame, preview_bytes: int = 256) -> DataFrame:
    """One event per suspicious parameter with its baseline, confidence and semantic key."""
    compared = response_diff(nearest_baseline(sql_signals(params)))
    base = F.col("baseline")
    complete = base.isNotNull() & _usable(F.col("response_frame"), F.col("body_status")) & _usable(
        base["response_frame"], base["body_status"]
    )
    raised = F.least(F.lit(0.99), F.col("confidence") + F.when(F.col("differs"), 0.08).otherwise(0.0))
    complete = F.coalesce(complete, F.lit(False))
    return compared.select(
        "capture_id",
        stable_id("behavior-event", F.lit(DETECTOR), F.col("tx_id"), F.col("source"), F.col("ordinal")).alias("event_id"),
        "tx_id", "source", "ordinal", "target", "request_frame", "response_frame",
        F.lit(DETECTOR).alias("detector"),
        F.lit("sql-injection-probe").alias("event_kind"),
        F.when(complete, "complete").otherwise("partial").alias("status"),
        F.when(complete, raised).otherwise(F.least(raised, F.lit(0.70))).alias("confidence"),
        "signals", "code_changed", "length_changed",
        base["request_frame"].alias("baseline_frame"),
        base["row_id"].alias("baseline_row"),
        bounded_preview(F.col("value"), preview_bytes).alias("preview"),
        F.sha2(F.encode("value", "UTF-8"), 256).alias("value_hash"),
        stable_id("sql-probe-semantic", F.col("target"), normalize_probe(F.col("value")), F.array_join("signals", ",")).alias("semantic_key"),
    )


def mark_duplicates(events: DataFrame, frame: str = "request_frame", event: str = "event_id") -> DataFrame:
    """Earliest earlier event with the same meaning, and how often the meaning occurs.

    Events in the same frame do not repeat each other.
    """
    first = scan(
        events, ["capture_id", "detector", "semantic_key"], frame,
        {
            "__first": group_first(F.struct(F.col(frame).alias("frame"), F.col(event).alias("id"))),
            "repeat_count": group_sum(F.lit(1).cast("long")),
        },
        ties=[event],
    )
    return first.withColumn("duplicate_of", F.when(F.col("__first.frame") < F.col(frame), F.col("__first.id"))).drop("__first")


def finding_evidence(events: DataFrame) -> DataFrame:
    """Distinct evidence of each target: the probing parameter, its response, the clean baseline."""
    roles = F.array_compact(
        F.array(
            F.struct(F.lit("injected-parameter").alias("role"), F.concat_ws(":", F.col("tx_id").cast("string"), "source", F.col("ordinal").cast("string")).alias("evidence")),
            F.when(F.col("response_frame").isNotNull(), F.struct(F.lit("response").alias("role"), F.col("response_frame").cast("string").alias("evidence"))),
            F.when(F.col("baseline_row").isNotNull(), F.struct(F.lit("clean-baseline").alias("role"), F.concat_ws("@", "baseline_row", F.col("baseline_frame").cast("string")).alias("evidence"))),
        )
    )
    return events.select("capture_id", "target", F.explode(roles).alias("r")).select("capture_id", "target", "r.role", "r.evidence").distinct()


def rollup_findings(events: DataFrame, detector: str = DETECTOR) -> DataFrame:
    """One finding per target.  Evidence is counted here and listed by ``finding_evidence``."""
    totals = events.groupBy("capture_id", "target").agg(
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("events"),
        F.min("request_frame").alias("first_frame"),
        F.max("request_frame").alias("last_frame"),
    )
    return totals.select(
        "*", F.lit(detector).alias("detector"),
        stable_id("finding", F.lit(detector), F.col("target")).alias("finding_id"),
        F.when(F.col("confidence") >= 0.8, "high").otherwise("medium").alias("severity"),
    )
