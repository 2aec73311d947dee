"""Queries over frames: sources, profiles, coverage and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.operators import budget, content, profile
from packetloom.operators.ordered import last_value, next_value, row_number, running_max, running_sum, scan
from packetloom.session import scratch_path
from packetloom.sources.fields import read_fields, split_malformed, write_fields
from packetloom.views import table, view

def frames(spark, sf):
    return profile.normalize_frames(view(spark, sf, "frames"))


@query(
    "fields_round_trip",
    "SELECT frame_number, stream_index, transport, protocols, source, destination, captured_length, payload_length FROM frames",
    "frames",
)
def _(spark, sf):
    chosen = view(spark, sf, "frames").select(
        "frame_number", "stream_index", "transport", "protocols", "source", "destination", "captured_length", "payload_length"
    )
    path = scratch_path(spark, "fields")
    write_fields(chosen, path)
    good, _ = split_malformed(read_fields(spark, path, chosen.schema), ["frame_number", "protocols"])
    return good


@query(
    "malformed_rows",
    """SELECT reason, CAST(count(*) AS BIGINT) AS rows_seen FROM (
      SELECT CASE WHEN event_type = 'error' THEN 'missing-source_port' WHEN event_type = 'click' THEN 'missing-query_name'
        ELSE 'usable' END AS reason FROM events) GROUP BY 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("source_port"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("query_name"),
    )
    good, bad = split_malformed(events, ["source_port", "query_name"])
    both = good.select(F.lit("usable").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("rows_seen"))


@query(
    "normalized_frames",
    """SELECT frame_number, concat(source, ':', source_port) AS endpoint_a, concat(destination, ':', destination_port) AS endpoint_b,
      concat(source, ':', source_port, '>', destination, ':', destination_port) AS direction,
      CAST(len(string_split(protocols, ':')) AS INT) AS label_count FROM frames""",
    "frames",
)
def _(spark, sf):
    return frames(spark, sf).select("frame_number", "endpoint_a", "endpoint_b", "direction", F.size("labels").alias("label_count"))


@query(
    "protocol_observations",
    """SELECT label, CAST(count(*) AS BIGINT) AS frame_count, min(frame_number) AS first_frame, max(frame_number) AS last_frame
    FROM (SELECT frame_number, unnest(string_split(protocols, ':')) AS label FROM frames) GROUP BY label""",
    "frames",
)
def _(spark, sf):
    return profile.protocol_observations(frames(spark, sf)).drop("capture_id")


PROFILE_SQL = """, base AS (SELECT *, concat(source, ':', source_port) AS a, concat(destination, ':', destination_port) AS b FROM frames),
 labels AS (SELECT transport, stream_index, string_agg(label, ',' ORDER BY label) AS labels FROM (
    SELECT DISTINCT transport, stream_index, unnest(string_split(protocols, ':')) AS label FROM frames) GROUP BY 1, 2),
 profiles AS (SELECT transport, stream_index, arg_min(a, frame_number) AS endpoint_a, arg_min(b, frame_number) AS endpoint_b,
    min(frame_number) AS first_frame, max(frame_number) AS last_frame, CAST(count(*) AS BIGINT) AS frame_count,
    CAST(sum(captured_length) AS BIGINT) AS captured_bytes, CAST(sum(frame_length) AS BIGINT) AS wire_bytes,
    CAST(sum(payload_length) AS BIGINT) AS payload_bytes,
    arg_min(a, frame_number) FILTER (transport = 'tcp' AND syn AND NOT ack) AS initiator,
    arg_min(b, frame_number) FILTER (transport = 'tcp' AND syn AND NOT ack) AS responder FROM base GROUP BY 1, 2) """


@query("conversation_profiles", PROFILE_SQL + "SELECT p.*, l.labels FROM profiles p JOIN labels l USING (transport, stream_index)", "frames")
def _(spark, sf):
    rows = profile.conversation_profiles(frames(spark, sf))
    return rows.drop("capture_id", "first_time", "last_time").withColumn("labels", F.array_join("labels", ","))


@query(
    "stream_roles",
    PROFILE_SQL
    + """SELECT transport, stream_index, initiator, responder, initiator IS NULL AS midstream FROM profiles""",
    "frames",
)
def _(spark, sf):
    return profile.stream_roles(frames(spark, sf)).drop("capture_id", "syn_frame")


# Streams whose labels are all plain: here the streams that saw one event type only.
@query(
    "generic_streams",
    """, split AS (SELECT *, stream_index * 10 + frame_number % 10 AS sub FROM frames WHERE transport = 'tcp')
    SELECT sub AS stream_index, CAST(sum(payload_length) AS BIGINT) AS payload_bytes FROM split GROUP BY sub
    HAVING sum(payload_length) > 0 AND bool_and(protocols = 'eth:ip:tcp:data')""",
    "frames",
)
def _(spark, sf):
    split = frames(spark, sf).where("transport = 'tcp'").withColumn("stream_index", F.expr("stream_index * 10 + frame_number % 10"))
    return profile.select_generic(profile.conversation_profiles(split)).select("stream_index", "payload_bytes")


CAPABLE = ["data", "view", "click"]
ANALYZERS = [("click", "complete"), ("purchase", "partial")]
COVERAGE_SQL = (
    PROFILE_SQL
    + """, obs AS (SELECT DISTINCT unnest(string_split(protocols, ':')) AS label FROM frames),
  states AS (SELECT stream_index, CASE WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'complete' END AS status
    FROM (SELECT user_id AS stream_index, event_type FROM events) GROUP BY 1),
  coverage AS (
  SELECT 'protocol' AS subject_kind, label AS subject_id,
    CASE WHEN label NOT IN ('frame', 'eth', 'ethertype', 'ip', 'ipv6', 'tcp', 'udp', 'data', 'view', 'click', 'purchase') THEN 'unavailable'
      WHEN label = 'purchase' THEN 'partial' WHEN label = 'click' THEN 'complete' ELSE 'not-run' END AS status FROM obs
  UNION ALL
  SELECT 'conversation', concat(transport, ':', stream_index), CASE WHEN transport = 'tcp' THEN status ELSE 'not-run' END
    FROM profiles JOIN states USING (stream_index)) """
)


def coverage(spark, sf):
    rows = frames(spark, sf)
    analyzers = spark.createDataFrame([(1, *a) for a in ANALYZERS], "capture_id int, label string, status string")
    states = table(spark, sf, "events").select(
        F.lit(1).alias("capture_id"), F.col("user_id").alias("stream_index"),
        F.when(F.col("event_type") == "error", "partial").otherwise("complete").alias("state"),
    )
    return profile.coverage(
        profile.protocol_observations(rows), profile.conversation_profiles(rows), analyzers,
        profile.fold_states(states, ["capture_id", "stream_index"]), [*CAPABLE, "purchase"],
    )


@query("coverage", COVERAGE_SQL + "SELECT subject_kind, subject_id, status FROM coverage", "frames")
def _(spark, sf):
    return coverage(spark, sf).drop("capture_id")


@query("coverage_counts", COVERAGE_SQL + "SELECT status, CAST(count(*) AS BIGINT) AS subjects FROM coverage GROUP BY status", "frames")
def _(spark, sf):
    return profile.coverage_counts(coverage(spark, sf)).drop("capture_id")


@query(
    "run_summary",
    """SELECT user_id AS project, CASE max(CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END)
      WHEN 1 THEN 'completed' WHEN 2 THEN 'budget-limited' WHEN 3 THEN 'partial' ELSE 'failed' END AS status,
      CAST(sum(CAST(floor(value) AS INT)) AS BIGINT) AS processed, CAST(sum(event_id % 5) AS BIGINT) AS skipped,
      CAST(sum(event_id % 3) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS runs FROM events GROUP BY user_id""",
)
def _(spark, sf):
    kind = F.col("event_type")
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("project"),
        F.when(kind == "error", "failed").when(kind == "view", "completed").when(kind == "click", "budget-limited").otherwise("partial").alias("status"),
        F.expr("CAST(floor(value) AS INT)").alias("processed"), F.expr("event_id % 5").alias("skipped"), F.expr("event_id % 3").alias("events"),
    )
    return profile.run_summary(runs, ["project"])


@query(
    "content_table",
    """SELECT sha256(text) AS content_hash, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_owner,
      CAST(strlen(any_value(text)) AS BIGINT) AS byte_length FROM documents WHERE text IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return content.content_table(table(spark, sf, "documents"), "text", "doc_id").drop("content")


@query(
    "explode_parts",
    """, headers AS (SELECT message_id,
        string_agg(concat('form-data; name="f', part_id, '"', CASE WHEN part_id % 3 = 0 THEN concat('; filename=p', part_id, '.bin') ELSE '' END), '|' ORDER BY part_id) AS dispositions,
        string_agg(declared_type, '|' ORDER BY part_id) FILTER (part_id % 5 <> 0) AS media_types FROM parts GROUP BY message_id),
      d AS (SELECT message_id, CAST(unnest(generate_series(0, len(string_split(dispositions, '|')) - 1)) AS INT) AS ordinal, unnest(string_split(dispositions, '|')) AS disposition FROM headers),
      m AS (SELECT message_id, CAST(unnest(generate_series(0, len(string_split(media_types, '|')) - 1)) AS INT) AS ordinal, unnest(string_split(media_types, '|')) AS declared_type FROM headers WHERE media_types IS NOT NULL)
    SELECT d.message_id, d.ordinal, d.disposition, regexp_extract(d.disposition, 'name="([^"]*)"', 1) AS field_name,
      nullif(regexp_extract(d.disposition, 'filename=(\\S+)', 1), '') AS filename, m.declared_type
    FROM d LEFT JOIN m USING (message_id, ordinal)""",
    "parts",
)
def _(spark, sf):
    parts = view(spark, sf, "parts")
    name = F.expr("concat('form-data; name=\"f', part_id, '\"', CASE WHEN part_id % 3 = 0 THEN concat('; filename=p', part_id, '.bin') ELSE '' END)")
    rows = parts.select(
        "message_id", F.struct("part_id", name.alias("v")).alias("h"), F.when(F.expr("part_id % 5 <> 0"), F.struct("part_id", F.col("declared_type").alias("v"))).alias("t")
    )
    # A message of this view holds at most two parts.
    headers = rows.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["v"]), "|").alias("dispositions"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["v"]), "|"), F.lit("")).alias("media_types"),
    )
    return content.explode_parts(headers)


@query(
    "limit_rows",
    """SELECT user_id, CAST(count(*) FILTER (rn <= 20) AS BIGINT) AS kept, CAST(count(*) FILTER (rn > 20) AS BIGINT) AS skipped,
      max(event_id) FILTER (rn <= 20) AS last_kept FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    kept, skips = budget.limit_rows(table(spark, sf, "events"), ["user_id"], "event_id", 20)
    both = kept.select("user_id", "event_id", F.lit(True).alias("k")).unionByName(skips.select("user_id", "event_id", F.lit(False).alias("k")))
    return both.groupBy("user_id").agg(
        F.count(F.when(F.col("k"), 1)).alias("kept"), F.count(F.when(~F.col("k"), 1)).alias("skipped"),
        F.max(F.when(F.col("k"), F.col("event_id"))).alias("last_kept"),
    )


@query(
    "limit_groups",
    """, firsts AS (SELECT capture_id, stream_index, min(frame_number) AS f FROM frames GROUP BY 1, 2),
     ranked AS (SELECT stream_index, row_number() OVER (ORDER BY f, stream_index) AS rn FROM firsts)
    SELECT transport, CAST(count(*) FILTER (rn <= 40) AS BIGINT) AS kept, CAST(count(*) FILTER (rn > 40) AS BIGINT) AS skipped
    FROM frames JOIN ranked USING (stream_index) GROUP BY transport""",
    "frames",
)
def _(spark, sf):
    kept, skips = budget.limit_groups(view(spark, sf, "frames"), ["capture_id"], ["stream_index"], "frame_number", 40)
    both = kept.select("transport", F.lit(1).alias("k")).unionByName(skips.select("transport", F.lit(0).alias("k")))
    return both.groupBy("transport").agg(
        F.count(F.when(F.col("k") == 1, 1)).alias("kept"), F.count(F.when(F.col("k") == 0, 1)).alias("skipped")
    )


@query(
    "byte_budget_prefix",
    """SELECT event_id, CASE WHEN sum(CAST(floor(value) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) <= 1000 THEN 'kept' ELSE 'byte-budget' END AS outcome FROM events""",
)
def _(spark, sf):
    sized = table(spark, sf, "events").withColumn("size", F.expr("CAST(floor(value) AS INT)"))
    kept, skips = budget.byte_budget(sized, ["user_id"], "event_id", "size", 1000)
    return kept.select("event_id", F.lit("kept").alias("outcome")).unionByName(skips.select("event_id", F.col("reason").alias("outcome")))


@query(
    "byte_budget_greedy",
    """, sized AS (SELECT user_id, CAST(floor(value) AS INT) AS size, event_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
     walk(user_id, rn, used, event_id, kept) AS (
       SELECT user_id, rn, CASE WHEN size <= 1000 THEN size ELSE 0 END, event_id, size <= 1000 FROM sized WHERE rn = 1
       UNION ALL
       SELECT s.user_id, s.rn, CASE WHEN w.used + s.size <= 1000 THEN w.used + s.size ELSE w.used END, s.event_id, w.used + s.size <= 1000
       FROM walk w JOIN sized s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
    SELECT event_id, CASE WHEN kept THEN 'kept' ELSE 'byte-budget' END AS outcome FROM walk""".replace(", sized", "WITH RECURSIVE sized", 1),
)
def _(spark, sf):
    sized = table(spark, sf, "events").withColumn("size", F.expr("CAST(floor(value) AS INT)"))
    kept, skips = budget.byte_budget(sized, ["user_id"], "event_id", "size", 1000, mode="greedy")
    return kept.select("event_id", F.lit("kept").alias("outcome")).unionByName(skips.select("event_id", F.col("reason").alias("outcome")))


# Streams in ascending order of size: the running sum is the exact greedy answer.
@query(
    "byte_budget_ascending",
    PROFILE_SQL
    + """SELECT stream_index, CASE WHEN sum(payload_bytes) OVER (ORDER BY payload_bytes, stream_index) <= 100000 THEN 'kept'
    ELSE 'skipped-budget' END AS outcome FROM profiles""",
    "frames",
)
def _(spark, sf):
    profiles = profile.conversation_profiles(frames(spark, sf)).select("capture_id", "stream_index", "payload_bytes")
    kept, skips = budget.byte_budget(profiles, ["capture_id"], "payload_bytes", "payload_bytes", 100_000, reason="skipped-budget", ties=["stream_index"])
    return kept.select("stream_index", F.lit("kept").alias("outcome")).unionByName(skips.select("stream_index", F.col("reason").alias("outcome")))


@query(
    "skip_counts",
    """SELECT event_type, 'byte-budget' AS reason, CAST(count(*) AS BIGINT) AS skipped FROM (SELECT event_type,
       sum(CAST(floor(value) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM events) WHERE used > 1000 GROUP BY 1""",
)
def _(spark, sf):
    sized = table(spark, sf, "events").withColumn("size", F.expr("CAST(floor(value) AS INT)"))
    _, skips = budget.byte_budget(sized, ["user_id"], "event_id", "size", 1000)
    return budget.skip_counts(skips, ["event_type"])


@query(
    "ordered_scan",
    """SELECT event_id, row_number() OVER w AS rn, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS running,
      max(CAST(floor(value) AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high,
      last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error,
      first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_error
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def _(spark, sf):
    size = F.expr("CAST(floor(value) AS BIGINT)")
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    rows = scan(
        table(spark, sf, "events"), ["user_id"], "event_id",
        {
            "rn": row_number(), "running": running_sum(size), "high": running_max(size, inclusive=False),
            "last_error": last_value(error), "next_error": next_value(error),
        },
        span=1000,
    )
    return rows.select("event_id", "rn", "running", "high", "last_error", "next_error")
