"""Queries over the review queue, pages, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog import corpus as corpus_queries
from packetloom.catalog import frames as frame_queries
from packetloom.catalog import http as http_queries
from packetloom.catalog import streams as stream_queries
from packetloom.catalog.registry import query
from packetloom.operators import injection, pairing, profile, sidechannel
from packetloom.plans import pages, queue, report
from packetloom.catalog.channels import decoded
from packetloom.views import table, view

# Signals from coverage, unsupported labels, findings and lone transactions.
TX_ONLY = http_queries.TX_SQL
SIGNAL_SQL = (
    frame_queries.COVERAGE_SQL
    + http_queries.FINDINGS_SQL
    + TX_ONLY
    + """, seen AS (SELECT label, count(*) AS n FROM (SELECT unnest(string_split(protocols, ':')) AS label FROM frames) GROUP BY 1),
  lacking AS (SELECT s.label, s.n, row_number() OVER (ORDER BY s.n DESC, s.label) AS rk FROM seen s JOIN coverage c ON c.subject_kind = 'protocol' AND c.subject_id = s.label WHERE c.status = 'unavailable' AND s.label NOT IN ('dns', 'ssdp')),
  signals AS (
   SELECT subject_kind, subject_id, 'protocol-review' AS task_kind, concat('analysis-', status) AS rule, CASE status WHEN 'failed' THEN 90 ELSE 85 END AS priority FROM coverage WHERE status IN ('failed', 'partial', 'budget-limited')
   UNION ALL SELECT 'protocol', label, 'protocol-review', 'unsupported-protocol', least(60, CASE WHEN n > 10 THEN 40 ELSE 30 END) FROM lacking WHERE rk <= 25
   UNION ALL SELECT 'finding', finding_id, 'finding-review', 'http-sql-injection-behavior', 85 FROM findings
   UNION ALL SELECT 'transaction', CAST(COALESCE(request_frame, response_frame) AS VARCHAR), 'protocol-review', status, CASE status WHEN 'orphan-response' THEN 75 ELSE 70 END FROM tx WHERE status <> 'matched') """
)


def signals(spark, sf):
    results = {
        "coverage": frame_queries.coverage(spark, sf),
        "findings": injection.rollup_findings(http_queries.events(spark, sf)),
        "transactions": pairing.transactions(http_queries.pairs(spark, sf)),
    }
    return queue.queue_signals(results, profile.protocol_observations(frame_queries.frames(spark, sf)))


@query("queue_signals", SIGNAL_SQL + "SELECT * FROM signals", "frames http_tx messages")
def _(spark, sf):
    return signals(spark, sf).select("subject_kind", "subject_id", "task_kind", "rule", "priority")


@query(
    "unsupported_skips",
    SIGNAL_SQL + "SELECT label, CAST(n AS BIGINT) AS frame_count, 'unsupported-label-limit' AS reason FROM lacking WHERE rk > 1",
    "frames http_tx messages",
)
def _(spark, sf):
    seen = profile.protocol_observations(frame_queries.frames(spark, sf))
    return queue.unsupported_skips(frame_queries.coverage(spark, sf), seen, 1).drop("capture_id")


# Signals of the remaining sources: candidates, artifacts, streams, trailing data, encoded names, transfers, mail parts.
@query(
    "queue_signal_sources",
    stream_queries.BYTES_SQL
    + """, a AS (SELECT artifact_id, detected_type FROM artifacts), dn AS (SELECT count(*) AS n FROM (SELECT DISTINCT source, destination, split_part(query_name, '.', 2) FROM dns_queries WHERE query_name NOT LIKE 'www.%')),
    all_signals AS (
      SELECT 'artifact' AS subject_kind, 'artifact-review' AS task_kind, 'unreviewed-archive-or-executable' AS rule, 80 AS priority FROM a WHERE detected_type = 'application/zip'
      UNION ALL SELECT 'conversation', 'protocol-review', 'tcp-conflict-gap-or-partial', 85 FROM statuses WHERE status IN ('partial', 'conflicting', 'truncated') OR conflict_bytes > 0 OR gap_bytes > 0
      UNION ALL SELECT 'evidence', 'artifact-review', 'tftp-file-transfer', 70 FROM sessions WHERE request_frame % 2 = 0
      UNION ALL SELECT 'evidence', 'protocol-review', 'tftp-incomplete-transfer', 85 FROM sessions WHERE request_frame % 2 <> 0
      UNION ALL SELECT 'smtp-attachment', 'artifact-review', 'smtp-mime-attachment', 70 FROM parts WHERE part_id % 3 <> 0
      UNION ALL SELECT 'smtp-attachment', 'protocol-review', 'smtp-incomplete-attachment', 85 FROM parts WHERE part_id % 3 = 0)
    SELECT subject_kind, task_kind, rule, priority, CAST(count(*) AS BIGINT) AS signals FROM all_signals GROUP BY ALL""",
    "segments artifacts dns_queries sessions parts",
)
def _(spark, sf):
    artifacts = view(spark, sf, "artifacts").withColumn("review_state", F.lit("unreviewed")).withColumn("suggested_name", F.lit("a.bin"))
    transfers = view(spark, sf, "sessions").select(
        "capture_id", F.col("request_frame").alias("transfer_id"), F.when(F.col("request_frame") % 2 == 0, "complete").otherwise("partial").alias("status")
    )
    attachments = view(spark, sf, "parts").select(
        "capture_id", F.col("part_id").alias("attachment_id"), F.when(F.col("part_id") % 3 == 0, "partial").otherwise("complete").alias("status")
    )
    rows = queue.queue_signals(
        {"artifacts": artifacts, "streams": stream_queries.statuses(spark, sf), "block_transfers": transfers, "attachments": attachments}
    )
    return rows.groupBy("subject_kind", "task_kind", "rule", "priority").agg(F.count(F.lit(1)).alias("signals"))


@query(
    "dns_signals",
    """, g AS (SELECT source, destination, lower(substr(query_name, 34)) AS base_domain, count(*) AS q, count(DISTINCT query_name) AS u FROM dns_queries WHERE query_name NOT LIKE 'www.%' GROUP BY 1, 2, 3),
    r AS (SELECT source, destination, count(*) AS n FROM dns_queries GROUP BY 1, 2),
    s AS (SELECT g.*, least(100, 35 + CASE WHEN q >= 5 THEN 15 ELSE 0 END + CASE WHEN q >= 20 THEN 10 ELSE 0 END + CASE WHEN q * 16 >= 512 THEN 10 ELSE 0 END + CASE WHEN q * 16 >= 4096 THEN 10 ELSE 0 END
      + CASE WHEN q / n >= 0.5 THEN 10 ELSE 0 END + CASE WHEN u >= 5 THEN 5 ELSE 0 END) AS score FROM g JOIN r USING (source, destination))
    SELECT concat_ws('|', source, destination, base_domain, 'hex') AS subject_id, score AS priority FROM s WHERE score >= 60 AND q >= 5 AND q * 16 >= 128""",
    "dns_queries",
)
def _(spark, sf):
    scored = sidechannel.dns_score(sidechannel.dns_groups(decoded(spark, sf)), view(spark, sf, "dns_queries"))
    return queue.dns_signals(scored).select("subject_id", "priority")


@query(
    "candidate_signals",
    corpus_queries.MERGED_SQL
    + """SELECT m.candidate_id AS subject_id, CASE WHEN m.score >= 100 THEN 'rank-100-known-format' WHEN m.kind = 'sensitive-field' THEN 'sensitive-field' ELSE 'unknown-flag-like' END AS rule,
      CASE WHEN m.score >= 100 THEN 100 WHEN m.kind = 'sensitive-field' THEN 80 ELSE 70 END AS priority FROM merged m
    WHERE m.score >= 100 OR m.kind = 'sensitive-field' OR (m.kind = 'unknown-flag' AND m.score >= 70)""",
    "evidence_text",
)
def _(spark, sf):
    rows, links = corpus_queries.merged(spark, sf)
    linked = rows.join(links, "candidate_id").withColumn("capture_id", F.lit(1))
    return queue.candidate_signals(linked).select("subject_id", "rule", "priority").distinct()


# Labels are the states people set on documents; documents with a secret or of low length raise signals.
QUEUE_SQL = """WITH previous AS (SELECT CAST(doc_id AS VARCHAR) AS subject_id, CASE WHEN quality = 1 THEN 'resolved' WHEN toxic = 1 THEN 'dismissed' ELSE 'open' END AS state FROM labels),
 signals AS (SELECT CAST(doc_id AS VARCHAR) AS subject_id, 'sensitive-field' AS rule, 80 AS priority FROM documents WHERE contains(text, 'token') OR contains(text, '@')
   UNION ALL SELECT CAST(doc_id AS VARCHAR), 'short-text', 70 FROM documents WHERE n_chars < 400),
 current_ AS (SELECT subject_id, max(priority) AS priority, CAST(count(DISTINCT rule) AS BIGINT) AS signal_count FROM signals GROUP BY 1),
 queue AS (SELECT COALESCE(p.subject_id, c.subject_id) AS subject_id, COALESCE(c.priority, 0) AS priority, COALESCE(p.state, 'open') AS state, COALESCE(c.signal_count, 0) AS signal_count,
   sha256(concat_ws(chr(31), 'manual-task', '1', 'evidence', COALESCE(p.subject_id, c.subject_id), 'candidate-review')) AS task_id FROM previous p FULL JOIN current_ c USING (subject_id)) """


def document_queue(spark, sf):
    fixed = [F.lit(1).alias("capture_id"), F.lit("evidence").alias("subject_kind"), F.col("doc_id").cast("string").alias("subject_id"), F.lit("candidate-review").alias("task_kind")]
    state = F.when(F.col("quality") == 1, "resolved").when(F.col("toxic") == 1, "dismissed").otherwise("open")
    previous = table(spark, sf, "labels").select(*fixed, state.alias("state"))
    found = F.array_compact(
        F.array(
            F.when(F.contains("text", F.lit("token")) | F.contains("text", F.lit("@")), F.struct(F.lit("sensitive-field").alias("rule"), F.lit(80).alias("priority"))),
            F.when(F.col("n_chars") < 400, F.struct(F.lit("short-text").alias("rule"), F.lit(70).alias("priority"))),
        )
    )
    current = table(spark, sf, "documents").select(*fixed, F.explode(found).alias("s")).select(
        *queue.TASK, "s.rule", "s.priority", F.lit(None).cast("string").alias("detail"), F.col("subject_id").alias("evidence_id"), F.lit("document").alias("evidence_role")
    )
    return queue.merge_queue(previous, current), current


@query("merge_queue", QUEUE_SQL + "SELECT subject_id, task_id, priority, state, signal_count FROM queue")
def _(spark, sf):
    return document_queue(spark, sf)[0].select("subject_id", "task_id", "priority", "state", "signal_count")


@query("visible_queue", QUEUE_SQL + "SELECT subject_id, state FROM queue WHERE NOT (state = 'open' AND priority = 0)")
def _(spark, sf):
    return queue.visible(document_queue(spark, sf)[0]).select("subject_id", "state")


@query(
    "queue_page",
    QUEUE_SQL
    + """, top AS (SELECT * FROM queue WHERE NOT (state = 'open' AND priority = 0) AND priority >= 70 AND state = 'open' ORDER BY priority DESC, task_id LIMIT 40 OFFSET 10)
    SELECT t.task_id, t.priority, t.state, string_agg(s.rule, ',' ORDER BY s.priority DESC, s.rule) AS signals, CAST(count(*) AS BIGINT) AS signals_total, FALSE AS signals_truncated
    FROM top t JOIN signals s USING (subject_id) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    tasks, current = document_queue(spark, sf)
    chosen = pages.queue_page(tasks, state="open", min_priority=70, offset=10, limit=40).select("task_id", "priority", "state")
    children = current.select(queue.task_id().alias("task_id"), "rule", F.col("priority").alias("points"))
    shown = pages.nested(chosen, children, "task_id", [F.desc("points"), "rule"], "signals", 1000)
    return shown.withColumn("signals", F.array_join(F.transform("signals", lambda s: s["rule"]), ","))


@query(
    "merge_marks",
    """WITH old AS (SELECT CAST(doc_id AS VARCHAR) AS subject_id, 'unreviewed' AS state, 0 AS updated_at FROM labels),
    upd AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, CASE event_type WHEN 'view' THEN 'needs_review' WHEN 'error' THEN 'excluded' WHEN 'purchase' THEN 'key_evidence' WHEN 'click' THEN 'unreviewed' ELSE 'bogus' END AS state, event_id + 1 AS updated_at FROM events),
    ok AS (SELECT * FROM upd WHERE state <> 'bogus' AND subject_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
    both_ AS (SELECT * FROM old UNION ALL SELECT * FROM ok)
    SELECT 'evidence' AS subject_kind, subject_id, arg_max(state, updated_at) AS state, CAST(max(updated_at) AS BIGINT) AS updated_at FROM both_ GROUP BY 2""",
)
def _(spark, sf):
    kind = F.lit("evidence").alias("subject_kind")
    old = table(spark, sf, "labels").select(kind, F.col("doc_id").cast("string").alias("subject_id"), F.lit("unreviewed").alias("state"), F.lit(0).cast("long").alias("updated_at"))
    event = F.col("event_type")
    state = F.when(event == "view", "needs_review").when(event == "error", "excluded").when(event == "purchase", "key_evidence").when(event == "click", "unreviewed").otherwise("bogus")
    updates = table(spark, sf, "events").select(kind, F.col("user_id").cast("string").alias("subject_id"), state.alias("state"), (F.col("event_id") + 1).alias("updated_at"))
    subjects = table(spark, sf, "documents").select(kind, F.col("doc_id").cast("string").alias("subject_id"))
    return queue.merge_marks(old, updates, subjects)


@query(
    "notes_page",
    """SELECT CAST(conv_id AS VARCHAR) AS subject_id, conv_id * 1000 + turn AS note_id, CAST(strlen(text) AS INT) AS body_bytes, strlen(text) > 64 AS body_truncated,
      CASE WHEN strlen(text) <= 64 THEN text ELSE (SELECT max(left(text, CAST(n AS INT))) FROM range(16, 65) r(n) WHERE strlen(left(text, CAST(n AS INT))) <= 64) END AS body
    FROM conversations WHERE role = 'user' ORDER BY turn, conv_id * 1000 + turn LIMIT 60 OFFSET 20""",
)
def _(spark, sf):
    notes = table(spark, sf, "conversations").select(
        F.col("role").alias("subject_kind"), F.col("conv_id").cast("string").alias("subject_id"), F.expr("conv_id * 1000 + turn").alias("note_id"), F.col("turn").alias("created_at"), F.col("text").alias("body")
    )
    rows = pages.notes_page(notes, subject_kind="user", offset=20, limit=60, max_body_bytes=64)
    return rows.select("subject_id", "note_id", "body", "body_bytes", "body_truncated")


@query(
    "summary_page",
    frame_queries.COVERAGE_SQL
    + """, seen AS (SELECT label, count(*) AS n FROM (SELECT unnest(string_split(protocols, ':')) AS label FROM frames) GROUP BY 1)
    SELECT * FROM (SELECT 'protocol' AS section, label AS item, CAST(n AS BIGINT) AS amount FROM seen ORDER BY n DESC, label LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'conversation', concat(transport, ':', stream_index), frame_count FROM profiles ORDER BY frame_count DESC, transport, stream_index LIMIT 5)
    UNION ALL SELECT 'coverage', status, CAST(count(*) AS BIGINT) FROM coverage GROUP BY status
    UNION ALL SELECT 'total', 'protocol', CAST(count(*) AS BIGINT) FROM seen UNION ALL SELECT 'total', 'conversation', CAST(count(*) AS BIGINT) FROM profiles""",
    "frames",
)
def _(spark, sf):
    rows = frame_queries.frames(spark, sf)
    return pages.summary_page(profile.protocol_observations(rows), profile.conversation_profiles(rows), frame_queries.coverage(spark, sf), 5)


@query(
    "assessment",
    http_queries.FINDINGS_SQL
    + """SELECT 'artifact' AS section, CASE WHEN detected_type LIKE 'image/%' THEN 'image' WHEN regexp_matches(detected_type, 'zip|rar|gzip|compressed') THEN 'archive' ELSE 'other' END AS kind,
      'media-type' AS source, CAST(count(*) AS BIGINT) AS amount FROM artifacts GROUP BY 2
    UNION ALL SELECT 'behaviour', 'sql-injection', 'http-sql-injection-behavior', CAST(count(*) AS BIGINT) FROM findings
    UNION ALL SELECT 'behaviour', 'tftp-file-transfer', 'tftp-data', CAST(count(*) AS BIGINT) FROM sessions""",
    "http_tx artifacts sessions",
)
def _(spark, sf):
    evidence = view(spark, sf, "sessions").select(F.lit("tftp-data").alias("source_kind"))
    return report.assessment(
        view(spark, sf, "artifacts"), injection.rollup_findings(http_queries.events(spark, sf)),
        profile.protocol_observations(frame_queries.frames(spark, sf)), evidence,
    )


@query(
    "report",
    http_queries.FINDINGS_SQL
    + """, seen AS (SELECT label, count(*) AS n FROM (SELECT unnest(string_split(protocols, ':')) AS label FROM frames) GROUP BY 1),
    top AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM seen), f AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, finding_id) AS rn FROM findings)
    SELECT 'protocols' AS collection, 0 AS ordinal, concat('{"count":', least(4, (SELECT count(*) FROM seen)), ',"limit":4,"total":', (SELECT count(*) FROM seen), ',"truncated":', (SELECT count(*) FROM seen) > 4, '}') AS item
    UNION ALL SELECT 'protocols', CAST(rn AS INT), concat('{"frame_count":', n, ',"label":"', label, '"}') FROM top WHERE rn <= 4
    UNION ALL SELECT 'findings', 0, concat('{"count":', least(3, (SELECT count(*) FROM findings)), ',"limit":3,"total":', (SELECT count(*) FROM findings), ',"truncated":', (SELECT count(*) FROM findings) > 3, '}')
    UNION ALL SELECT 'findings', CAST(rn AS INT), concat('{"finding_id":"', finding_id, '","severity":"', severity, '"}') FROM f WHERE rn <= 3""",
    "frames http_tx",
)
def _(spark, sf):
    labels = profile.protocol_observations(frame_queries.frames(spark, sf)).select("label", "frame_count")
    findings = injection.rollup_findings(http_queries.events(spark, sf)).withColumn("confidence", F.round("confidence", 4))
    ordered = findings.select("finding_id", "severity", "confidence")
    top = ordered.orderBy(F.desc("confidence"), "finding_id")
    return report.build_report(
        {"protocols": (labels, [F.desc("frame_count"), "label"], 4), "findings": (top, [F.desc("confidence"), "finding_id"], 3)}
    ).withColumn("item", F.regexp_replace("item", '"confidence":[0-9.]+,', ""))


@query(
    "report_overview",
    """SELECT 'documents' AS collection, CAST(count(*) AS BIGINT) AS total FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages""",
)
def _(spark, sf):
    return report.overview({name: table(spark, sf, name) for name in ("events", "documents", "pages")})


EXPORT_SQL = """WITH c AS (SELECT doc_id, text, doc_id % 19 <> 0 AS complete, CAST(doc_id % 50 AS BIGINT) AS o, CAST(doc_id % 700 AS BIGINT) AS l FROM documents),
 judged AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'no-stored-bytes' WHEN NOT complete THEN 'blob-incomplete' WHEN o + l > strlen(text) THEN 'range-out-of-bounds' WHEN l > 600 THEN 'item-byte-limit' END AS r FROM c),
 run AS (SELECT *, sum(CASE WHEN r IS NULL THEN l ELSE 0 END) OVER (ORDER BY doc_id) AS used FROM judged),
 done AS (SELECT *, CASE WHEN r IS NULL AND used > 50000 THEN 'total-byte-limit' ELSE r END AS reason FROM run) """


def exported(spark, sf, mode):
    documents = table(spark, sf, "documents")
    doc = F.col("doc_id")
    ranges = documents.select(
        F.col("doc_id").alias("evidence_id"), F.when(doc % 23 == 0, "none").otherwise(doc.cast("string")).alias("content_hash"),
        (doc % 50).alias("offset"), (doc % 700).alias("length"),
    )
    stored = documents.select(doc.cast("string").alias("content_hash"), F.col("text").alias("content"), (doc % 19 != 0).alias("complete"))
    return report.export_ranges(ranges, stored, 600, 50_000, "evidence_id", mode)


@query("export_skips", EXPORT_SQL + "SELECT doc_id AS evidence_id, reason FROM done WHERE reason IS NOT NULL")
def _(spark, sf):
    return exported(spark, sf, "prefix")[1]


@query(
    "export_manifest",
    EXPORT_SQL + "SELECT doc_id AS evidence_id, l AS byte_length, lower(hex(encode(text)[CAST(o + 1 AS INT):CAST(o + l AS INT)])) AS data_hex FROM done WHERE reason IS NULL",
)
def _(spark, sf):
    return exported(spark, sf, "prefix")[0].select("evidence_id", "byte_length", F.lower(F.hex("data")).alias("data_hex"))


@query(
    "pending",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
)
def _(spark, sf):
    runs = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 0, "p1").otherwise("p2").alias("policy"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status")
    )
    return report.pending(table(spark, sf, "documents").select("doc_id"), runs, "p1", "doc_id")
