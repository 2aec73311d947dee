"""Queries over requests and responses: pairing, parameters, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.operators import content, injection, pairing, parameters, webshell
from packetloom.plans import pages
from packetloom.views import table, view

LINKS_SQL = """, req AS (SELECT * FROM messages WHERE kind = 'request'), res AS (SELECT * FROM messages WHERE kind = 'response'),
 links AS (SELECT DISTINCT q.stream_index, q.frame_number AS request_frame, s.frame_number AS response_frame
   FROM req q JOIN res s ON s.request_in_frame = q.frame_number OR q.response_in_frame = s.frame_number),
 pairs AS (
  SELECT stream_index, request_frame, response_frame, 'matched' AS status,
    CASE WHEN rn = 0 THEN 'response' ELSE 'extra_response' END AS role, rn AS ordinal FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY request_frame ORDER BY response_frame) - 1 AS BIGINT) AS rn FROM links)
  UNION ALL SELECT stream_index, frame_number, NULL, 'unmatched-request', 'request', 0 FROM req
    WHERE frame_number NOT IN (SELECT request_frame FROM links)
  UNION ALL SELECT stream_index, NULL, frame_number, 'orphan-response', 'response', 0 FROM res
    WHERE frame_number NOT IN (SELECT response_frame FROM links)) """


def pairs(spark, sf):
    return pairing.pair_transactions(view(spark, sf, "messages"))


@query("pair_transactions", LINKS_SQL + "SELECT * FROM pairs", "messages")
def _(spark, sf):
    return pairs(spark, sf).drop("capture_id")


# Retried answers: every assistant turn names the first user turn of its conversation, so extra responses occur.
RETRY_SQL = """WITH messages AS (SELECT conv_id AS stream_index, conv_id * 1000 + turn AS frame_number,
   CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'other' END AS kind,
   CASE WHEN role = 'assistant' THEN conv_id * 1000 END AS request_in_frame, CAST(NULL AS BIGINT) AS response_in_frame FROM conversations)"""


@query("extra_responses", RETRY_SQL + LINKS_SQL + "SELECT * FROM pairs")
def _(spark, sf):
    role = F.col("role")
    messages = table(spark, sf, "conversations").select(
        F.lit(1).alias("capture_id"), F.col("conv_id").alias("stream_index"), F.expr("conv_id * 1000 + turn").alias("frame_number"),
        F.when(role == "user", "request").when(role == "assistant", "response").otherwise("other").alias("kind"),
        F.when(role == "assistant", F.col("conv_id") * 1000).alias("request_in_frame"), F.lit(None).cast("long").alias("response_in_frame"),
    )
    return pairing.pair_transactions(messages).drop("capture_id")


TX_SQL = LINKS_SQL + """, tx AS (SELECT stream_index, status, request_frame, min(response_frame) AS response_frame,
  CAST(count(*) FILTER (role = 'extra_response') AS BIGINT) AS extra_responses FROM pairs
  GROUP BY stream_index, status, request_frame, CASE WHEN request_frame IS NULL THEN response_frame END) """


@query("transactions", TX_SQL + "SELECT * FROM tx", "messages")
def _(spark, sf):
    return pairing.transactions(pairs(spark, sf)).drop("capture_id")


@query("transaction_summary", TX_SQL + "SELECT status, CAST(count(*) AS BIGINT) AS transactions FROM tx GROUP BY status", "messages")
def _(spark, sf):
    return pairing.transaction_summary(pairing.transactions(pairs(spark, sf))).drop("capture_id")


@query(
    "transaction_counts",
    TX_SQL
    + """SELECT 'messages' AS measure, kind AS name, CAST(count(*) AS BIGINT) AS amount FROM messages GROUP BY 2 UNION ALL SELECT 'transactions', status, count(*) FROM tx GROUP BY 2
    UNION ALL SELECT 'uri', '/t/3', (SELECT count(*) FROM tx JOIN messages m ON m.frame_number = tx.request_frame WHERE m.content_length % 5 = 3)""",
    "messages",
)
def _(spark, sf):
    messages = view(spark, sf, "messages")
    uris = messages.select("capture_id", "frame_number", F.concat(F.lit("/t/"), (F.col("content_length") % 5).cast("string")).alias("uri"))
    return pairing.transaction_counts(messages, pairing.transactions(pairs(spark, sf)), uris, "/t/3").drop("capture_id")


@query(
    "body_targets",
    LINKS_SQL
    + """, chosen AS (SELECT p.* FROM pairs p JOIN (SELECT frame_number FROM req WHERE content_length > 300) w ON w.frame_number = p.request_frame)
    SELECT DISTINCT request_frame AS frame_number, 'request' AS kind FROM chosen
    UNION SELECT DISTINCT response_frame, 'response' FROM chosen WHERE response_frame IS NOT NULL""",
    "messages",
)
def _(spark, sf):
    messages = view(spark, sf, "messages")
    uris = messages.where("kind = 'request'").select(
        "capture_id", F.col("frame_number").alias("request_frame"), F.when(F.col("content_length") > 300, "/long").otherwise("/short").alias("uri")
    )
    return pairing.select_body_targets(pairs(spark, sf), uris, "/long").drop("capture_id")


BODY = """CASE WHEN extracted_length = 0 AND declared_length = 0 THEN 'empty' WHEN extracted_length = 0 AND declared_length IS NULL THEN 'absent'
  WHEN extracted_length = 0 THEN 'missing' WHEN declared_length IS NULL OR extracted_length = declared_length THEN 'complete'
  WHEN extracted_length < declared_length THEN 'partial' ELSE 'length-mismatch' END"""


def http_tx(spark, sf):
    return content.classify_body(view(spark, sf, "http_tx"))


@query("classify_body", f"SELECT tx_id, {BODY} AS body_status FROM http_tx", "http_tx")
def _(spark, sf):
    return http_tx(spark, sf).select("tx_id", "body_status")


SUCCESS = "(?i)\\b(?:upload(?:ed)?[ \\t_-]+success(?:ful(?:ly)?)?|success(?:ful(?:ly)?)?)\\b"


@query(
    "contradictions",
    f""", e AS (SELECT *, {BODY} AS body_status, regexp_extract(response_body, '{SUCCESS}') AS found FROM http_tx WHERE response_code BETWEEN 500 AND 599)
    SELECT tx_id, response_frame, response_code, CASE WHEN body_status = 'complete' THEN 'contradiction' ELSE 'skipped-incomplete' END AS outcome,
      CASE WHEN body_status = 'complete' THEN CAST(strlen(string_split_regex(response_body, '{SUCCESS}')[1]) AS INT) END AS "offset",
      CASE WHEN body_status = 'complete' THEN found END AS phrase
    FROM e WHERE body_status <> 'complete' OR found <> ''""",
    "http_tx",
)
def _(spark, sf):
    return pairing.contradictions(http_tx(spark, sf)).select("tx_id", "response_frame", "response_code", "outcome", "offset", "phrase")


# Parameters cut by position: the n-th pair starts after all pairs before it.
DECODE = "url_decode(replace({}, '+', ' '))"
QUERY_PARTS_SQL = """, q AS (SELECT tx_id, uri, instr(uri, '?') AS mark, string_split(split_part(substr(uri, instr(uri, '?') + 1), '#', 1), '&') AS parts FROM http_tx WHERE contains(uri, '?')),
 p AS (SELECT tx_id, CAST(i - 1 AS INT) AS ordinal, parts[i] AS part,
   strlen(substr(uri, 1, mark)) + COALESCE(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x) + 1)), 0) AS base FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM q)),
 query_params AS (SELECT tx_id, 'query' AS source, ordinal, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS name,
   CASE WHEN contains(part, '=') THEN url_decode(replace(substr(part, instr(part, '=') + 1), '+', ' ')) ELSE '' END AS value,
   CAST(base AS INT) AS name_offset,
   CAST(base + CASE WHEN contains(part, '=') THEN strlen(split_part(part, '=', 1)) + 1 ELSE strlen(part) END AS INT) AS value_offset,
   CAST(CASE WHEN contains(part, '=') THEN strlen(substr(part, instr(part, '=') + 1)) ELSE 0 END AS INT) AS raw_length FROM p)"""
FORM_PARTS_SQL = """, fq AS (SELECT tx_id, string_split(request_body, '&') AS parts FROM http_tx WHERE request_body IS NOT NULL),
 fp AS (SELECT tx_id, CAST(i - 1 AS INT) AS ordinal, parts[i] AS part,
   COALESCE(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x) + 1)), 0) AS base FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM fq)),
 form_params AS (SELECT tx_id, 'form' AS source, ordinal, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS name,
   CASE WHEN contains(part, '=') THEN url_decode(replace(substr(part, instr(part, '=') + 1), '+', ' ')) ELSE '' END AS value,
   CAST(base AS INT) AS name_offset,
   CAST(base + CASE WHEN contains(part, '=') THEN strlen(split_part(part, '=', 1)) + 1 ELSE strlen(part) END AS INT) AS value_offset,
   CAST(CASE WHEN contains(part, '=') THEN strlen(substr(part, instr(part, '=') + 1)) ELSE 0 END AS INT) AS raw_length FROM fp)"""
PARAMETER_COLUMNS = ["tx_id", "ordinal", "name", "value", "name_offset", "value_offset", "raw_length"]


@query("query_parameters", QUERY_PARTS_SQL + f" SELECT {', '.join(PARAMETER_COLUMNS)} FROM query_params", "http_tx")
def _(spark, sf):
    return parameters.query_parameters(view(spark, sf, "http_tx")).select(PARAMETER_COLUMNS)


@query(
    "page_url_parameters",
    QUERY_PARTS_SQL.replace("FROM http_tx", "FROM (SELECT page_id AS tx_id, url AS uri FROM pages)").replace(", q AS", "WITH q AS", 1)
    + f" SELECT {', '.join(PARAMETER_COLUMNS)} FROM query_params",
)
def _(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("tx_id"), F.col("url").alias("uri"))
    return parameters.query_parameters(urls).select(PARAMETER_COLUMNS)


@query("form_fields", FORM_PARTS_SQL + f" SELECT {', '.join(PARAMETER_COLUMNS)} FROM form_params", "http_tx")
def _(spark, sf):
    return parameters.form_fields(view(spark, sf, "http_tx")).select(PARAMETER_COLUMNS)


# Patterns of the comparison SQL; in RE2 they read as in Java.
P = injection.PATTERNS


def _rx(name: str, column: str = "value") -> str:
    return f"regexp_matches({column}, '{P[name].replace(chr(39), chr(39) * 2)}')"


SIGNALS_SQL = (
    QUERY_PARTS_SQL
    + FORM_PARTS_SQL
    + f""", params AS (SELECT p.*, h.request_frame, h.response_frame, h.response_code, h.extracted_length AS response_length, {BODY} AS body_status,
    concat(h.method, ' ', h.path, '#', lower(p.name)) AS target
    FROM (SELECT * FROM query_params UNION ALL SELECT * FROM form_params) p JOIN http_tx h USING (tx_id)),
  flagged AS (SELECT *, {_rx('boolean-expression')} AS b, {_rx('union-select')} AS u, {_rx('time-delay')} AS t, {_rx('stacked-statement')} AS s,
    {_rx('metadata-query')} AND regexp_matches(value, '(?is)\\bselect\\b') AS m, {_rx('comment-truncation')} AS c FROM params),
  signalled AS (SELECT *, concat_ws(',', CASE WHEN b THEN 'boolean-expression' END, CASE WHEN u THEN 'union-select' END, CASE WHEN t THEN 'time-delay' END,
      CASE WHEN s THEN 'stacked-statement' END, CASE WHEN m THEN 'metadata-query' END,
      CASE WHEN c AND (contains(value, chr(39)) OR contains(value, '"') OR b OR u OR t OR s OR m) THEN 'comment-truncation' END) AS signals FROM flagged),
  weighed AS (SELECT *, CASE WHEN signals = '' THEN 0 ELSE len(string_split(signals, ',')) END AS n,
      greatest(CASE WHEN b THEN 0.68::DOUBLE ELSE 0 END, CASE WHEN u THEN 0.82::DOUBLE ELSE 0 END, CASE WHEN t THEN 0.88::DOUBLE ELSE 0 END,
        CASE WHEN s THEN 0.78::DOUBLE ELSE 0 END, CASE WHEN m THEN 0.72::DOUBLE ELSE 0 END,
        CASE WHEN contains(signals, 'comment') THEN 0.35::DOUBLE ELSE 0 END) AS top FROM signalled),
  scored AS (SELECT *, CASE WHEN n > 1 THEN least(0.97::DOUBLE, top + 0.08::DOUBLE * (n - 1)) ELSE top END AS base_confidence,
      concat_ws(':', source, lpad(CAST(ordinal AS VARCHAR), 9, '0'), CAST(tx_id AS VARCHAR)) AS row_id FROM weighed)"""
)


def params(spark, sf):
    return injection.collect_parameters(http_tx(spark, sf))


@query(
    "sql_signals",
    SIGNALS_SQL + " SELECT tx_id, source, ordinal, target, signals, round(base_confidence, 4) AS confidence FROM scored",
    "http_tx",
)
def _(spark, sf):
    return injection.sql_signals(params(spark, sf)).select(
        "tx_id", "source", "ordinal", "target", F.array_join("signals", ",").alias("signals"), F.round("confidence", 4).alias("confidence")
    )


EVENTS_SQL = (
    SIGNALS_SQL
    + """, nearest AS (SELECT s.*, c.request_frame AS base_frame, c.response_frame AS base_response, c.response_code AS base_code,
      c.response_length AS base_length, c.body_status AS base_status, c.row_id AS base_row,
      row_number() OVER (PARTITION BY s.row_id, s.target ORDER BY abs(c.request_frame - s.request_frame), c.request_frame, c.row_id) AS rk
    FROM scored s LEFT JOIN scored c ON c.target = s.target AND c.n = 0 WHERE s.n > 0),
  compared AS (SELECT *, base_row IS NOT NULL AND response_code IS DISTINCT FROM base_code AS code_changed,
      COALESCE(abs(response_length - base_length) >= 32 AND abs(response_length - base_length) >= greatest(1, base_length // 10), FALSE) AS length_changed,
      COALESCE(base_row IS NOT NULL AND response_frame IS NOT NULL AND body_status NOT IN ('missing', 'partial', 'length-mismatch')
        AND base_response IS NOT NULL AND base_status NOT IN ('missing', 'partial', 'length-mismatch'), FALSE) AS complete
    FROM nearest WHERE rk = 1),
  events_ AS (SELECT *, CASE WHEN complete THEN 'complete' ELSE 'partial' END AS status,
      CASE WHEN complete THEN least(0.99::DOUBLE, base_confidence + CASE WHEN code_changed OR length_changed THEN 0.08::DOUBLE ELSE 0 END)
        ELSE least(0.7::DOUBLE, least(0.99::DOUBLE, base_confidence + CASE WHEN code_changed OR length_changed THEN 0.08::DOUBLE ELSE 0 END)) END AS confidence,
      concat_ws('|', target, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')), signals) AS meaning FROM compared)"""
)


def events(spark, sf):
    return injection.injection_events(params(spark, sf))


@query(
    "nearest_baseline",
    EVENTS_SQL + " SELECT tx_id, source, ordinal, target, base_frame AS baseline_frame, base_row AS baseline_row, code_changed, length_changed FROM events_",
    "http_tx",
)
def _(spark, sf):
    return events(spark, sf).select("tx_id", "source", "ordinal", "target", "baseline_frame", "baseline_row", "code_changed", "length_changed")


# The same job over log events: errors against the nearest view of the same user.
@query(
    "nearest_clean_event",
    """SELECT event_id, clean_id FROM (SELECT e.event_id, v.event_id AS clean_id,
      row_number() OVER (PARTITION BY e.event_id ORDER BY abs(v.event_id - e.event_id), v.event_id) AS rk
      FROM events e LEFT JOIN events v ON v.user_id = e.user_id AND v.event_type = 'view' WHERE e.event_type = 'error') WHERE rk = 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").where("event_type IN ('error', 'view')").select(
        F.lit(1).alias("capture_id"), F.col("user_id").cast("string").alias("target"), F.col("event_id").alias("request_frame"),
        F.col("event_id").alias("tx_id"), F.lit("log").alias("source"), F.lit(0).alias("ordinal"),
        F.lit(None).cast("long").alias("response_frame"), F.lit(None).cast("int").alias("response_code"),
        F.lit(None).cast("int").alias("response_length"), F.lit(None).cast("string").alias("body_status"),
        F.when(F.col("event_type") == "error", F.array(F.lit("error"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
    found = injection.nearest_baseline(rows)
    return found.select(F.col("tx_id").alias("event_id"), F.col("baseline.request_frame").alias("clean_id"))


@query(
    "injection_events",
    EVENTS_SQL
    + """ SELECT tx_id, source, ordinal, status, round(confidence, 4) AS confidence, sha256(value) AS value_hash,
      CASE WHEN strlen(value) <= 256 THEN value END AS preview FROM events_""",
    "http_tx",
)
def _(spark, sf):
    return events(spark, sf).select("tx_id", "source", "ordinal", "status", F.round("confidence", 4).alias("confidence"), "value_hash", "preview")


DUP_SQL = (
    EVENTS_SQL
    + """, dup AS (SELECT *, first_value(concat(tx_id, source, ordinal)) OVER w AS first_event, min(request_frame) OVER (PARTITION BY meaning) AS first_frame
    FROM events_ WINDOW w AS (PARTITION BY meaning ORDER BY request_frame, tx_id, source, ordinal))"""
)


@query("injection_duplicates", DUP_SQL + " SELECT tx_id, source, ordinal, request_frame > first_frame AS is_duplicate FROM dup", "http_tx")
def _(spark, sf):
    return injection.mark_duplicates(events(spark, sf)).select("tx_id", "source", "ordinal", F.col("duplicate_of").isNotNull().alias("is_duplicate"))


@query(
    "document_duplicates",
    """SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER w THEN min(doc_id) OVER w END AS duplicate_of FROM documents
    WINDOW w AS (PARTITION BY regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))""",
)
def _(spark, sf):
    normal = F.regexp_replace(F.lower(F.trim("text")), "\\s+", " ")
    rows = table(spark, sf, "documents").select(
        F.lit(1).alias("capture_id"), F.lit("text").alias("detector"), "doc_id", F.sha2(F.encode(normal, "UTF-8"), 256).alias("semantic_key")
    )
    return injection.mark_duplicates(rows, "doc_id", "doc_id").select("doc_id", "duplicate_of")


FINDINGS_SQL = EVENTS_SQL + """, findings AS (SELECT target, round(max(confidence), 4) AS confidence, CAST(count(*) AS BIGINT) AS events,
   min(request_frame) AS first_frame, max(request_frame) AS last_frame,
   CASE WHEN max(confidence) >= 0.8 THEN 'high' ELSE 'medium' END AS severity,
   sha256(concat_ws(chr(31), 'finding', 'http-sql-injection-behavior', target)) AS finding_id FROM events_ GROUP BY target)"""


@query("injection_findings", FINDINGS_SQL + " SELECT * FROM findings", "http_tx")
def _(spark, sf):
    rows = injection.rollup_findings(events(spark, sf))
    return rows.select("target", F.round("confidence", 4).alias("confidence"), "events", "first_frame", "last_frame", "severity", "finding_id")


@query(
    "finding_evidence",
    EVENTS_SQL
    + """ SELECT DISTINCT target, 'injected-parameter' AS role, concat_ws(':', tx_id, source, ordinal) AS evidence FROM events_
    UNION SELECT DISTINCT target, 'response', CAST(response_frame AS VARCHAR) FROM events_ WHERE response_frame IS NOT NULL
    UNION SELECT DISTINCT target, 'clean-baseline', concat_ws('@', base_row, base_frame) FROM events_ WHERE base_row IS NOT NULL""",
    "http_tx",
)
def _(spark, sf):
    return injection.finding_evidence(events(spark, sf)).drop("capture_id")


@query(
    "findings_page",
    FINDINGS_SQL
    + " SELECT finding_id, severity, confidence, target FROM findings ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, confidence DESC, finding_id LIMIT 5 OFFSET 1",
    "http_tx",
)
def _(spark, sf):
    rows = injection.rollup_findings(events(spark, sf)).withColumn("confidence", F.round("confidence", 4))
    return pages.findings_page(rows, offset=1, limit=5).select("finding_id", "severity", "confidence", "target")


@query(
    "timeline_page",
    DUP_SQL
    + """, counted AS (SELECT *, CAST(count(*) OVER (PARTITION BY meaning) AS BIGINT) AS repeat_count,
      sha256(concat_ws(chr(31), 'behavior-event', 'http-sql-injection-behavior', tx_id, source, ordinal)) AS event_id FROM dup)
    SELECT event_id, request_frame, target, status, repeat_count FROM counted WHERE NOT request_frame > first_frame AND request_frame >= 20
    ORDER BY request_frame, event_id LIMIT 25""",
    "http_tx",
)
def _(spark, sf):
    rows = pages.timeline_page(injection.mark_duplicates(events(spark, sf)), frame_start=20, limit=25)
    return rows.select("event_id", "request_frame", "target", "status", "repeat_count")


@query(
    "transaction_detail",
    QUERY_PARTS_SQL
    + FORM_PARTS_SQL
    + """ SELECT tx_id, source, ordinal, name, value, FALSE AS truncated, total, total > 2 AS list_truncated
      FROM (SELECT *, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS total FROM (SELECT * FROM query_params UNION ALL SELECT * FROM form_params) WHERE tx_id = 40) WHERE ordinal < 2""",
    "http_tx",
)
def _(spark, sf):
    return pages.transaction_detail(view(spark, sf, "http_tx"), 40, max_parameters=2)


@query(
    "transactions_page",
    LINKS_SQL
    + """, keyed AS (SELECT *, COALESCE(request_frame, response_frame) AS tx_frame FROM pairs),
    body AS (SELECT frame_number, CASE WHEN content_length > 400 THEN 'partial' ELSE 'complete' END AS body_status FROM messages),
    msg AS (SELECT DISTINCT tx_frame, request_frame AS frame_number, 'request' AS message_role FROM keyed WHERE request_frame IS NOT NULL
      UNION SELECT DISTINCT tx_frame, response_frame, role FROM keyed WHERE response_frame IS NOT NULL),
    counts AS (SELECT tx_frame, CAST(count(*) FILTER (message_role = 'request') AS BIGINT) AS requests, CAST(count(*) FILTER (message_role = 'response') AS BIGINT) AS responses,
      CAST(count(*) FILTER (message_role = 'extra_response') AS BIGINT) AS extra_responses, CAST(count(*) FILTER (body_status = 'complete') AS BIGINT) AS complete_bodies,
      CAST(count(*) FILTER (body_status <> 'complete') AS BIGINT) AS other_bodies FROM msg JOIN body USING (frame_number) GROUP BY 1)
    SELECT h.*, requests, responses, extra_responses, complete_bodies, other_bodies FROM (SELECT tx_frame, status, stream_index, min(request_frame) AS request_frame,
      min(response_frame) AS response_frame FROM keyed GROUP BY 1, 2, 3) h JOIN counts USING (tx_frame) ORDER BY tx_frame LIMIT 100 OFFSET 50""",
    "messages",
)
def _(spark, sf):
    messages = view(spark, sf, "messages")
    bodies = messages.select("capture_id", "frame_number", F.when(F.col("content_length") > 400, "partial").otherwise("complete").alias("body_status"))
    return pages.transactions_page(pages.transaction_rows(pairs(spark, sf), bodies), 50, 100).drop("capture_id")


SHELL_SQL = """, w AS (SELECT tx_id, request_frame, uri, arg_min(lower(regexp_extract(value, '(?is)\\beval\\b.{0,24}?base64_decode\\s*\\(\\s*\\$_POST\\s*\\[\\s*[''"]?([A-Za-z_][A-Za-z0-9_-]*)', 1)), ordinal) AS action_name
   FROM form_posts WHERE regexp_matches(value, '(?is)\\beval\\b.{0,24}?base64_decode\\s*\\(\\s*\\$_POST\\s*\\[\\s*[''"]?([A-Za-z_])') GROUP BY 1, 2, 3),
 plain AS (SELECT tx_id, lower(name) AS field_name, ordinal, CASE WHEN regexp_matches(value, '^[0-9A-Fa-f]+$') AND length(value) % 2 = 0 THEN NULL
     WHEN length(value) >= 8 AND regexp_matches(value, '^[A-Za-z0-9+/]*={0,2}$') AND length(value) % 4 = 0 THEN decode(from_base64(value)) END AS text FROM form_posts),
 a AS (SELECT w.*, p.text AS action FROM w LEFT JOIN plain p ON p.tx_id = w.tx_id AND p.field_name = w.action_name),
 k AS (SELECT *, CASE WHEN action IS NULL THEN 'unknown-operation' WHEN contains(lower(action), 'php_uname') AND contains(lower(action), 'get_current_user') THEN 'system-information'
     WHEN contains(lower(action), 'opendir(') AND contains(lower(action), 'readdir(') THEN 'directory-listing'
     WHEN contains(lower(action), 'fwrite(') AND regexp_matches(action, '(?is)fopen\\s*\\([^,]+,\\s*[''"]w') THEN 'file-write' ELSE 'unknown-operation' END AS event_kind,
   list_filter(list_transform(regexp_extract_all(action, '(?is)base64_decode\\s*\\(\\s*\\$_POST\\s*\\[\\s*[''"]?([A-Za-z_][A-Za-z0-9_-]*)', 1), lambda x: lower(x)), lambda x: x <> action_name)[1] AS target_name FROM a),
 ev AS (SELECT k.*, t.text AS target_text, CASE WHEN action IS NULL OR (event_kind IN ('directory-listing', 'file-write') AND target_name IS NULL) THEN 'partial' ELSE 'complete' END AS status,
   CASE event_kind WHEN 'system-information' THEN 0.96 WHEN 'directory-listing' THEN 0.97 WHEN 'file-write' THEN 0.98 ELSE 0.55 END AS c,
   CASE WHEN t.text LIKE '_:%' THEN replace(t.text, '/', '\\') WHEN t.text IS NOT NULL THEN rtrim(t.text, '/') WHEN event_kind = 'system-information' THEN 'server-environment' ELSE k.uri END AS target
   FROM k LEFT JOIN plain t ON t.tx_id = k.tx_id AND t.field_name = k.target_name) """


@query(
    "webshell_events",
    SHELL_SQL
    + """SELECT tx_id, request_frame, event_kind, status, concat('POST ', uri) AS endpoint, target, CASE WHEN event_kind = 'file-write' THEN 3 END AS payload_ordinal,
     round(CAST(CASE WHEN status = 'partial' THEN least(c, 0.70) ELSE c END AS DOUBLE), 4) AS confidence FROM ev""",
    "form_posts",
)
def _(spark, sf):
    rows = webshell.webshell_events(view(spark, sf, "form_posts"))
    return rows.select("tx_id", "request_frame", "event_kind", "status", "endpoint", "target", "payload_ordinal", F.round("confidence", 4).alias("confidence"))


@query(
    "webshell_timeline",
    SHELL_SQL
    + """, keyed AS (SELECT *, concat_ws('|', event_kind, lower(target), COALESCE(action, '')) AS meaning FROM ev)
    SELECT tx_id, event_kind, request_frame > min(request_frame) OVER (PARTITION BY meaning) AS is_duplicate, CAST(count(*) OVER (PARTITION BY meaning) AS BIGINT) AS repeat_count FROM keyed""",
    "form_posts",
)
def _(spark, sf):
    rows = injection.mark_duplicates(webshell.webshell_events(view(spark, sf, "form_posts")))
    return rows.select("tx_id", "event_kind", F.col("duplicate_of").isNotNull().alias("is_duplicate"), "repeat_count")


EXPR_SQL = """, x AS (SELECT tx_id, request_frame, response_frame, ordinal, concat(method, ' ', uri) AS endpoint, name,
   trim(regexp_extract(name, '(?is)(?:ProcessBuilder|(?:Runtime|getRuntime)\\s*\\(\\s*\\)\\s*\\.exec)[^''"]{0,96}[''"]([^''"]{1,512})[''"]', 1)) AS command FROM form_posts
   WHERE (contains(name, chr(36) || '{') OR contains(name, '%{'))
     AND regexp_matches(lower(name), '#context|#request|#req|com\\.opensymphony|ognl|struts') AND regexp_matches(lower(name), 'processbuilder|java\\.lang\\.runtime|getruntime\\(|\\.exec\\(')) """


@query(
    "expression_events",
    EXPR_SQL
    + """SELECT tx_id, ordinal, endpoint, command AS target, CASE WHEN response_frame IS NULL THEN 'partial' ELSE 'complete' END AS status,
     CASE WHEN response_frame IS NULL THEN 0.80::DOUBLE ELSE 0.99::DOUBLE END AS confidence FROM x""",
    "form_posts",
)
def _(spark, sf):
    return webshell.expression_events(view(spark, sf, "form_posts")).select("tx_id", "ordinal", "endpoint", "target", "status", "confidence")


@query(
    "expression_findings",
    EXPR_SQL
    + """SELECT endpoint, CAST(count(*) AS BIGINT) AS events, min(request_frame) AS first_frame, 'critical' AS severity,
      max(CASE WHEN response_frame IS NULL THEN 0.80::DOUBLE ELSE 0.99::DOUBLE END) AS confidence FROM x GROUP BY endpoint""",
    "form_posts",
)
def _(spark, sf):
    rows = webshell.endpoint_findings(webshell.expression_events(view(spark, sf, "form_posts")), webshell.EXPRESSION_DETECTOR, "critical")
    return rows.select("endpoint", "events", "first_frame", "severity", "confidence")


@query(
    "correlate_transfers",
    """, keyed AS (SELECT *, CASE WHEN setup_frame IS NULL OR command_frame IS NULL THEN frame_number END AS unresolved_frame FROM transfers),
    g AS (SELECT stream_index, direction, setup_frame, command_frame, unresolved_frame, CAST(count(*) AS BIGINT) AS data_rows, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM keyed GROUP BY ALL)
    SELECT g.*, c.command, c.argument, CASE WHEN s.frame_number IS NULL OR c.frame_number IS NULL THEN 'unresolved' ELSE 'indexed' END AS status
    FROM g LEFT JOIN control s ON s.frame_number = g.setup_frame LEFT JOIN control c ON c.frame_number = g.command_frame""",
    "transfers control",
)
def _(spark, sf):
    return pairing.correlate_transfers(view(spark, sf, "control"), view(spark, sf, "transfers")).drop("capture_id")


@query(
    "fifo_pair",
    """, n AS (SELECT *, sum(CAST(starts AS INT)) OVER w AS s, sum(CAST(completes AS INT)) OVER w AS c FROM mail_rows
       WINDOW w AS (PARTITION BY stream_index ORDER BY frame_number)),
     lost AS (SELECT *, greatest(0, COALESCE(max(CASE WHEN completes THEN c - s END) OVER (PARTITION BY stream_index ORDER BY frame_number), 0)) AS l,
       greatest(0, COALESCE(max(CASE WHEN completes THEN c - s END) OVER (PARTITION BY stream_index ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lb FROM n),
     ends AS (SELECT stream_index, frame_number AS end_frame, CASE WHEN l = lb THEN c - l END AS rk FROM lost WHERE completes),
     begins AS (SELECT stream_index, frame_number AS start_frame, s AS rk FROM lost WHERE starts)
    SELECT b.stream_index, CAST(b.rk AS BIGINT) AS rank, start_frame, end_frame, CASE WHEN end_frame IS NULL THEN 'incomplete' ELSE 'matched' END AS status
      FROM begins b LEFT JOIN ends e ON e.stream_index = b.stream_index AND e.rk = b.rk
    UNION ALL SELECT stream_index, NULL, NULL, end_frame, 'unmatched' FROM ends WHERE rk IS NULL""",
    "mail_rows",
)
def _(spark, sf):
    return pairing.fifo_pair(view(spark, sf, "mail_rows"), ["stream_index"])


@query(
    "correlate_parts",
    """, pc AS (SELECT message_id, count(*) AS pn FROM parts GROUP BY 1), ac AS (SELECT message_id, count(*) AS an, min(artifact_id) AS aid, min(detected_type) AS dt FROM artifacts GROUP BY 1)
    SELECT message_id, part_id, CAST(pn AS BIGINT) AS part_count, CAST(COALESCE(an, 0) AS BIGINT) AS artifact_count, CASE WHEN pn = 1 AND an = 1 THEN aid END AS artifact_id,
      CASE WHEN pn = 1 AND an = 1 THEN CASE WHEN declared_type <> dt THEN 'type-mismatch' ELSE 'matched' END ELSE 'unresolved' END AS role
    FROM parts JOIN pc USING (message_id) LEFT JOIN ac USING (message_id)""",
    "parts artifacts",
)
def _(spark, sf):
    return pairing.correlate_parts(view(spark, sf, "parts"), view(spark, sf, "artifacts")).drop("capture_id")


@query(
    "mismatch_findings",
    """SELECT p.message_id, p.part_id, a.artifact_id, 'declared-actual-type-mismatch' AS detector, 'medium' AS severity, 0.95::DOUBLE AS confidence
    FROM parts p JOIN artifacts a USING (message_id) WHERE p.declared_type <> a.detected_type
      AND (SELECT count(*) FROM parts x WHERE x.message_id = p.message_id) = 1 AND (SELECT count(*) FROM artifacts y WHERE y.message_id = p.message_id) = 1""",
    "parts artifacts",
)
def _(spark, sf):
    return pairing.mismatch_findings(pairing.correlate_parts(view(spark, sf, "parts"), view(spark, sf, "artifacts"))).drop("capture_id")


@query(
    "prompt_responses",
    """, numbered AS (SELECT *, sum(CASE WHEN side = 'client' THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id ORDER BY record_id) AS cn FROM records),
    echoed AS (SELECT r.*, EXISTS (SELECT 1 FROM numbered c WHERE c.dialogue_id = r.dialogue_id AND c.side = 'client' AND c.record_id < r.record_id AND c.body = r.body AND r.cn - c.cn < 16)
       AND r.side = 'server' AND r.label NOT LIKE 'prompt%' AS is_echo FROM numbered r),
    marks AS (SELECT *, CASE WHEN side = 'server' AND label LIKE 'prompt%' THEN record_id * 2 + 1 WHEN (side = 'server' AND NOT is_echo) OR side = 'client' THEN record_id * 2 END AS mk FROM echoed),
    seen AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM marks)
    SELECT dialogue_id, record_id, (lm - 1) // 2 AS related_id, 'responds-to' AS relation FROM seen WHERE side = 'client' AND lm % 2 = 1""",
    "records",
)
def _(spark, sf):
    return pairing.prompt_responses(view(spark, sf, "records")).drop("capture_id")


@query(
    "echo_links",
    """, numbered AS (SELECT *, sum(CASE WHEN side = 'client' THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id ORDER BY record_id) AS cn FROM records)
    SELECT r.dialogue_id, r.record_id, max(c.record_id) AS related_id, 'echo-of' AS relation FROM numbered r JOIN numbered c ON c.dialogue_id = r.dialogue_id AND c.side = 'client'
      AND c.record_id < r.record_id AND c.body = r.body AND r.cn - c.cn < 16 WHERE r.side = 'server' AND r.label NOT LIKE 'prompt%' GROUP BY 1, 2""",
    "records",
)
def _(spark, sf):
    return pairing.echo_links(view(spark, sf, "records")).drop("capture_id")
