"""Queries over rebuilt streams, sequences, records and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.functions.text import explode_matches
from packetloom.operators import budget, corpus, pairing, reassembly, records, sequence
from packetloom.plans import pages
from packetloom.session import cut
from packetloom.views import table, view

# Comparison by single bytes: the earliest frame that covers a byte owns it.
BYTES_SQL = """, bytes AS (SELECT stream_index, frame_number, seq + i AS pos, substr(payload, CAST(i + 1 AS INT), 1) AS b
   FROM (SELECT *, unnest(range(0, length(payload))) AS i FROM segments)),
 owner AS (SELECT stream_index, pos, min(frame_number) AS owner, arg_min(b, frame_number) AS ob FROM bytes GROUP BY 1, 2),
 spans AS (SELECT stream_index, owner AS frame_number, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end" FROM (
   SELECT *, pos - row_number() OVER (PARTITION BY stream_index, owner ORDER BY pos) AS island FROM owner) GROUP BY stream_index, owner, island),
 later AS (SELECT x.stream_index, x.frame_number, o.owner, x.pos, x.b = o.ob AS same FROM bytes x JOIN owner o USING (stream_index, pos) WHERE x.frame_number <> o.owner),
 runs AS (SELECT stream_index, frame_number, owner, same, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end" FROM (
   SELECT *, pos - row_number() OVER (PARTITION BY stream_index, frame_number, owner, same ORDER BY pos) AS island FROM later) GROUP BY stream_index, frame_number, owner, same, island),
 gaps AS (SELECT stream_index, prev AS start, start AS "end" FROM (SELECT *, lag("end") OVER (PARTITION BY stream_index ORDER BY start) AS prev FROM spans) WHERE start > prev),
 heads AS (SELECT stream_index, CAST(count(*) AS BIGINT) AS segments, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM segments GROUP BY 1),
 sums AS (SELECT h.*, COALESCE(s.n, 0) AS span_count, COALESCE(s.b, 0) AS unique_bytes, COALESCE(d.n, 0) AS duplicate_count, COALESCE(d.b, 0) AS duplicate_bytes,
     COALESCE(c.n, 0) AS conflict_count, COALESCE(c.b, 0) AS conflict_bytes, COALESCE(g.n, 0) AS gap_count, COALESCE(g.b, 0) AS gap_bytes FROM heads h
   LEFT JOIN (SELECT stream_index, CAST(count(*) AS BIGINT) AS n, CAST(sum("end" - start) AS BIGINT) AS b FROM spans GROUP BY 1) s USING (stream_index)
   LEFT JOIN (SELECT stream_index, CAST(count(*) AS BIGINT) AS n, CAST(sum("end" - start) AS BIGINT) AS b FROM runs WHERE same GROUP BY 1) d USING (stream_index)
   LEFT JOIN (SELECT stream_index, CAST(count(*) AS BIGINT) AS n, CAST(sum("end" - start) AS BIGINT) AS b FROM runs WHERE NOT same GROUP BY 1) c USING (stream_index)
   LEFT JOIN (SELECT stream_index, CAST(count(*) AS BIGINT) AS n, CAST(sum("end" - start) AS BIGINT) AS b FROM gaps GROUP BY 1) g USING (stream_index)),
 statuses AS (SELECT *, CASE WHEN unique_bytes = 0 THEN 'empty' WHEN conflict_count > 0 THEN 'conflicting' WHEN gap_count > 0 THEN 'partial' ELSE 'complete' END AS status FROM sums) """
KEY = ["capture_id", "direction"]


def ledgers(spark, sf, *want):
    return reassembly.reassemble(view(spark, sf, "segments"), want)


@query(
    "reassembled_spans",
    BYTES_SQL + """SELECT stream_index, frame_number, start, "end", CAST(COALESCE(sum("end" - start) OVER (PARTITION BY stream_index ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS output_offset FROM spans""",
    "segments",
)
def _(spark, sf):
    return ledgers(spark, sf, "spans")["spans"].drop(*KEY)


@query("reassembled_duplicates", BYTES_SQL + 'SELECT stream_index, frame_number, owner, start, "end" FROM runs WHERE same', "segments")
def _(spark, sf):
    return ledgers(spark, sf, "duplicates")["duplicates"].drop(*KEY)


@query(
    "reassembled_conflicts",
    BYTES_SQL
    + """SELECT r.stream_index, r.frame_number, r.owner, r.start, r."end",
      sha256(substr(x.payload, CAST(r.start - x.seq + 1 AS INT), CAST(r."end" - r.start AS INT))) AS conflicting_hash,
      sha256(substr(o.payload, CAST(r.start - o.seq + 1 AS INT), CAST(r."end" - r.start AS INT))) AS first_hash
    FROM runs r JOIN segments x ON x.stream_index = r.stream_index AND x.frame_number = r.frame_number
    JOIN segments o ON o.stream_index = r.stream_index AND o.frame_number = r.owner WHERE NOT r.same""",
    "segments",
)
def _(spark, sf):
    return reassembly.conflict_hashes(ledgers(spark, sf, "conflicts")["conflicts"], view(spark, sf, "segments")).drop(*KEY)


@query("stream_gaps", BYTES_SQL + 'SELECT stream_index, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM gaps', "segments")
def _(spark, sf):
    return ledgers(spark, sf, "gaps")["gaps"].drop(*KEY)


def statuses(spark, sf):
    segments = view(spark, sf, "segments")
    return reassembly.stream_status(segments, reassembly.reassemble(segments, reassembly.STATUS))


@query("stream_status", BYTES_SQL + "SELECT * FROM statuses", "segments")
def _(spark, sf):
    return statuses(spark, sf).drop(*KEY)


# Streams under limits: at most so many segments and bytes of each, in frame order; what does not fit is passed over.
MOST_SEGMENTS, MOST_BYTES = 32, 1_500
KEPT_SQL = f""", ordered AS (SELECT stream_index, frame_number, length(CAST(payload AS VARCHAR)) AS size, row_number() OVER (PARTITION BY stream_index ORDER BY frame_number) AS rn FROM segments),
 walk AS (SELECT stream_index, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS frame_number, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, '' AS reason FROM (SELECT DISTINCT stream_index FROM segments)
   UNION ALL SELECT o.stream_index, o.rn, o.frame_number, w.n + CASE WHEN w.n < {MOST_SEGMENTS} AND w.b + o.size <= {MOST_BYTES} THEN 1 ELSE 0 END,
     w.b + CASE WHEN w.n < {MOST_SEGMENTS} AND w.b + o.size <= {MOST_BYTES} THEN o.size ELSE 0 END,
     CASE WHEN w.n >= {MOST_SEGMENTS} THEN 'segment-limit' WHEN w.b + o.size > {MOST_BYTES} THEN 'payload-budget' ELSE 'kept' END
   FROM walk w JOIN ordered o ON o.stream_index = w.stream_index AND o.rn = w.rn + 1),
 kept AS (SELECT s.* FROM segments s JOIN walk w USING (stream_index, frame_number) WHERE w.reason = 'kept') """


def limited_segments(spark, sf, carry=True):
    return reassembly.limit_segments(view(spark, sf, "segments"), MOST_SEGMENTS, MOST_BYTES, carry)


@query(
    "segment_skips",
    KEPT_SQL + "SELECT stream_index, reason, CAST(count(*) AS BIGINT) AS skipped FROM walk WHERE reason IN ('segment-limit', 'payload-budget') GROUP BY 1, 2",
    "segments",
)
def _(spark, sf):
    return budget.skip_counts(limited_segments(spark, sf, carry=False)[1], ["stream_index"])


@query(
    "truncated_streams",
    KEPT_SQL + BYTES_SQL.replace("FROM segments", "FROM kept")
    + """SELECT t.stream_index, t.segments, t.unique_bytes, CAST(COALESCE(k.n, 0) AS BIGINT) AS skipped_segments, CASE WHEN k.n > 0 THEN 'truncated' ELSE t.status END AS status
    FROM statuses t LEFT JOIN (SELECT stream_index, count(*) AS n FROM walk WHERE reason IN ('segment-limit', 'payload-budget') GROUP BY 1) k USING (stream_index)""",
    "segments",
)
def _(spark, sf):
    kept, skips = limited_segments(spark, sf)
    rows = reassembly.stream_status(kept, reassembly.reassemble(kept, reassembly.STATUS), skips=skips)
    return rows.select("stream_index", "segments", "unique_bytes", "skipped_segments", "status")


@query(
    "stream_content",
    BYTES_SQL
    + """, placed AS (SELECT stream_index, ob, pos, row_number() OVER (PARTITION BY stream_index ORDER BY pos) - 1 AS o FROM owner)
    SELECT stream_index, CAST(o // 65536 AS BIGINT) AS block_no, sha256(string_agg(ob, '' ORDER BY o)) AS content_hash, CAST(count(*) AS BIGINT) AS output_bytes FROM placed GROUP BY 1, 2""",
    "segments",
)
def _(spark, sf):
    rows = reassembly.stream_content(ledgers(spark, sf, "cells"))
    return rows.select("stream_index", "block_no", F.sha2("data", 256).alias("content_hash"), F.octet_length("data").cast("long").alias("output_bytes"))


@query(
    "text_stream_rollup",
    BYTES_SQL
    + """SELECT stream_index, CASE status WHEN 'conflicting' THEN 'conflicting' WHEN 'partial' THEN 'partial' ELSE 'reconstructed' END AS status,
     CAST(unique_bytes AS BIGINT) AS output_bytes, CAST(1 AS BIGINT) AS directions FROM statuses""",
    "segments",
)
def _(spark, sf):
    return reassembly.text_stream_rollup(statuses(spark, sf)).drop("capture_id")


@query(
    "streams_page",
    BYTES_SQL
    + """SELECT t.stream_index, t.status, t.segments, t.gap_count, t.conflict_count, s.source_frame_start, s.source_frame_end, s.sequence_start, s.sequence_end
    FROM statuses t JOIN (SELECT stream_index, min(frame_number) AS source_frame_start, max(frame_number) AS source_frame_end, min(start) AS sequence_start, max("end") AS sequence_end
      FROM spans GROUP BY 1) s USING (stream_index) ORDER BY t.stream_index LIMIT 50 OFFSET 25""",
    "segments",
)
def _(spark, sf):
    segments = view(spark, sf, "segments")
    parts = reassembly.reassemble(segments, [*reassembly.STATUS, "extents"])
    rows = pages.streams_page(reassembly.stream_status(segments, parts), parts["extents"], 25, 50)
    return rows.select(
        "stream_index", "status", "segments", "gap_count", "conflict_count", "source_frame_start", "source_frame_end", "sequence_start", "sequence_end"
    )


@query(
    "covers_stream",
    BYTES_SQL
    + """, ordered AS (SELECT *, max("end") OVER (PARTITION BY stream_index ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
     totals AS (SELECT doc_id AS stream_index, CAST(length(text) AS BIGINT) AS total FROM documents)
    SELECT t.stream_index, total, CAST(COALESCE(max("end"), 0) AS BIGINT) AS reached, COALESCE(bool_and(start <= COALESCE(reach, 0)) AND max("end") = total, total = 0) AS covers
    FROM totals t LEFT JOIN ordered o USING (stream_index) GROUP BY 1, 2""",
    "segments",
)
def _(spark, sf):
    totals = table(spark, sf, "documents").select(F.col("doc_id").alias("stream_index"), F.length("text").cast("long").alias("total"))
    spans = ledgers(spark, sf, "spans")["spans"]
    return pairing.covers_stream(spans, totals, ["stream_index"])


# Words of the texts as matches in stream positions: which frames supplied their bytes.
MATCH_SQL = """, folded AS (SELECT doc_id AS stream_index, regexp_replace(text, '[^\\x01-\\x7F]', '?', 'g') AS t FROM documents),
  parts AS (SELECT stream_index, i AS match_id, parts[i] AS gap, w[i] AS word, list_sum(list_transform(parts[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT stream_index, regexp_extract_all(t, '[A-Za-z]{12,}') AS w, string_split_regex(t, '[A-Za-z]{12,}') AS parts FROM folded))),
  found AS (SELECT stream_index, start, start + length(word) AS "end" FROM parts) """


def _matches(spark, sf):
    text = F.regexp_replace("text", "[^\\x01-\\x7F]", "?")
    folded = table(spark, sf, "documents").select(F.col("doc_id").alias("stream_index"), text.alias("t"))
    start = F.col("hit.offset").cast("long")
    return explode_matches(folded, "[A-Za-z]{12,}", "t").select(
        "stream_index", start.alias("start"), (start + F.length("hit.value")).alias("end"), start.alias("match_id")
    )


@query(
    "contributing_frames",
    BYTES_SQL + MATCH_SQL + """SELECT DISTINCT f.stream_index, CAST(f.start AS BIGINT) AS match_id, s.frame_number FROM found f JOIN spans s ON s.stream_index = f.stream_index AND s.start < f."end" AND s."end" > f.start""",
    "segments",
)
def _(spark, sf):
    spans = ledgers(spark, sf, "spans")["spans"].select("stream_index", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "frame_number")
    return pairing.contributing_frames(_matches(spark, sf), spans, ["stream_index"], "match_id")


@query("unwrap_seq", "SELECT stream_index, frame_number, true_seq + 65500 AS extended FROM seq_packets", "seq_packets")
def _(spark, sf):
    return sequence.unwrap_seq(view(spark, sf, "seq_packets"), ["capture_id", "stream_index"], "frame_number").select("stream_index", "frame_number", "extended")


QUALITY_SQL = """, r AS (SELECT *, true_seq + 65500 AS ext, row_number() OVER (PARTITION BY stream_index, true_seq ORDER BY frame_number) AS nth,
    first_value(payload) OVER (PARTITION BY stream_index, true_seq ORDER BY frame_number) AS fp FROM seq_packets),
  q AS (SELECT stream_index, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (nth = 1) AS BIGINT) AS unique_packets, CAST(count(*) FILTER (nth > 1 AND payload = fp) AS BIGINT) AS duplicate_packets,
    CAST(count(*) FILTER (nth > 1 AND payload <> fp) AS BIGINT) AS conflicting_packets, min(ext) AS lowest, max(ext) AS highest FROM r GROUP BY 1) """


@query("rtp_quality", QUALITY_SQL + "SELECT *, highest - lowest + 1 - unique_packets AS missing_packets FROM q", "seq_packets")
def _(spark, sf):
    return sequence.rtp_quality(view(spark, sf, "seq_packets"), ["capture_id", "stream_index"], "frame_number", "payload").drop("capture_id")


@query(
    "usable_rtp",
    """SELECT reason, CAST(count(*) AS BIGINT) AS packets FROM (SELECT CASE WHEN stream_index % 3 = 2 THEN 'unsupported-payload-type' WHEN true_seq % 9 = 0 THEN 'empty-payload' ELSE 'usable' END AS reason FROM seq_packets) GROUP BY 1""",
    "seq_packets",
)
def _(spark, sf):
    rows = view(spark, sf, "seq_packets").withColumn("payload_type", F.expr("CASE stream_index % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 96 END")).withColumn(
        "payload", F.when(F.col("true_seq") % 9 == 0, "").otherwise(F.col("payload"))
    )
    good, bad = sequence.usable_rtp(rows)
    return good.select(F.lit("usable").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("packets"))


def block_sessions(packets):
    stream = F.col("stream_index")
    return packets.select("stream_index").distinct().select(
        "stream_index",
        F.when(stream % 2 == 0, 64).otherwise(7).alias("block_size"),
        F.when(stream % 10 != 1, 1069).alias("server_port"),
        F.when(stream % 10 == 0, 2).alias("error_code"),
    )


# Block transfers number their blocks from one; the sequence here is the true one, folded to 16 bits.
@query(
    "reassemble_blocks",
    """, p AS (SELECT stream_index, frame_number, true_seq AS ext, payload FROM seq_packets),
     r AS (SELECT *, row_number() OVER (PARTITION BY stream_index, ext ORDER BY frame_number) AS nth, first_value(payload) OVER (PARTITION BY stream_index, ext ORDER BY frame_number) AS fp FROM p),
     t AS (SELECT stream_index, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (nth = 1) AS BIGINT) AS blocks, CAST(count(*) FILTER (nth > 1 AND payload <> fp) AS BIGINT) AS conflicting_blocks,
       min(ext) AS lo, max(ext) AS hi FROM r GROUP BY 1)
    SELECT stream_index, packets, blocks, packets - blocks AS duplicate_packets, conflicting_blocks, greatest(lo - 1, 0) + hi - lo + 1 - blocks AS missing_blocks,
      stream_index % 2 = 0 AS terminal_block_seen, CASE WHEN stream_index % 10 = 0 THEN 'server-error' WHEN stream_index % 10 = 1 THEN 'unresolved' WHEN conflicting_blocks > 0 THEN 'conflicting'
        WHEN greatest(lo - 1, 0) + hi - lo + 1 - blocks > 0 OR lo <> 1 OR stream_index % 2 <> 0 THEN 'partial' ELSE 'complete' END AS status FROM t""",
    "seq_packets",
)
def _(spark, sf):
    packets = view(spark, sf, "seq_packets").withColumn("seq", F.expr("CAST(true_seq % 65536 AS INT)"))
    _, status = sequence.reassemble_blocks(packets, block_sessions(packets), ["stream_index"], "frame_number", "payload")
    return status.select(
        "stream_index", "packets", "blocks", "duplicate_packets", "conflicting_blocks", "missing_blocks", "terminal_block_seen", "status"
    )


# The first packets of the capture only: a transfer that lost any to the limit says so.
MOST_PACKETS = 600


@query(
    "budget_limited_transfers",
    f""", o AS (SELECT *, row_number() OVER (ORDER BY frame_number) AS place FROM seq_packets), p AS (SELECT stream_index, frame_number, true_seq AS ext, payload FROM o WHERE place <= {MOST_PACKETS}),
     r AS (SELECT *, row_number() OVER (PARTITION BY stream_index, ext ORDER BY frame_number) AS nth, first_value(payload) OVER (PARTITION BY stream_index, ext ORDER BY frame_number) AS fp FROM p),
     t AS (SELECT stream_index, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (nth = 1) AS BIGINT) AS blocks, CAST(count(*) FILTER (nth > 1 AND payload <> fp) AS BIGINT) AS conflicting_blocks,
       min(ext) AS lo, max(ext) AS hi FROM r GROUP BY 1),
     a AS (SELECT stream_index, CAST(count(*) FILTER (place > {MOST_PACKETS}) AS BIGINT) AS skipped_packets FROM o GROUP BY 1)
    SELECT stream_index, packets, blocks, skipped_packets, CASE WHEN stream_index % 10 = 0 THEN 'server-error' WHEN stream_index % 10 = 1 THEN 'unresolved' WHEN skipped_packets > 0 THEN 'budget-limited'
        WHEN conflicting_blocks > 0 THEN 'conflicting' WHEN greatest(lo - 1, 0) + hi - lo + 1 - blocks > 0 OR lo <> 1 OR stream_index % 2 <> 0 THEN 'partial' ELSE 'complete' END AS status
    FROM a LEFT JOIN t USING (stream_index)""",
    "seq_packets",
)
def _(spark, sf):
    packets = view(spark, sf, "seq_packets").withColumn("seq", F.expr("CAST(true_seq % 65536 AS INT)"))
    kept, skips = budget.limit_rows(packets, ["capture_id"], "frame_number", MOST_PACKETS, "packet-limit")
    _, status = sequence.reassemble_blocks(kept, block_sessions(packets), ["stream_index"], "frame_number", "payload", skips)
    return status.select("stream_index", "packets", "blocks", "skipped_packets", "status")


@query(
    "assign_asof",
    """SELECT e.event_id, max(s.request_frame) AS transfer FROM (SELECT event_id, user_id, event_id + 1 AS f FROM events WHERE event_type <> 'signup') e
      LEFT JOIN sessions s ON s.route = e.user_id AND s.request_frame <= e.f GROUP BY 1""",
    "sessions",
)
def _(spark, sf):
    packets = table(spark, sf, "events").where("event_type <> 'signup'").select("event_id", F.col("user_id").alias("route"), (F.col("event_id") + 1).alias("frame_number"))
    openings = view(spark, sf, "sessions").select("route", "request_frame", F.col("request_frame").alias("transfer"))
    return pairing.assign_asof(packets, openings, ["route"], "frame_number", "request_frame", "transfer").select("event_id", "transfer")


# A signup is a read request; the user's later events belong to the latest one.
SESSION_SQL = """, p AS (SELECT event_id + 1 AS frame_number, user_id, event_type, event_id FROM events),
  a AS (SELECT p.*, max(s.request_frame) AS req FROM p JOIN sessions s ON s.route = p.user_id AND s.request_frame < p.frame_number WHERE p.event_type <> 'signup' GROUP BY ALL),
  f AS (SELECT req, arg_max(event_id % 5 + 3000, frame_number) FILTER (event_type IN ('view', 'click')) AS server_port, min(frame_number) FILTER (event_type IN ('view', 'click')) AS response_frame,
    arg_max(event_id % 7, frame_number) FILTER (event_type = 'error') AS error_code, arg_max(event_id % 2000, frame_number) FILTER (event_type = 'purchase' AND event_id % 2000 >= 8) AS block_size FROM a GROUP BY 1) """


@query(
    "transfer_sessions",
    SESSION_SQL
    + """SELECT s.request_frame, CAST(s.route AS BIGINT) AS client_port, f.server_port, f.response_frame, f.error_code, CAST(COALESCE(f.block_size, 512) AS INT) AS block_size
    FROM sessions s LEFT JOIN f ON f.req = s.request_frame""",
    "sessions",
)
def _(spark, sf):
    packets = table(spark, sf, "events").select(
        F.lit(1).alias("capture_id"), (F.col("event_id") + 1).alias("frame_number"), F.col("user_id"), "event_type", "event_id"
    )
    openings = view(spark, sf, "sessions").select(F.col("route").alias("user_id"), "request_frame", F.col("request_frame").alias("named"))
    dated = pairing.assign_asof(packets, openings, ["user_id"], "frame_number", "request_frame", "named")
    kind = F.col("event_type")
    opens, answers = kind == "signup", kind.isin("view", "click")
    rows = dated.select(
        "capture_id", "frame_number",
        F.when(answers, "server").otherwise("client").alias("source"), F.when(answers, "client").otherwise("server").alias("destination"),
        F.when(answers, F.col("event_id") % 5 + 3000).otherwise(F.col("user_id")).alias("source_port"),
        F.when(opens, 69).otherwise(1024).alias("destination_port"), F.when(opens, 1).alias("opcode"),
        F.lit("a.bin").alias("source_file"), F.lit("").alias("destination_file"), F.lit("octet").alias("mode"),
        F.when(~opens, F.col("named")).alias("request_frame"),
        F.when(kind == "error", F.col("event_id") % 7).alias("error_code"), F.lit("no").alias("error_message"),
        F.when(kind == "purchase", "blksize").otherwise("").alias("option_name"), (F.col("event_id") % 2000).cast("string").alias("option_value"),
    )
    found = pairing.transfer_sessions(rows)
    return found.select("request_frame", "client_port", "server_port", "response_frame", "error_code", "block_size")


@query(
    "pair_echo",
    """SELECT frame_number, ttl, CASE WHEN reply_frame IS NOT NULL THEN reply_frame + CASE WHEN frame_number % 5 = 0 THEN 1 ELSE 0 END END AS last_reply FROM probes""",
    "probes",
)
def _(spark, sf):
    probes = view(spark, sf, "probes")
    # Every fifth request is answered twice; the later reply counts.
    twice = F.when(F.col("frame_number") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    replies = probes.where("reply_frame IS NOT NULL").select(
        "capture_id", F.col("frame_number").alias("response_to"), F.col("reply_frame"), F.explode(twice).alias("n")
    ).select("capture_id", "response_to", (F.col("reply_frame") + F.col("n")).alias("frame_number"))
    return pairing.pair_echo(probes.drop("reply_frame"), replies).select("frame_number", "ttl", F.col("reply_frame").alias("last_reply"))


# Turns as dialogue text: lines end in line feeds, system turns end in a colon, some turns carry a control byte.
TURNS = """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'client' ELSE 'server' END AS side,
  concat(CASE WHEN turn % 3 = 1 THEN chr(7) ELSE '' END, text, CASE WHEN role = 'system' THEN ' Login: ' WHEN turn % 2 = 0 THEN chr(13) || chr(10) ELSE '' END) AS body FROM conversations"""


@query(
    "segment_records",
    "WITH turns AS (" + TURNS + r"""), cut AS (SELECT conv_id, turn, side, body, regexp_extract_all(body, '[^\x00-\x1f]{200}|[^\x00-\x1f]{199}\r|[^\x00-\x1f]{0,199}\n|[^\x00-\x1f]{0,198}\r\n|[\x00-\x09\x0b\x0c\x0e-\x1f]|[^\x00-\x1f]{1,199}') AS r FROM turns),
     rows_ AS (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM cut),
     laid AS (SELECT conv_id, turn, side, strlen(body) AS n, CAST(i - 1 AS INT) AS ordinal, r[i] AS value, CAST(COALESCE(list_sum(list_transform(r[1:i - 1], lambda x: strlen(x))), 0) AS INT) AS "offset" FROM rows_)
    SELECT conv_id, turn, ordinal, "offset", CAST(strlen(value) AS INT) AS byte_length, value,
      CASE WHEN right(value, 1) = chr(10) THEN 'line' WHEN length(value) >= 200 THEN 'bounded' WHEN regexp_matches(value, '^[\x00-\x1f]$') THEN 'control'
        WHEN "offset" + strlen(value) = n AND side = 'server' AND regexp_matches(value, ':[ \t]*$') THEN 'prompt' ELSE 'text' END AS label,
      CASE WHEN right(value, 1) <> chr(10) AND length(value) < 200 AND "offset" + strlen(value) = n AND side = 'server' AND regexp_matches(value, ':[ \t]*$') THEN 'login' END AS prompt FROM laid""",
)
def _(spark, sf):
    kind = F.col("role")
    tail = F.when(kind == "system", " Login: ").when(F.col("turn") % 2 == 0, "\r\n").otherwise("")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(kind == "user", "client").otherwise("server").alias("side"),
        F.concat(F.when(F.col("turn") % 3 == 1, "\x07").otherwise(""), F.col("text"), tail).alias("body"),
    )
    return records.segment_records(turns, "body", "side", 200).drop("side")


# Mail streams: user turns are messages, other turns are server lines; message lines that start with a dot are doubled.
# Each turn is sent in chunks of seven characters.  The last user turn of every fifth conversation lacks its dot line, and
# what follows it belongs to it.
MAIL_CHUNK = 7
MAIL_WINDOW = 1_024
MAIL_SQL = """WITH ended AS (SELECT *, conv_id % 5 = 0 AND turn = max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS cut FROM conversations),
 chunks AS (SELECT conv_id, turn, role, text, cut, CASE role WHEN 'user' THEN concat('DATA' || chr(13) || chr(10), '..', replace(text, chr(10), chr(13) || chr(10) || '..'), chr(13) || chr(10), CASE WHEN cut THEN '' ELSE '.' || chr(13) || chr(10) END)
   ELSE concat('250 accepted for delivery', chr(13) || chr(10)) END AS body FROM ended),
 placed AS (SELECT *, COALESCE(sum(strlen(body)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
   sum(strlen(body)) OVER (PARTITION BY conv_id) AS size, string_agg(body, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM chunks) """


def mail_chunks(spark, sf):
    turns = table(spark, sf, "conversations")
    last = turns.where("role = 'user' AND conv_id % 5 = 0").groupBy("conv_id").agg(F.max("turn").alias("last"))
    cut = F.coalesce(F.col("turn") == F.col("last"), F.lit(False))
    message = F.concat(F.lit("DATA\r\n.."), F.replace("text", F.lit("\n"), F.lit("\r\n..")), F.lit("\r\n"), F.when(cut, "").otherwise(".\r\n"))
    bodies = turns.join(last, "conv_id", "left").select(
        "conv_id", "turn", F.when(F.col("role") == "user", message).otherwise("250 accepted for delivery\r\n").alias("body"))
    parts = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{MAIL_CHUNK}}}"), F.lit(0))
    cuts = bodies.select("conv_id", "turn", F.posexplode(parts).alias("i", "body"))
    return cuts.select("conv_id", (F.col("turn").cast("long") * (1 << 32) + F.col("i")).alias("sent"), "body")


@query(
    "extract_data_blocks",
    MAIL_SQL
    + """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal, CAST(base + 6 AS BIGINT) AS start,
      CAST(CASE WHEN cut THEN size ELSE base + strlen(body) - 3 END AS BIGINT) AS "end", CASE WHEN cut THEN 'incomplete' ELSE 'complete' END AS status
      FROM placed WHERE role = 'user'""",
)
def _(spark, sf):
    return records.extract_data_blocks(mail_chunks(spark, sf), ["conv_id"], "sent", "body", MAIL_WINDOW)


@query(
    "data_block_text",
    MAIL_SQL
    + """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal, CAST(base + 6 AS BIGINT) AS start,
      sha256(concat('.', replace(text, chr(10), chr(13) || chr(10) || '.'), chr(13) || chr(10), CASE WHEN cut THEN COALESCE(rest, '') ELSE '' END)) AS text_hash
      FROM placed WHERE role = 'user'""",
)
def _(spark, sf):
    chunks = mail_chunks(spark, sf)
    rows = records.block_text(records.extract_data_blocks(chunks, ["conv_id"], "sent", "body", MAIL_WINDOW), chunks, ["conv_id"], "sent", "body", MAIL_WINDOW)
    # A message is a turn here; its pieces are put together for the comparison only.
    whole = rows.groupBy("conv_id", "ordinal").agg(
        F.min("piece_start").alias("start"), F.array_sort(F.collect_list(F.struct("piece_start", F.hex("piece").alias("digits")))).alias("parts"))
    return whole.select(
        "conv_id", "ordinal", "start", F.sha2(F.unhex(F.array_join(F.transform("parts", lambda x: x["digits"]), "")), 256).alias("text_hash"))


# Records of a dialogue as ranges of its text, and secrets found in that text.
LINK_SQL = """WITH r AS (SELECT conv_id, turn, concat(text, CASE WHEN (conv_id + turn) % 4 = 0 THEN concat(' flag{', substr(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 10), '} ') ELSE ' ' END) AS body FROM conversations),
 placed AS (SELECT *, COALESCE(sum(strlen(body)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r) """


def linked_records(spark, sf):
    secret = F.when(
        (F.col("conv_id") + F.col("turn")) % 4 == 0,
        F.concat(F.lit(" flag{"), F.substring(F.md5((F.col("conv_id") * 1000 + F.col("turn")).cast("string")), 1, 10), F.lit("} ")),
    ).otherwise(" ")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", secret).alias("body"))
    placed = records.with_base(rows, ["conv_id"], "turn", "body")
    hits = corpus.scan_known(placed.select("conv_id", "turn", "base", "body"), "body")
    found = hits.select("conv_id", (F.col("base") + F.col("offset")).alias("start"), (F.col("base") + F.col("offset") + F.octet_length("value")).alias("end"), "value")
    ranges = placed.select("conv_id", "turn", F.col("base").alias("span_start"), (F.col("base") + F.octet_length("body")).alias("span_end"))
    return found, ranges


@query(
    "link_candidates",
    LINK_SQL + "SELECT conv_id, turn, regexp_extract(body, 'flag\\{[0-9a-f]{10}\\}') AS value FROM placed WHERE regexp_matches(body, 'flag\\{[0-9a-f]{10}\\}')",
)
def _(spark, sf):
    found, ranges = linked_records(spark, sf)
    return pairing.overlap_join(found, ranges, ["conv_id"]).select("conv_id", "turn", "value")


@query(
    "dialogue_page",
    """, numbered AS (SELECT *, sum(CASE WHEN side = 'client' THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id ORDER BY record_id) AS cn FROM records),
    echo AS (SELECT r.record_id, max(c.record_id) AS related_id FROM numbered r JOIN numbered c ON c.dialogue_id = r.dialogue_id AND c.side = 'client'
      AND c.record_id < r.record_id AND c.body = r.body AND r.cn - c.cn < 16 WHERE r.side = 'server' AND r.label NOT LIKE 'prompt%' GROUP BY 1),
    ids AS (SELECT DISTINCT dialogue_id FROM records ORDER BY dialogue_id LIMIT 30 OFFSET 10),
    shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY dialogue_id ORDER BY record_id) AS INT) AS ordinal, CAST(count(*) OVER (PARTITION BY dialogue_id) AS BIGINT) AS records_total
      FROM records WHERE dialogue_id IN (SELECT dialogue_id FROM ids))
    SELECT s.dialogue_id, s.record_id, s.ordinal, s.side, s.label, s.records_total, s.records_total > 4 AS records_truncated, strlen(s.body) > 60 AS preview_truncated,
      CASE WHEN e.record_id IS NOT NULL THEN concat('echo-of:', e.related_id) END AS relations, CAST(CASE WHEN e.record_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS relations_total, FALSE AS relations_truncated,
      CASE WHEN s.side = 'server' THEN concat('c', s.record_id % 7, ',d', s.record_id % 5) END AS candidates, CAST(CASE WHEN s.side = 'server' THEN 3 ELSE 0 END AS BIGINT) AS candidates_total,
      s.side = 'server' AS candidates_truncated,
      array_to_string(list_transform(regexp_extract_all(substr(hex(s.body), 1, 120), '..'), lambda h: CASE h WHEN '09' THEN '\\t' WHEN '0A' THEN '\\n' WHEN '0D' THEN '\\r' WHEN '5C' THEN '\\\\'
        ELSE CASE WHEN h BETWEEN '20' AND '7E' THEN chr(CAST('0x' || h AS INT)) ELSE concat('\\x', lower(h)) END END), '') AS preview
    FROM shown s LEFT JOIN echo e USING (record_id) WHERE ordinal <= 4""",
    "records",
)
def _(spark, sf):
    rows = view(spark, sf, "records")
    relations = pairing.echo_links(rows)
    # Three candidates for each server record, of which the list holds the two best.
    number = F.col("record_id")
    named = F.array(
        F.struct(F.concat(F.lit("c"), (number % 7).cast("string")).alias("candidate_id"), F.lit(90.0).alias("score")),
        F.struct(F.concat(F.lit("d"), (number % 5).cast("string")).alias("candidate_id"), F.lit(80.0).alias("score")),
        F.struct(F.lit("e").alias("candidate_id"), F.lit(10.0).alias("score")),
    )
    links = rows.where("side = 'server'").select("record_id", F.inline(named))
    found = pages.dialogue_page(rows, relations, links, 10, 30, record_limit=4, preview_bytes=60, candidate_limit=2)
    return found.drop("capture_id")
