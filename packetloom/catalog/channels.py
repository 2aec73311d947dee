"""Queries over names, counters, pointers and input reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.corpus import NAMES_SQL
from packetloom.catalog.registry import query
from packetloom.operators import corpus, sidechannel
from packetloom.operators.ordered import row_number, scan
from packetloom.views import view

GROUPS_SQL = (
    NAMES_SQL
    + """, groups AS (SELECT source, destination, base_domain, encoding, CAST(count(*) AS BIGINT) AS queries, CAST(count(DISTINCT chunk_hex) AS BIGINT) AS unique_chunks,
   CAST(sum(size) AS BIGINT) AS decoded_bytes, CAST(max(size) AS INT) AS longest_chunk, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM decoded GROUP BY 1, 2, 3, 4) """
)
GROUP = ["source", "destination", "base_domain", "encoding"]


def decoded(spark, sf):
    return corpus.decode_query_names(view(spark, sf, "dns_queries"))


@query("dns_groups", GROUPS_SQL + "SELECT *, queries - unique_chunks AS duplicate_chunks FROM groups", "dns_queries")
def _(spark, sf):
    return sidechannel.dns_groups(decoded(spark, sf)).drop("capture_id")


@query(
    "dns_samples",
    NAMES_SQL
    + """SELECT source, destination, base_domain, encoding, CAST(rn AS INT) AS sample, encoded_name FROM (SELECT *,
     row_number() OVER (PARTITION BY source, destination, base_domain, encoding ORDER BY frame_number) AS rn FROM decoded) WHERE rn <= 3""",
    "dns_queries",
)
def _(spark, sf):
    return sidechannel.dns_samples(decoded(spark, sf)).drop("capture_id")


@query(
    "dns_score",
    GROUPS_SQL
    + """, routes AS (SELECT source, destination, count(*) AS route_queries FROM dns_queries GROUP BY 1, 2),
    scored AS (SELECT g.*, least(100, 35 + CASE WHEN queries >= 5 THEN 15 ELSE 0 END + CASE WHEN queries >= 20 THEN 10 ELSE 0 END + CASE WHEN decoded_bytes >= 512 THEN 10 ELSE 0 END
      + CASE WHEN decoded_bytes >= 4096 THEN 10 ELSE 0 END + CASE WHEN queries / route_queries >= 0.5 THEN 10 ELSE 0 END + CASE WHEN unique_chunks >= 5 THEN 5 ELSE 0 END
      + CASE WHEN longest_chunk >= 32 THEN 5 ELSE 0 END) AS score, CAST(route_queries AS BIGINT) AS route_queries FROM groups g JOIN routes USING (source, destination))
    SELECT source, destination, base_domain, encoding, queries, route_queries, score FROM scored WHERE score >= 60 AND queries >= 5 AND decoded_bytes >= 128""",
    "dns_queries",
)
def _(spark, sf):
    rows = sidechannel.dns_score(sidechannel.dns_groups(decoded(spark, sf)), view(spark, sf, "dns_queries"))
    return rows.select(*GROUP, "queries", "route_queries", "score")


@query(
    "first_seen_stream",
    NAMES_SQL
    + """, cut AS (SELECT source, destination, base_domain, encoding, substr(chunk_hex, 5) AS payload_hex, min(frame_number) AS frame_number FROM decoded WHERE size > 2 GROUP BY ALL)
    SELECT source, destination, base_domain, encoding, frame_number, payload_hex, CAST(row_number() OVER w AS BIGINT) AS ordinal,
      CAST(COALESCE(sum(length(payload_hex) // 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stream_offset
    FROM cut WINDOW w AS (PARTITION BY source, destination, base_domain, encoding ORDER BY frame_number)""",
    "dns_queries",
)
def _(spark, sf):
    rows = sidechannel.first_seen_stream(decoded(spark, sf), header=2)
    return rows.select(*GROUP, "frame_number", F.lower(F.hex("payload")).alias("payload_hex"), "ordinal", "stream_offset")


@query(
    "icmp_oracle",
    """, r AS (SELECT source, destination, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (ttl BETWEEN 32 AND 126) AS BIGINT) AS printable, CAST(count(DISTINCT ttl) AS BIGINT) AS distinct_ttl,
      CAST(count(reply_frame) AS BIGINT) AS replies FROM probes GROUP BY 1, 2)
    SELECT *, CASE WHEN ok THEN 80 + CASE WHEN printable = requests THEN 20 ELSE 15 END ELSE 0 END AS score,
      CASE WHEN ok THEN 'printable-ttl-selective-replies' ELSE 'ordinary-or-inconclusive' END AS classification
    FROM (SELECT *, requests - replies AS unanswered, requests >= 8 AND printable / requests >= 0.9 AND distinct_ttl >= 4 AND replies >= 2 AND requests - replies >= 2 AS ok FROM r)""".replace(
        "SELECT *, CASE WHEN ok", "SELECT source, destination, requests, printable, distinct_ttl, replies, unanswered, CASE WHEN ok"
    ),
    "probes",
)
def _(spark, sf):
    return sidechannel.icmp_oracle(view(spark, sf, "probes")).drop("capture_id", "first_frame", "last_frame")


@query(
    "ttl_text",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY source, destination ORDER BY frame_number) - 1 AS k FROM probes)
    SELECT source, destination, CAST(k // 32 AS BIGINT) AS block_no, string_agg(CASE WHEN ttl BETWEEN 32 AND 126 THEN chr(ttl) ELSE '.' END, '' ORDER BY k) AS attempt_text,
      string_agg(CASE WHEN reply_frame IS NULL THEN '0' ELSE '1' END, '' ORDER BY k) AS reply_bitmap,
      string_agg(CASE WHEN reply_frame IS NULL THEN '' WHEN ttl BETWEEN 32 AND 126 THEN chr(ttl) ELSE '.' END, '' ORDER BY k) AS accepted_text FROM r GROUP BY 1, 2, 3""",
    "probes",
)
def _(spark, sf):
    return sidechannel.ttl_text(view(spark, sf, "probes"), block=32).drop("capture_id", "block_start")


@query(
    "pointer_text",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY stream_index, source, destination ORDER BY frame_number) - 1 AS k FROM urgent)
    SELECT stream_index, source, destination, CAST(k // 4096 AS BIGINT) AS block_no, string_agg(CASE WHEN pointer BETWEEN 32 AND 126 THEN chr(pointer) ELSE '?' END, '' ORDER BY k) AS text,
      CAST(count(*) FILTER (pointer BETWEEN 32 AND 126 AND pointer <> 63) AS INT) AS printable FROM r GROUP BY 1, 2, 3, 4""",
    "urgent",
)
def _(spark, sf):
    return sidechannel.pointer_text(view(spark, sf, "urgent")).drop("capture_id", "block_start")


# Every stream spells a flag after 20 other characters, again and again without a pause, so flags cross the borders of
# the 32-character blocks.
FLAG_AT, FLAG = 20, "flag{hidden-in-urgent-pointers}"
SPELL = "." * FLAG_AT + FLAG


FLAGS_SQL = f""", r AS (SELECT stream_index, source, destination, row_number() OVER (PARTITION BY stream_index ORDER BY frame_number) - 1 AS k FROM urgent),
    n AS (SELECT stream_index, source, destination, count(*) AS len FROM r GROUP BY 1, 2, 3),
    s AS (SELECT *, unnest(range(0, 1 + (len - {FLAG_AT + len(FLAG)}) // {len(SPELL)})) AS j FROM n WHERE len >= {FLAG_AT + len(FLAG)}),
    flags AS (SELECT stream_index, source, destination, CAST(j * {len(SPELL)} + {FLAG_AT} AS BIGINT) AS "offset", 'flag{{hidden-in-urgent-pointers}}' AS value FROM s) """


def spelled(spark, sf):
    ranked = scan(view(spark, sf, "urgent"), ["stream_index"], "frame_number", {"k": row_number()})
    at = ((F.col("k") - 1) % len(SPELL) + 1).cast("int")
    return ranked.withColumn("pointer", F.ascii(F.substring(F.lit(SPELL), at, F.lit(1))))


@query("pointer_flags", FLAGS_SQL + "SELECT * FROM flags", "urgent")
def _(spark, sf):
    return sidechannel.pointer_flags(spelled(spark, sf), block=32).drop("capture_id")


@query(
    "pointer_candidates",
    FLAGS_SQL
    + """SELECT sha256(concat_ws(chr(31), 'candidate', 'tcp-urgent-flag', value)) AS candidate_id, 'tcp-urgent-flag' AS kind, value, 98.0::DOUBLE AS score, 0.98::DOUBLE AS confidence,
      concat_ws(':', stream_index, source, destination, "offset") AS evidence_id, 'tcp-urgent-pointer' AS role FROM flags""",
    "urgent",
)
def _(spark, sf):
    return sidechannel.pointer_candidates(sidechannel.pointer_flags(spelled(spark, sf)))


# Every stream is legible here; every third carries no flag.
@query(
    "pointer_findings",
    FLAGS_SQL
    + """SELECT n.stream_index, CAST(n.len AS BIGINT) AS pointers, 'tcp-urgent-pointer' AS detector, CASE WHEN n.stream_index % 3 <> 0 AND n.len >= 51 THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN n.stream_index % 3 <> 0 AND n.len >= 51 THEN 0.98::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM n WHERE n.len >= 4""",
    "urgent",
)
def _(spark, sf):
    plain = F.when(F.col("stream_index") % 3 == 0, F.lit(ord("x"))).otherwise(F.col("pointer"))
    rows = spelled(spark, sf).withColumn("pointer", plain)
    return sidechannel.pointer_findings(sidechannel.pointer_text(rows), sidechannel.pointer_flags(rows)).drop("capture_id")


EDGES_SQL = """, r AS (SELECT *, lag(code_a) OVER w AS pa, lag(code_b) OVER w AS pb FROM hid_reports WINDOW w AS (PARTITION BY device ORDER BY frame_number)),
 pressed AS (SELECT device, frame_number, pa, pb, unnest(list_distinct(list_filter([code_a, code_b], lambda c: c > 0))) AS code FROM r),
 edges AS (SELECT device, frame_number, code, CASE WHEN code <= 29 THEN chr(code + 93) ELSE CAST((code - 29) % 10 AS VARCHAR) END AS key FROM pressed WHERE code <> COALESCE(pa, 0) AND code <> COALESCE(pb, 0)) """


def reports(spark, sf):
    raw = view(spark, sf, "hid_reports").withColumn(
        "report", F.unhex(F.concat(F.lit("0000"), F.lpad(F.hex("code_a"), 2, "0"), F.lpad(F.hex("code_b"), 2, "0"), F.lit("00000000")))
    )
    return sidechannel.report_codes(raw)


@query("key_edges", EDGES_SQL + "SELECT device, frame_number, code, key FROM edges", "hid_reports")
def _(spark, sf):
    return sidechannel.key_edges(reports(spark, sf)).drop("capture_id")


# One more device per user reports positions derived from the same events.
DEVICES_SQL = """, k AS (SELECT device, 8 AS len, code_a, code_b, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y, CAST(NULL AS BIGINT) AS pressure FROM hid_reports),
 p AS (SELECT device + 100000 AS device, 10 AS len, NULL AS code_a, NULL AS code_b, 1 + (frame_number * 37) % (10 + device * 3) AS x, 1 + (frame_number * 91) % 900 AS y, frame_number % 200 AS pressure FROM hid_reports),
 u AS (SELECT * FROM k UNION ALL SELECT * FROM p),
 d AS (SELECT device, CAST(count(*) AS BIGINT) AS reports, count(*) FILTER (len = 8) AS eight, count(*) FILTER (len = 8 AND code_a = 0 AND code_b = 0) AS releases, count(x) AS points,
   CAST(min(x) AS BIGINT) AS min_x, CAST(max(x) AS BIGINT) AS max_x, CAST(min(y) AS BIGINT) AS min_y, CAST(max(y) AS BIGINT) AS max_y, CAST(min(pressure) AS BIGINT) AS min_pressure, CAST(max(pressure) AS BIGINT) AS max_pressure,
   count(*) FILTER (code_a > 0 OR code_b > 0) AS codes FROM u GROUP BY device),
 c AS (SELECT *, CASE WHEN eight >= 4 AND eight / reports >= 0.8 AND releases > 0 AND codes > 0 THEN 'boot-keyboard-like'
   WHEN points >= 20 AND max_x - min_x >= 100 AND max_y - min_y >= 100 THEN 'absolute-pointer-like' ELSE 'unclassified' END AS classification FROM d) """


def devices(spark, sf):
    none = F.lit(None).cast("long")
    keys = reports(spark, sf).select(
        "capture_id", "device", F.lit(8).alias("report_length"), "reserved", "codes", none.alias("x"), none.alias("y"), none.alias("pressure")
    )
    points = view(spark, sf, "hid_reports").select(
        "capture_id", (F.col("device") + 100_000).alias("device"), F.lit(10).alias("report_length"), F.lit(None).cast("int").alias("reserved"),
        F.lit(None).cast("array<int>").alias("codes"),
        F.expr("1 + (frame_number * 37) % (10 + device * 3)").alias("x"), F.expr("1 + (frame_number * 91) % 900").alias("y"),
        (F.col("frame_number") % 200).alias("pressure"),
    )
    return keys.unionByName(points)


@query("hid_classify", DEVICES_SQL + "SELECT device, reports, classification FROM c", "hid_reports")
def _(spark, sf):
    return sidechannel.hid_classify(devices(spark, sf)).select("device", "reports", "classification")


@query(
    "pointer_ranges",
    DEVICES_SQL
    + """SELECT device, CAST(points AS BIGINT) AS points, min_x, max_x, min_y, max_y, min_pressure, max_pressure FROM c
    WHERE points >= 20 AND max_x - min_x >= 100 AND max_y - min_y >= 100""",
    "hid_reports",
)
def _(spark, sf):
    return sidechannel.pointer_ranges(devices(spark, sf)).drop("capture_id")


@query("length_histogram", DEVICES_SQL + "SELECT device, len AS report_length, CAST(count(*) AS BIGINT) AS reports FROM u GROUP BY 1, 2", "hid_reports")
def _(spark, sf):
    return sidechannel.length_histogram(devices(spark, sf)).drop("capture_id")


@query(
    "hid_correlated",
    DEVICES_SQL
    + """SELECT bool_or(classification = 'boot-keyboard-like') AS has_keyboard, bool_or(classification = 'absolute-pointer-like') AS has_pointer,
    bool_or(classification = 'boot-keyboard-like') AND bool_or(classification = 'absolute-pointer-like') AS correlated FROM c""",
    "hid_reports",
)
def _(spark, sf):
    return sidechannel.hid_correlated(sidechannel.hid_classify(devices(spark, sf))).drop("capture_id")


@query(
    "icmp_findings",
    """, r AS (SELECT source, destination, count(*) AS n, count(*) FILTER (ttl BETWEEN 32 AND 126) AS p, count(DISTINCT ttl) AS d, count(reply_frame) AS a FROM probes GROUP BY 1, 2)
    SELECT source, destination, 'icmp-ttl-oracle' AS detector, 'high' AS severity, 0.92::DOUBLE AS confidence FROM r WHERE n >= 8 AND p / n >= 0.9 AND d >= 4 AND a >= 2 AND n - a >= 2""",
    "probes",
)
def _(spark, sf):
    return sidechannel.icmp_findings(sidechannel.icmp_oracle(view(spark, sf, "probes"))).drop("capture_id")


@query(
    "hid_findings",
    DEVICES_SQL
    + """SELECT device, 'usb-hid-triage' AS detector, 'medium' AS severity, CASE classification WHEN 'boot-keyboard-like' THEN 0.88::DOUBLE ELSE 0.80::DOUBLE END AS confidence
    FROM c WHERE classification <> 'unclassified'""",
    "hid_reports",
)
def _(spark, sf):
    return sidechannel.hid_findings(sidechannel.hid_classify(devices(spark, sf))).drop("capture_id")
