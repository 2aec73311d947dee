"""Queries over terminal dialogues: rebuilt streams, their records, and the frames behind each record."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.operators import corpus, pairing, rank, reassembly, records, terminal
from packetloom.operators.reassembly import STREAM
from packetloom.plans import pages
from packetloom.session import cut
from packetloom.views import table

# Each side of a conversation is one direction of a stream, sent in segments of 31 bytes.  Some turns begin with a control
# byte; they end in a prompt, a return and a line feed, a bare return, or a secret.  Some segments are lost, some come twice.
PIECE = 31
LIMIT = 48
WINDOW = 1_024
SENT_SQL = f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'c>s' ELSE 's>c' END AS direction,
   concat(CASE WHEN turn % 3 = 1 THEN chr(7) ELSE '' END, regexp_replace(text, '[^\\x01-\\x7F]', '?', 'g'),
     CASE WHEN role = 'system' THEN ' Login: ' WHEN turn % 4 = 0 THEN chr(13) || chr(10) WHEN turn % 4 = 1 THEN chr(13) WHEN turn % 4 = 2 THEN ' ready:  ' ELSE concat(' flag{{', substr(md5(CAST(conv_id * 100 + turn AS VARCHAR)), 1, 10), '}} ') END) AS body FROM conversations),
 placed AS (SELECT *, COALESCE(sum(strlen(body)) OVER (PARTITION BY conv_id, direction ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM turns),
 pieces AS (SELECT conv_id, direction, turn * 100000 + 2 * i AS frame_number, base + {PIECE} * i AS seq, substr(body, CAST({PIECE} * i + 1 AS BIGINT), {PIECE}) AS piece
   FROM (SELECT *, unnest(range(0, (strlen(body) + {PIECE - 1}) // {PIECE})) AS i FROM placed) WHERE (conv_id + turn + i) % 19 <> 7),
 laid AS (SELECT *, CAST(sum(strlen(piece)) OVER (PARTITION BY conv_id, direction ORDER BY seq) AS BIGINT) AS stop FROM pieces),
 streams AS (SELECT conv_id, direction, string_agg(piece, '' ORDER BY seq) AS t, list(stop) FILTER (direction = 's>c') AS stops FROM laid GROUP BY 1, 2),
 -- One record of each stream at a time, from where the last one ended.
 rec AS (SELECT conv_id, direction, CAST(-1 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS "start", CAST(0 AS BIGINT) AS "end", '' AS label FROM streams
   UNION ALL SELECT conv_id, direction, ordinal + 1, e, e + COALESCE(p, n),
     CASE WHEN p < n OR p = n AND n < {LIMIT} THEN 'prompt' WHEN right(m, 1) = chr(10) THEN 'line' WHEN n = {LIMIT} THEN 'bounded' WHEN right(m, 1) = chr(13) THEN 'line'
       WHEN regexp_matches(m, '^[\\x00-\\x1f]$') THEN 'control' ELSE 'text' END
   FROM (SELECT *, strlen(m) AS n, list_min(list_filter(list_transform(stops, lambda x: x - e), lambda d: d > 0 AND d <= strlen(m) AND regexp_matches(substr(m, 1, d), ':[ \\t]*$'))) AS p
     FROM (SELECT conv_id, direction, ordinal, "end" AS e, stops, regexp_extract(substr(t, "end" + 1, {LIMIT}),
         '^(?:[^\\x00-\\x1f]{{{LIMIT}}}|[^\\x00-\\x1f]{{{LIMIT - 1}}}\\r|[^\\x00-\\x1f]{{0,{LIMIT - 1}}}\\n|[^\\x00-\\x1f]{{0,{LIMIT - 2}}}\\r\\n?|[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f]|[^\\x00-\\x1f]{{1,{LIMIT - 1}}})') AS m
       FROM rec JOIN streams USING (conv_id, direction) WHERE "end" < strlen(t)))),
 records AS (SELECT r.*, substr(t, "start" + 1, "end" - "start") AS value FROM rec r JOIN streams USING (conv_id, direction) WHERE ordinal >= 0) """


def sent(spark, sf):
    kind, turn = F.col("role"), F.col("turn")
    tail = F.when(kind == "system", " Login: ").when(turn % 4 == 0, "\r\n").when(turn % 4 == 1, "\r").when(turn % 4 == 2, " ready:  ").otherwise(
        F.concat(F.lit(" flag{"), F.substring(F.md5((F.col("conv_id") * 100 + turn).cast("string")), 1, 10), F.lit("} ")))
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(kind == "user", "c>s").otherwise("s>c").alias("direction"),
        F.concat(F.when(turn % 3 == 1, "\x07").otherwise(""), F.regexp_replace("text", "[^\\x01-\\x7F]", "?"), tail).alias("body"))
    placed = records.with_base(turns, ["conv_id", "direction"], "turn", "body")
    parts = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = placed.select("conv_id", "direction", "turn", "base", F.posexplode(parts).alias("i", "piece"))
    place = F.col("conv_id") + turn + F.col("i")
    copies = F.when(place % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return pieces.where(place % 19 != 7).select("*", F.explode(copies).alias("copy")).select(
        F.lit(1).alias("capture_id"), F.col("conv_id").alias("stream_index"), "direction",
        (turn.cast("long") * 100_000 + F.col("i") * 2 + F.col("copy")).alias("frame_number"),
        (F.col("base") + F.col("i") * PIECE).alias("seq"), F.encode("piece", "UTF-8").alias("payload"))


def dialogue(spark, sf):
    """Rebuilt content, accepted spans and records; a server's sources end where its spans end."""
    parts = reassembly.reassemble(cut(sent(spark, sf)), ["spans", "cells"])
    content, spans = cut(reassembly.stream_content(parts)), cut(parts["spans"])
    ends = spans.where("direction = 's>c'").select(*STREAM, (F.col("output_offset") + F.col("end") - F.col("start")).alias("at"))
    return content, spans, terminal.stream_records(content, STREAM, "block_no", "data", ends, LIMIT, WINDOW)


@query(
    "stream_records",
    SENT_SQL + """SELECT conv_id, direction, ordinal, "start", "end", label, value,
      CASE WHEN label = 'prompt' THEN nullif(regexp_replace(lower(regexp_extract(value, '(\\S+)\\s*:[ \\t]*$', 1)), '[^a-z0-9_-]', '', 'g'), '') END AS prompt FROM records""",
)
def _(spark, sf):
    content, _, rows = dialogue(spark, sf)
    shown = terminal.record_bytes(rows, content, STREAM, "block_no", "data", LIMIT, WINDOW)
    return shown.select(
        F.col("stream_index").alias("conv_id"), "direction", "ordinal", "start", "end", "label", F.decode("value", "UTF-8").alias("value"), "prompt")


@query(
    "record_sources",
    SENT_SQL + """SELECT conv_id, direction, ordinal, frame_number, greatest(0, stop - strlen(piece) - "start") AS record_offset, greatest("start", stop - strlen(piece)) AS stream_offset,
      least("end", stop) - greatest("start", stop - strlen(piece)) AS byte_length
    FROM records JOIN laid USING (conv_id, direction) WHERE stop > "start" AND stop - strlen(piece) < "end" """,
)
def _(spark, sf):
    _, spans, rows = dialogue(spark, sf)
    return terminal.record_sources(rows, spans, STREAM).withColumnRenamed("stream_index", "conv_id").drop("capture_id")


# A page of dialogues: records of both sides with the frames that carried them, echoes, and the secrets found in the rebuilt
# streams, which may begin in one record and end in the next.
@query(
    "terminal_page",
    SENT_SQL + """, rows_ AS (SELECT *, conv_id * 1000000 + ordinal * 2 + CASE direction WHEN 's>c' THEN 1 ELSE 0 END AS record_id FROM records),
    numbered AS (SELECT *, sum(CASE WHEN direction = 'c>s' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY record_id) AS cn FROM rows_),
    echo AS (SELECT r.record_id, max(c.record_id) AS related_id FROM numbered r JOIN numbered c ON c.conv_id = r.conv_id AND c.direction = 'c>s'
      AND c.record_id < r.record_id AND c.value = r.value AND r.cn - c.cn < 16 WHERE r.direction = 's>c' AND r.label NOT LIKE 'prompt%' GROUP BY 1),
    ids AS (SELECT DISTINCT conv_id FROM rows_ ORDER BY conv_id LIMIT 30 OFFSET 5),
    shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY record_id) AS INT) AS place, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS records_total
      FROM rows_ WHERE conv_id IN (SELECT conv_id FROM ids)),
    came AS (SELECT record_id, list(concat(frame_number, '@', greatest(0, stop - strlen(piece) - "start"), '+', least("end", stop) - greatest("start", stop - strlen(piece))) ORDER BY stop) AS l
      FROM rows_ JOIN laid USING (conv_id, direction) WHERE stop > "start" AND stop - strlen(piece) < "end" GROUP BY 1),
    secrets AS (SELECT conv_id, direction, p, substr(t, p + 1, 16) AS v FROM (SELECT *, unnest(range(0, strlen(t))) AS p FROM streams) WHERE regexp_matches(substr(t, p + 1, 16), '^flag\\{[0-9a-f]{10}\\}$')),
    hits AS (SELECT record_id, list(DISTINCT sha256(concat_ws(chr(31), 'candidate', 'flag', v))) AS l FROM rows_ r JOIN secrets s ON s.conv_id = r.conv_id AND s.direction = r.direction AND "start" < p + 16 AND "end" > p GROUP BY 1)
    SELECT s.conv_id AS dialogue_id, s.record_id, place AS ordinal, CASE direction WHEN 's>c' THEN 'server' ELSE 'client' END AS side, label, records_total, records_total > 40 AS records_truncated, strlen(value) > 30 AS preview_truncated,
      CASE WHEN e.record_id IS NOT NULL THEN concat('echo-of:', e.related_id) END AS relations, CAST(CASE WHEN e.record_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS relations_total, FALSE AS relations_truncated,
      array_to_string(list_sort(h.l), ',') AS candidates, CAST(COALESCE(len(h.l), 0) AS BIGINT) AS candidates_total, FALSE AS candidates_truncated,
      array_to_string(c.l[1:2], ',') AS sources, CAST(len(c.l) AS BIGINT) AS sources_total, len(c.l) > 2 AS sources_truncated,
      array_to_string(list_transform(regexp_extract_all(substr(hex(value), 1, 60), '..'), lambda h: CASE h WHEN '09' THEN '\\t' WHEN '0A' THEN '\\n' WHEN '0D' THEN '\\r' WHEN '5C' THEN '\\\\'
        ELSE CASE WHEN h BETWEEN '20' AND '7E' THEN chr(CAST('0x' || h AS INT)) ELSE concat('\\x', lower(h)) END END), '') AS preview
    FROM shown s LEFT JOIN echo e USING (record_id) LEFT JOIN came c USING (record_id) LEFT JOIN hits h USING (record_id) WHERE place <= 40""",
)
def _(spark, sf):
    content, spans, found = dialogue(spark, sf)
    number = F.col("stream_index") * 1_000_000 + F.col("ordinal") * 2 + F.when(F.col("direction") == "s>c", 1).otherwise(0)
    ranges = cut(terminal.record_bytes(found, content, STREAM, "block_no", "data", LIMIT, WINDOW).withColumn("record_id", number))
    rows = ranges.select(
        "capture_id", F.col("stream_index").alias("dialogue_id"), "record_id", F.when(F.col("direction") == "s>c", "server").otherwise("client").alias("side"),
        "label", F.col("value").alias("body"))
    sources = terminal.record_sources(found, spans, STREAM).withColumn("record_id", number)
    hits = terminal.stream_matches(content, STREAM, "block_no", "data", lambda texts: corpus.scan_known(texts, "text", ["flag"]), WINDOW)
    spots = pairing.overlap_join(hits, ranges.select(*STREAM, "record_id", F.col("start").alias("span_start"), F.col("end").alias("span_end")), STREAM)
    links = rank.score_known(spots, F.col("record_id")).select(F.col("evidence_id").cast("long").alias("record_id"), "candidate_id", "score").distinct()
    return pages.dialogue_page(
        rows, pairing.echo_links(rows), links, 5, 30, record_limit=40, preview_bytes=30, candidate_limit=20, sources=sources, source_limit=2,
    ).drop("capture_id")
