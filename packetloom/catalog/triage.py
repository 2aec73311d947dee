"""Triage inputs from all six evidence classes, each by its own operator and its own test for completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.catalog.streams import BYTES_SQL, MAIL_SQL, ledgers, mail_chunks
from packetloom.operators import content, decode, rank, reassembly, records, sequence, signatures
from packetloom.operators.ordered import lag, running_count, scan
from packetloom.session import cut
from packetloom.views import table, view

# Bodies of pages; some hold a second file behind the text, and those that are cut short yield no whole file.
BODY_SQL = """concat(html, CASE page_id % 3 WHEN 0 THEN concat('PK', chr(3), chr(4), page_id) WHEN 1 THEN '%PDF-1.7 end' ELSE '' END)"""
# Every packet of every stream is sent.  Even streams number what they send without losses, an altered copy as a block of its own; odd streams
# keep the numbers of the capture and stay partial or in conflict.
TRIAGE_SQL = BYTES_SQL + MAIL_SQL.replace("WITH ended", ", ended", 1) + f""",
 bodies AS (SELECT page_id, {BODY_SQL} AS body, page_id % 13 <> 0 AS filled, page_id % 13 <> 0 AND page_id % 17 <> 0 AS whole FROM pages),
 tcp AS (SELECT stream_index, (n - 1) // 65536 AS block_no, string_agg(ob, '' ORDER BY n) AS d FROM (SELECT *, row_number() OVER (PARTITION BY stream_index ORDER BY pos) AS n FROM owner) GROUP BY 1, 2),
 sent AS (SELECT stream_index, frame_number, payload, CASE WHEN stream_index % 2 = 0 THEN dense_rank() OVER (PARTITION BY stream_index ORDER BY true_seq, payload = 'altered') ELSE true_seq END AS block FROM seq_packets),
 copies AS (SELECT *, row_number() OVER w AS nth, first_value(payload) OVER w AS fp FROM sent WINDOW w AS (PARTITION BY stream_index, block ORDER BY frame_number)),
 settled AS (SELECT stream_index, stream_index % 10 <> 0 AND count(*) FILTER (payload <> fp) = 0 AND min(block) = 1 AND max(block) = count(*) FILTER (nth = 1) AND arg_max(strlen(fp), block) < 64 AS unbroken FROM copies GROUP BY 1),
 evidence AS (
  SELECT 'http-body' AS source_kind, CAST(page_id AS VARCHAR) AS source_id, sha256(body) AS content_hash, strlen(body) AS byte_length, filled AS complete, CAST(NULL AS VARCHAR) AS parent_id FROM bodies
  UNION ALL SELECT 'transform', concat(doc_id, ':1'), CASE doc_id % 3 WHEN 0 THEN sha256(hex(text)) ELSE sha256(text) END, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END * strlen(text), TRUE, concat(doc_id, ':0')
    FROM documents WHERE doc_id % 3 < 2 AND strlen(text) >= 4
  UNION ALL SELECT 'transform', concat(doc_id, ':2'), sha256(text), strlen(text), TRUE, concat(doc_id, ':1') FROM documents WHERE doc_id % 3 = 0 AND strlen(text) >= 4
  UNION ALL SELECT 'file-carve', concat(page_id, ':', strpos_, ':', CASE page_id % 3 WHEN 0 THEN 'zip' ELSE 'pdf' END), sha256(tail), strlen(tail), whole, CAST(page_id AS VARCHAR)
    FROM (SELECT *, strlen(html_) AS strpos_, substr(body, length(html_) + 1) AS tail FROM (SELECT b.*, p.html AS html_ FROM bodies b JOIN pages p USING (page_id))) WHERE page_id % 3 < 2
  UNION ALL SELECT 'tcp-stream', concat(stream_index, ':', block_no), sha256(d), strlen(d), TRUE, NULL FROM tcp
  UNION ALL SELECT 'tftp-data', concat(stream_index, ':', block), sha256(fp), strlen(fp), unbroken, CAST(stream_index AS VARCHAR) FROM copies JOIN settled USING (stream_index) WHERE nth = 1
  UNION ALL SELECT 'smtp-message', concat(conv_id, ':', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), sha256(concat('.', replace(text, chr(10), chr(13) || chr(10) || '.'), chr(13) || chr(10), CASE WHEN cut THEN COALESCE(rest, '') ELSE '' END)),
    strlen(concat('.', replace(text, chr(10), chr(13) || chr(10) || '.'), chr(13) || chr(10), CASE WHEN cut THEN COALESCE(rest, '') ELSE '' END)), NOT cut, CAST(conv_id AS VARCHAR) FROM placed WHERE role = 'user'),
 usable AS (SELECT * FROM evidence WHERE complete AND byte_length > 0) """


def transfers(spark, sf) -> DataFrame:
    """Blocks of each transfer with the transfer's status, from all packets of all streams."""
    stream, sent = F.col("stream_index"), F.struct("true_seq", "payload")
    marked = scan(view(spark, sf, "seq_packets"), ["stream_index"], "frame_number", {"before": lag(sent)})
    numbered = scan(marked.withColumn("new", ~sent.eqNullSafe(F.col("before"))), ["stream_index"], "frame_number", {"nth": running_count(F.col("new"))})
    block = F.when(stream % 2 == 0, F.col("nth")).otherwise(F.col("true_seq"))
    packets = cut(numbered.select("stream_index", "frame_number", (block % sequence.MODULUS).cast("int").alias("seq"), "payload"))
    sessions = packets.select("stream_index").distinct().select(
        "stream_index", F.lit(64).alias("block_size"), F.lit(1069).alias("server_port"), F.when(stream % 10 == 0, 2).alias("error_code"))
    blocks, status = sequence.reassemble_blocks(packets, sessions, ["stream_index"], "frame_number", "payload")
    return blocks.join(status.select("stream_index", "status"), "stream_index")


def classes(spark, sf) -> list[DataFrame]:
    def sha(value):
        return F.sha2(value.cast("binary"), 256)

    def joined(*parts):
        return F.concat_ws(":", *(p.cast("string") for p in parts))

    tail = F.expr("CASE page_id % 3 WHEN 0 THEN concat('PK', chr(3), chr(4), page_id) WHEN 1 THEN '%PDF-1.7 end' ELSE '' END")
    status = content.classify_body(view(spark, sf, "http_tx")).select(F.col("tx_id").alias("page_id"), "extracted_length", "body_status")
    bodies = cut(table(spark, sf, "pages").select("page_id", F.encode(F.concat("html", tail), "UTF-8").alias("body")).join(status, "page_id"))
    hits = signatures.signature_hits(bodies.select("page_id", "body"), "body").where("format IN ('zip', 'pdf')")
    carved = hits.select("page_id", "format", "offset").join(bodies, "page_id")
    file = F.expr("substring(body, offset + 1)")
    hops = decode.decode_chain(view(spark, sf, "encoded_values"), "doc_id", "value")
    blocks = transfers(spark, sf)
    rebuilt = reassembly.stream_content(ledgers(spark, sf, "cells"))
    mail = mail_chunks(spark, sf)
    found = records.extract_data_blocks(mail, ["conv_id"], "sent", "body")
    messages = records.block_text(found, mail, ["conv_id"], "sent", "body").join(found.select("conv_id", "ordinal", "status"), ["conv_id", "ordinal"])
    col = F.col
    return [
        rank.evidence(bodies, "http-body", col("page_id"), sha(col("body")), F.octet_length("body"), col("extracted_length") > 0),
        rank.evidence(hops, "transform", joined(col("owner"), col("depth")), col("output_hash"), col("output_length"), col("status") == "decoded", joined(col("owner"), col("depth") - 1)),
        rank.evidence(carved, "file-carve", joined(col("page_id"), col("offset"), col("format")), sha(file), F.octet_length(file), col("body_status") == "complete", col("page_id")),
        rank.evidence(rebuilt, "tcp-stream", joined(col("stream_index"), col("block_no")), sha(col("data")), F.octet_length("data"), F.lit(True)),
        rank.evidence(blocks, "tftp-data", joined(col("stream_index"), col("extended")), sha(col("payload")), F.octet_length("payload"), col("status") == "complete", col("stream_index")),
        rank.evidence(messages, "smtp-message", joined(col("conv_id"), col("ordinal")), sha(col("piece")), F.octet_length("piece"), col("status") == "complete", col("conv_id")),
    ]


@query("triage_inputs", TRIAGE_SQL + "SELECT DISTINCT source_kind, source_id, content_hash, CAST(byte_length AS BIGINT) AS byte_length FROM usable", "segments seq_packets")
def _(spark, sf):
    return rank.triage_inputs(*classes(spark, sf))[0]


@query(
    "triage_lineage",
    TRIAGE_SQL + """SELECT DISTINCT content_hash, source_kind, source_id, parent_id, content_hash IN (SELECT content_hash FROM usable) AS usable
    FROM evidence WHERE parent_id IS NOT NULL""",
    "segments seq_packets",
)
def _(spark, sf):
    return rank.triage_inputs(*classes(spark, sf))[1]
