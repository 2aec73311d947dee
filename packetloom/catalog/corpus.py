"""Queries over text and byte corpora: scans, decoding, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.registry import query
from packetloom.operators import content, corpus, decode, parameters, rank, signatures
from packetloom.plans import pages
from packetloom.views import table, view

# Comparison of scans: every position that can start a match is tested on the text from there on, and a
# position inside an earlier match is dropped.  RE2 has no look-behind, so the character before is
# looked at on its own.
KNOWN_SQL = r""", bodies AS (SELECT doc_id, body, lower(body) AS low FROM evidence_text),
 starts AS (SELECT doc_id, body, unnest(list_filter(range(1, CAST(length(body) AS BIGINT) + 1), lambda i: substr(low, i, 3) IN ('fla', 'ctf', 'key', 'ans') OR substr(low, i, 1) = '{')) AS i FROM bodies
   WHERE regexp_matches(low, '(flag|ctf|key|answer)[\{:=]')),
 cut AS (SELECT doc_id, i, body, substr(body, i, 300) AS rest, CASE WHEN i = 1 THEN '' ELSE substr(body, i - 1, 1) END AS prev FROM starts),
 hit AS (SELECT doc_id, i, body, CASE WHEN NOT regexp_matches(prev, '[A-Za-z0-9_]') AND regexp_matches(rest, '^(?i:flag|ctf|key|answer)\{[^{}\r\n]{1,256}\}')
      THEN regexp_extract(rest, '^(?i:flag|ctf|key|answer)\{[^{}\r\n]{1,256}\}')
    WHEN regexp_matches(rest, '^\{(?i:flag|ctf|key|answer)[:=][^{}\r\n]{1,256}\}') THEN regexp_extract(rest, '^\{(?i:flag|ctf|key|answer)[:=][^{}\r\n]{1,256}\}')
    WHEN NOT regexp_matches(prev, '[A-Za-z0-9_]') AND regexp_matches(rest, '^(?i:flag|ctf|key|answer)[:=][A-Za-z0-9][A-Za-z0-9_.+/-]{7,255}([^A-Za-z0-9_.+/-]|$)')
      THEN regexp_extract(rest, '^((?i:flag|ctf|key|answer)[:=][A-Za-z0-9][A-Za-z0-9_.+/-]{7,255})', 1) END AS value FROM cut),
 free AS (SELECT *, max(i + length(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM hit WHERE value IS NOT NULL),
 known AS (SELECT doc_id, CAST(strlen(substr(body, 1, CAST(i - 1 AS BIGINT))) AS INT) AS "offset", value, lower(regexp_extract(value, '(?i)(flag|ctf|key|answer)', 1)) AS prefix FROM free
   WHERE (busy IS NULL OR i >= busy) AND CASE WHEN value LIKE '{%' THEN TRUE
     WHEN NOT contains(value, '{') THEN regexp_matches(regexp_replace(value, '^[^:=]*[:=]', ''), '[A-Za-z]') AND regexp_matches(regexp_replace(value, '^[^:=]*[:=]', ''), '[0-9]')
     ELSE NOT regexp_matches(regexp_extract(value, '\{(.*)\}', 1), '(?i)(^|;)(background(-position)?|color|display|font-size|line-height|position|text-align|text-anchor|word-break|word-wrap)\s*:') END) """


def known(spark, sf):
    return corpus.scan_known(view(spark, sf, "evidence_text"), "body")


@query("scan_known", KNOWN_SQL + 'SELECT doc_id, "offset", value, prefix FROM known', "evidence_text")
def _(spark, sf):
    return known(spark, sf)


# Windows of 700 characters: hits over window borders are found once, as with one window.
@query("scan_known_chunked", KNOWN_SQL + 'SELECT doc_id, "offset", value, prefix FROM known', "evidence_text")
def _(spark, sf):
    return corpus.scan_known(view(spark, sf, "evidence_text"), "body", chunk=700)


# Tokens and braces end at characters outside their class, so splitting on those gives every run whole.
UNKNOWN_SQL = r""", runs AS (SELECT doc_id, unnest(regexp_extract_all(body, '[A-Za-z0-9_.+/=:-]+')) AS run FROM texts),
 token AS (SELECT doc_id, 'unknown-token' AS kind, run AS value FROM runs WHERE length(run) BETWEEN 24 AND 128 AND regexp_matches(run, '^[A-Za-z0-9]')
   AND NOT regexp_matches(lower(run), '^(https?://|www\.)') AND length(run) - length(replace(run, '/', '')) <= 3 AND length(run) - length(replace(run, '.', '')) <= 3
   AND NOT contains(substr(run, 1, length(run) - 2), '=') AND regexp_matches(run, '[a-z]') AND regexp_matches(run, '[A-Z]') AND regexp_matches(run, '[0-9]')
   AND regexp_matches(run, '[_./+=-]') AND NOT regexp_matches(run, '^[A-Za-z0-9+/=]*$')),
 opens AS (SELECT doc_id, body, unnest(list_filter(range(1, CAST(length(body) AS BIGINT) + 1), lambda i: regexp_matches(substr(body, i, 1), '[A-Za-z]') AND (i = 1 OR NOT regexp_matches(substr(body, i - 1, 1), '[A-Za-z0-9_]')))) AS i
   FROM texts WHERE regexp_matches(body, '[A-Za-z0-9_-]\{[\x21-\x7a\x7c\x7e]{4,256}\}')),
 braced AS (SELECT doc_id, i, regexp_extract(substr(body, i, 300), '^([A-Za-z][A-Za-z0-9_-]{1,32}\{[\x21-\x7a\x7c\x7e]{4,256}\})([^A-Za-z0-9_]|$)', 1) AS value FROM opens WHERE contains(substr(body, i, 34), '{')),
 brace AS (SELECT doc_id, 'unknown-brace' AS kind, value FROM (SELECT *, max(i + length(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM braced WHERE value <> '')
   WHERE (busy IS NULL OR i >= busy) AND lower(split_part(value, '{', 1)) NOT IN ('flag', 'ctf', 'key', 'answer', 'catch', 'class', 'do', 'else', 'finally', 'for', 'foreach', 'function', 'if', 'switch', 'try', 'while')),
 unknown AS (SELECT * FROM token UNION ALL SELECT * FROM brace) """


def unknown(spark, sf):
    return corpus.scan_unknown(view(spark, sf, "evidence_text"), "body")


@query(
    "scan_unknown",
    ", texts AS (SELECT doc_id, body FROM evidence_text)" + UNKNOWN_SQL + "SELECT doc_id, kind, value, CAST(count(*) AS BIGINT) AS hits FROM unknown GROUP BY ALL",
    "evidence_text",
)
def _(spark, sf):
    return unknown(spark, sf).groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "scan_unknown_pages",
    "WITH texts AS (SELECT page_id AS doc_id, concat(html, '<i data-t=\"Tk-', md5(CAST(page_id AS VARCHAR)), '.Zz\"></i>') AS body FROM pages)" + UNKNOWN_SQL + "SELECT doc_id, kind, value, CAST(count(*) AS BIGINT) AS hits FROM unknown GROUP BY ALL",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").selectExpr(
        "page_id AS doc_id", "concat(html, '<i data-t=\"Tk-', md5(CAST(page_id AS STRING)), '.Zz\"></i>') AS body"
    )
    return corpus.scan_unknown(rows, "body").groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("hits"))


# Two runs over the same text with different windows find the same matches twice.
@query(
    "distinct_matches",
    ", texts AS (SELECT doc_id, body FROM evidence_text)" + UNKNOWN_SQL + "SELECT kind, CAST(count(*) AS BIGINT) AS matches FROM unknown GROUP BY kind",
    "evidence_text",
)
def _(spark, sf):
    again = corpus.scan_unknown(view(spark, sf, "evidence_text"), "body", chunk=2000)
    both = corpus.distinct_matches(unknown(spark, sf).unionByName(again), ["doc_id"])
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("matches"))


# Content is scanned once per distinct text; known and unknown hits meet on its hash.
@query(
    "suppress_known",
    KNOWN_SQL + ", texts AS (SELECT doc_id, body FROM evidence_text)" + UNKNOWN_SQL
    + """, h AS (SELECT doc_id, sha256(body) AS content_hash FROM evidence_text)
    SELECT DISTINCT h.content_hash, u.kind, u.value FROM unknown u JOIN h USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM known k JOIN h hk ON hk.doc_id = k.doc_id WHERE hk.content_hash = h.content_hash AND trim(k.value) = trim(u.value))""",
    "evidence_text",
)
def _(spark, sf):
    texts = content.content_table(view(spark, sf, "evidence_text"), "body", "doc_id").select("content_hash", "content")
    found = corpus.suppress_known(corpus.scan_unknown(texts, "content"), corpus.scan_known(texts, "content"))
    return found.select("content_hash", "kind", "value").distinct()


MARKED_SQL = """, digits AS (SELECT doc_id, concat(hex(text), CASE doc_id % 8 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '0AFFD8FF00' WHEN 2 THEN '504B0304504B0304'
   WHEN 3 THEN '255044462D312E37' WHEN 4 THEN '526172211A0700' WHEN 5 THEN '1F8B08001F8B08FF' WHEN 6 THEN
     concat('4D5A', repeat('00', 58), '40000000', '50450000') ELSE '526172211A070100' END) AS d FROM documents)"""
SIGNATURE_SQL = (
    MARKED_SQL.replace(", digits", "WITH digits", 1)
    + """, magic AS (SELECT * FROM (VALUES ('89504E470D0A1A0A', 'png'), ('FFD8FF', 'jpeg'), ('504B0304', 'zip'), ('255044462D', 'pdf'), ('526172211A0700', 'rar4'),
     ('526172211A070100', 'rar5'), ('1F8B08', 'gzip'), ('4D5A', 'pe')) AS m(sig, format)),
   spots AS (SELECT doc_id, d, sig, format, unnest(list_filter(range(0, CAST(length(d) // 2 AS BIGINT)), lambda i: substr(d, 2 * i + 1, length(sig)) = sig)) AS o
     FROM digits JOIN magic ON contains(d, sig)),
   hits AS (SELECT doc_id, format, CAST(o AS INT) AS "offset" FROM spots WHERE CASE format
     WHEN 'gzip' THEN length(d) // 2 >= o + 4 AND substr(d, 2 * o + 7, 1) IN ('0', '1')
     WHEN 'pe' THEN length(d) // 2 >= o + 64 AND substr(d, 2 * (o + 60) + 1, 8) = '40000000' AND substr(d, 2 * (o + 64) + 1, 8) = '50450000' ELSE TRUE END) """
)


def marked(spark, sf):
    tail = F.expr(
        "CASE doc_id % 8 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '0AFFD8FF00' WHEN 2 THEN '504B0304504B0304' WHEN 3 THEN '255044462D312E37' "
        "WHEN 4 THEN '526172211A0700' WHEN 5 THEN '1F8B08001F8B08FF' WHEN 6 THEN concat('4D5A', repeat('00', 58), '40000000', '50450000') ELSE '526172211A070100' END"
    )
    return table(spark, sf, "documents").select("doc_id", F.unhex(F.concat(F.hex("text"), tail)).alias("data"))


@query("signature_hits", SIGNATURE_SQL + 'SELECT doc_id, format, "offset" FROM hits')
def _(spark, sf):
    return signatures.signature_hits(marked(spark, sf), "data").select("doc_id", "format", "offset")


@query(
    "signature_census",
    SIGNATURE_SQL
    + """SELECT format, CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER ("offset" > 0) AS BIGINT) AS with_prefix,
      min("offset") AS first_offset, max("offset") AS last_offset FROM hits GROUP BY format""",
)
def _(spark, sf):
    return signatures.signature_census(signatures.signature_hits(marked(spark, sf), "data"))


@query(
    "trailing_ranges",
    SIGNATURE_SQL
    + """, r AS (SELECT h.doc_id AS parent_id, h."offset" AS start, h."offset" + 4 AS "end", CAST(length(d) // 2 AS BIGINT) AS n FROM hits h JOIN digits USING (doc_id) WHERE format = 'zip')
    SELECT parent_id, start AS range_start, 'prefix-data' AS kind, CAST(0 AS BIGINT) AS start, CAST(start AS BIGINT) AS "end", CAST(start AS BIGINT) AS byte_length FROM r WHERE start > 0
    UNION ALL SELECT parent_id, start, 'trailing-data', CAST("end" AS BIGINT), n, n - "end" FROM r WHERE n > "end" """,
)
def _(spark, sf):
    data = marked(spark, sf)
    hits = signatures.signature_hits(data, "data").where("format = 'zip'")
    ranges = hits.select(F.col("doc_id").alias("parent_id"), F.col("offset").alias("start"), (F.col("offset") + 4).alias("end"))
    parents = data.select(F.col("doc_id").alias("parent_id"), F.octet_length("data").cast("long").alias("parent_length"))
    return content.trailing_ranges(ranges, parents)


NAMES_SQL = """, names AS (SELECT frame_number, source, destination, query_name, split_part(query_name, '.', 1) AS label FROM dns_queries),
 decoded AS (SELECT frame_number, source, destination, 'hex' AS encoding, lower(substr(query_name, length(label) + 2)) AS base_domain, label AS encoded_name, lower(label) AS chunk_hex,
    length(label) // 2 AS size FROM names WHERE length(label) >= 16 AND length(label) % 2 = 0 AND regexp_matches(label, '^[0-9A-Fa-f]+$')) """


@query("decode_query_names", NAMES_SQL + "SELECT frame_number, encoding, base_domain, encoded_name, chunk_hex FROM decoded", "dns_queries")
def _(spark, sf):
    rows = corpus.decode_query_names(view(spark, sf, "dns_queries"))
    return rows.select("frame_number", "encoding", "base_domain", "encoded_name", F.lower(F.hex("chunk")).alias("chunk_hex"))


RECOGNIZED_SQL = """, t AS (SELECT doc_id, trim(value) AS v FROM encoded_values),
 kinds AS (SELECT doc_id, v, CASE WHEN length(v) >= 8 AND length(v) % 2 = 0 AND regexp_matches(v, '^[0-9A-Fa-f]+$') THEN 'hex'
   WHEN length(v) >= 8 AND regexp_matches(v, '^[A-Za-z0-9+/]*={0,2}$') AND (regexp_matches(v, '[+/=]') OR length(v) % 4 = 0) THEN 'base64'
   WHEN length(v) >= 8 AND regexp_matches(v, '^[A-Za-z0-9_-]*={0,2}$') AND regexp_matches(v, '[-_]') THEN 'base64url' END AS transform FROM t) """


@query(
    "decode_recognized",
    RECOGNIZED_SQL + "SELECT doc_id, transform, CAST(length(v) // 2 AS INT) AS output_length, sha256(unhex(v)) AS output_hash FROM kinds WHERE transform = 'hex'",
    "encoded_values",
)
def _(spark, sf):
    rows = decode.decode_recognized(view(spark, sf, "encoded_values"))
    return rows.select("doc_id", "transform", F.octet_length("output").alias("output_length"), F.sha2("output", 256).alias("output_hash"))


CHAIN_SQL = (
    RECOGNIZED_SQL
    + """, one AS (SELECT doc_id AS owner, 1 AS depth, sha256(v) AS parent_hash, transform, unhex(v) AS output, decode(unhex(v)) AS text FROM kinds WHERE transform = 'hex'),
     two AS (SELECT owner, 2 AS depth, sha256(text) AS parent_hash, 'hex' AS transform, unhex(text) AS output FROM one
       WHERE length(text) >= 8 AND length(text) % 2 = 0 AND regexp_matches(text, '^[0-9A-Fa-f]+$'))
    SELECT owner, depth, parent_hash, transform, sha256(output) AS output_hash, CAST(octet_length(output) AS INT) AS output_length, 'decoded' AS status FROM one
    UNION ALL SELECT owner, depth, parent_hash, transform, """
)


@query("decode_chain", CHAIN_SQL + "sha256(output), CAST(octet_length(output) AS INT), 'decoded' FROM two", "encoded_values")
def _(spark, sf):
    return decode.decode_chain(view(spark, sf, "encoded_values"), "doc_id", "value").drop("output")


@query("decode_chain_limit", CHAIN_SQL + "NULL, NULL, 'depth-limit' FROM two", "encoded_values")
def _(spark, sf):
    return decode.decode_chain(view(spark, sf, "encoded_values"), "doc_id", "value", max_depth=1).drop("output")


def _candidate_sql(kind: str, score: str, cap: str, evidence: str, role: str, source: str) -> str:
    return (
        f"SELECT sha256(concat_ws(chr(31), 'candidate', {kind}, trim(value))) AS candidate_id, {kind} AS kind, trim(value) AS value, "
        f"CAST({score} AS DOUBLE) AS score, least({cap}::DOUBLE, CAST({score} AS DOUBLE) / 100) AS confidence, {evidence} AS evidence_id, '{role}' AS role FROM {source}"
    )


KNOWN_CANDIDATES = _candidate_sql("'flag'", "CASE WHEN prefix = 'flag' THEN 100 ELSE 95 END", "0.99", "concat_ws(':', doc_id, \"offset\")", "direct-match", "known")
UNKNOWN_CANDIDATES = _candidate_sql("'unknown-flag'", "CASE WHEN kind = 'unknown-brace' THEN 78 ELSE 45 END", "0.9", "CAST(doc_id AS VARCHAR)", "unknown-match", "unknown")
FIELD_SQL = """, fields AS (SELECT p.page_id AS tx_id, f.* FROM pages p, LATERAL (SELECT unnest([0, 1, 2]) AS ordinal, unnest(['email', 'password', 'captcha']) AS name,
    unnest([concat('u', p.page_id, '@x.test'), md5(CAST(p.page_id AS VARCHAR)), CAST(p.page_id % 97 AS VARCHAR)]) AS value) f WHERE p.page_id % 4 = 0),
 scored AS (SELECT tx_id, ordinal, name AS field_name, value, CASE WHEN name = 'password' THEN 'sensitive-field' ELSE 'context-field' END AS kind,
   CASE WHEN name = 'password' THEN 60 ELSE 10 END AS role_score, CASE WHEN length(value) >= 32 THEN 10 WHEN length(value) >= 8 THEN 5 ELSE 1 END AS length_score,
   CASE WHEN length(value) >= 16 AND length(value) % 2 = 0 AND regexp_matches(value, '^[0-9a-fA-F]+$') THEN 'hex'
     WHEN length(value) >= 8 AND length(value) % 4 = 0 AND regexp_matches(value, '^[A-Za-z0-9+/_-]+={0,2}$') THEN 'base64-like' ELSE 'plain' END AS shape FROM fields),
 totals AS (SELECT *, role_score + length_score + CASE shape WHEN 'hex' THEN 8 WHEN 'base64-like' THEN 6 ELSE 0 END + 2 AS score FROM scored) """


def scored_fields(spark, sf):
    return rank.score_fields(parameters.form_fields(view(spark, sf, "http_tx")))


@query("score_known", KNOWN_SQL + KNOWN_CANDIDATES, "evidence_text")
def _(spark, sf):
    return rank.score_known(known(spark, sf), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("offset").cast("string")))


@query("score_unknown", ", texts AS (SELECT doc_id, body FROM evidence_text)" + UNKNOWN_SQL + UNKNOWN_CANDIDATES, "evidence_text")
def _(spark, sf):
    return rank.score_unknown(unknown(spark, sf), F.col("doc_id"))


@query(
    "score_fields",
    FIELD_SQL.replace(", fields", "WITH fields", 1)
    + "SELECT tx_id, CAST(ordinal AS INT) AS ordinal, field_name, kind, shape, CAST(score AS DOUBLE) AS score FROM totals",
)
def _(spark, sf):
    return scored_fields(spark, sf).select("tx_id", "ordinal", "field_name", "kind", "shape", "score")


@query(
    "field_signals",
    FIELD_SQL.replace(", fields", "WITH fields", 1)
    + """SELECT tx_id, CAST(ordinal AS INT) AS ordinal, 'field-role' AS signal, CAST(role_score AS DOUBLE) AS contribution FROM totals
      UNION ALL SELECT tx_id, ordinal, 'printable', 2 FROM totals UNION ALL SELECT tx_id, ordinal, 'length', length_score FROM totals
      UNION ALL SELECT tx_id, ordinal, 'value-shape', CASE shape WHEN 'hex' THEN 8 WHEN 'base64-like' THEN 6 ELSE 0 END FROM totals""",
)
def _(spark, sf):
    return rank.field_signals(scored_fields(spark, sf)).drop("candidate_id")


MERGED_SQL = (
    KNOWN_SQL + ", texts AS (SELECT doc_id, body FROM evidence_text)" + UNKNOWN_SQL + FIELD_SQL
    + ", parts AS (" + KNOWN_CANDIDATES + " UNION ALL " + UNKNOWN_CANDIDATES + " UNION ALL "
    + _candidate_sql("kind", "score", "0.99", "concat_ws(':', tx_id, ordinal)", "structured-field", "totals")
    + """), merged AS (SELECT candidate_id, kind, value, max(score) AS score, round(max(confidence), 4) AS confidence,
       CAST(count(DISTINCT concat(evidence_id, '|', role)) AS BIGINT) AS evidence_links FROM parts GROUP BY 1, 2, 3) """
)


def merged(spark, sf):
    return rank.merge_candidates(
        rank.score_known(known(spark, sf), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("offset").cast("string"))),
        rank.score_unknown(unknown(spark, sf), F.col("doc_id")),
        rank.field_candidates(scored_fields(spark, sf)),
    )


@query("merge_candidates", MERGED_SQL + "SELECT * FROM merged", "evidence_text")
def _(spark, sf):
    return merged(spark, sf)[0].withColumn("confidence", F.round("confidence", 4))


@query("candidate_links", MERGED_SQL + "SELECT DISTINCT candidate_id, evidence_id, role FROM parts", "evidence_text")
def _(spark, sf):
    return merged(spark, sf)[1]


@query("candidates_page", MERGED_SQL + "SELECT candidate_id, kind, value, score FROM merged ORDER BY score DESC, candidate_id LIMIT 30 OFFSET 10", "evidence_text")
def _(spark, sf):
    return pages.candidates_page(merged(spark, sf)[0], 10, 30).select("candidate_id", "kind", "value", "score")


# A page of candidates with the first two evidence links of each.
@query(
    "candidates_with_evidence",
    MERGED_SQL
    + """, top AS (SELECT candidate_id, score FROM merged ORDER BY score DESC, candidate_id LIMIT 50), l AS (SELECT DISTINCT candidate_id, evidence_id, role FROM parts),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY role, evidence_id) AS rn FROM l)
    SELECT t.candidate_id, t.score, string_agg(r.evidence_id, ',' ORDER BY rn) FILTER (rn <= 2) AS evidence, CAST(count(*) AS BIGINT) AS evidence_total, count(*) > 2 AS evidence_truncated
    FROM top t JOIN r USING (candidate_id) GROUP BY 1, 2""",
    "evidence_text",
)
def _(spark, sf):
    rows, links = merged(spark, sf)
    top = pages.candidates_page(rows, 0, 50).select("candidate_id", "score")
    shown = pages.nested(top, links, "candidate_id", ["role", "evidence_id"], "evidence", 2)
    return shown.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), ","))


@query(
    "current_inputs",
    """SELECT DISTINCT 'http-body' AS source_kind, CAST(page_id AS VARCHAR) AS source_id, sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS byte_length FROM pages WHERE page_id % 13 <> 0
    UNION SELECT DISTINCT 'document', CAST(doc_id AS VARCHAR), sha256(text), CAST(strlen(text) AS BIGINT) FROM documents
    UNION SELECT DISTINCT 'tcp-stream', CAST(conv_id AS VARCHAR), sha256(text), CAST(strlen(text) AS BIGINT) FROM conversations""",
)
def _(spark, sf):
    def rows(df, kind, owner, value):
        text = F.col(value)
        return df.select(
            F.lit(kind).alias("source_kind"), F.col(owner).cast("string").alias("source_id"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("content_hash"), F.octet_length(text).cast("long").alias("byte_length"),
        )

    bodies = content.classify_body(view(spark, sf, "http_tx")).where("extracted_length > 0").select("tx_id")
    saved = table(spark, sf, "pages").join(bodies, F.col("page_id") == F.col("tx_id"), "left_semi")
    return rank.current_inputs(
        rows(saved, "http-body", "page_id", "html"),
        rows(table(spark, sf, "documents"), "document", "doc_id", "text"),
        rows(table(spark, sf, "conversations"), "tcp-stream", "conv_id", "text"),
    )
