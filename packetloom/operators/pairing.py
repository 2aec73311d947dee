"""Joins that pair, correlate and link captured records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import last_value, running_count, running_max, running_peak, scan, spread_join
from packetloom.session import cut


def pair_transactions(messages: DataFrame) -> DataFrame:
    """Pair requests with responses by the references either side carries, never by time.

    The either-way condition is two equi-joins on frame numbers, each one-to-one or one-to-many on a
    unique frame, so no key is hot.  Rows: one per (request, response) pair, one per request without a
    response, one per response without a request.
    """
    requests = messages.where("kind = 'request'").select(
        "capture_id", "stream_index", F.col("frame_number").alias("request_frame"), "response_in_frame"
    )
    responses = messages.where("kind = 'response'").select(
        "capture_id", F.col("stream_index").alias("response_stream"), F.col("frame_number").alias("response_frame"), "request_in_frame"
    )
    heads = requests.select("capture_id", "request_frame", "stream_index")
    named = responses.where("request_in_frame IS NOT NULL").select(
        "capture_id", F.col("request_in_frame").alias("request_frame"), "response_frame"
    )
    by_response = heads.join(named, ["capture_id", "request_frame"])
    by_request = requests.where("response_in_frame IS NOT NULL").select(
        "capture_id", "request_frame", "stream_index", F.col("response_in_frame").alias("response_frame")
    ).join(responses.select("capture_id", "response_frame"), ["capture_id", "response_frame"])
    # Three narrow columns that four branches read.
    links = cut(by_response.unionByName(by_request).dropDuplicates(["capture_id", "request_frame", "response_frame"]))

    # Responses of one request in frame order.  A request that a third of all responses name would make
    # one window too large, so the order is counted with a scan over response frames.
    ordered = scan(links, ["capture_id", "request_frame"], "response_frame", {"ordinal": running_count(inclusive=False)})
    paired = ordered.select(
        "capture_id", "stream_index", "request_frame", "response_frame", F.lit("matched").alias("status"),
        F.when(F.col("ordinal") == 0, "response").otherwise("extra_response").alias("role"), "ordinal",
    )
    lonely = heads.join(links, ["capture_id", "request_frame"], "left_anti").select(
        "capture_id", "stream_index", "request_frame", F.lit(None).cast("long").alias("response_frame"),
        F.lit("unmatched-request").alias("status"), F.lit("request").alias("role"), F.lit(0).cast("long").alias("ordinal"),
    )
    orphans = responses.join(links.select("capture_id", "response_frame").distinct(), ["capture_id", "response_frame"], "left_anti").select(
        "capture_id", F.col("response_stream").alias("stream_index"), F.lit(None).cast("long").alias("request_frame"), "response_frame",
        F.lit("orphan-response").alias("status"), F.lit("response").alias("role"), F.lit(0).cast("long").alias("ordinal"),
    )
    return paired.unionByName(lonely).unionByName(orphans)


def transactions(pairs: DataFrame) -> DataFrame:
    """One row per transaction: the first response is the primary one, the others are counted."""
    grouped = pairs.groupBy("capture_id", "stream_index", "status", "request_frame", F.when(F.col("request_frame").isNull(), F.col("response_frame")).alias("__orphan"))
    return grouped.agg(
        F.min("response_frame").alias("response_frame"),
        F.count(F.when(F.col("role") == "extra_response", 1)).alias("extra_responses"),
    ).drop("__orphan")


def transaction_summary(tx: DataFrame, keys: Sequence[str] = ("capture_id", "status")) -> DataFrame:
    return tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("transactions"))


def transaction_counts(messages: DataFrame, tx: DataFrame, uris: DataFrame, uri: str) -> DataFrame:
    """What a capture holds: ``(capture_id, measure, name, amount)`` for messages by kind, transactions by status, and the
    transactions whose request has exactly this URI (zero where there is none).

    ``uris(capture_id, frame_number, uri)`` names the requests' URIs; a request without one counts for no URI.
    """
    amount = F.count(F.lit(1)).alias("amount")

    def counted(df: DataFrame, measure: str, name: str) -> DataFrame:
        return df.groupBy("capture_id", F.col(name).alias("name")).agg(amount).select("capture_id", F.lit(measure).alias("measure"), "name", "amount")

    wanted = uris.where(F.col("uri") == uri).select("capture_id", F.col("frame_number").alias("request_frame")).distinct()
    matching = tx.join(wanted, ["capture_id", "request_frame"], "left_semi").groupBy("capture_id").agg(amount)
    asked = messages.select("capture_id").distinct().join(matching, "capture_id", "left").select(
        "capture_id", F.lit("uri").alias("measure"), F.lit(uri).alias("name"), F.coalesce("amount", F.lit(0)).alias("amount"))
    return counted(messages, "messages", "kind").unionByName(counted(tx, "transactions", "status")).unionByName(asked)


def select_body_targets(pairs: DataFrame, uris: DataFrame, uri: str | None = None) -> DataFrame:
    """Message frames whose bodies are wanted: all messages of transactions with the given request URI."""
    wanted = uris if uri is None else uris.where(F.col("uri") == uri)
    chosen = pairs.join(wanted.select("capture_id", "request_frame").distinct(), ["capture_id", "request_frame"], "left_semi")
    frames = F.array(
        F.struct(F.col("request_frame").alias("frame_number"), F.lit("request").alias("kind")),
        F.struct(F.col("response_frame").alias("frame_number"), F.lit("response").alias("kind")),
    )
    return (
        chosen.select("capture_id", F.explode(frames).alias("m"))
        .select("capture_id", "m.frame_number", "m.kind")
        .where("frame_number IS NOT NULL")
        .distinct()
    )


def correlate_transfers(control: DataFrame, data: DataFrame) -> DataFrame:
    """Data rows grouped by the setup and command frames they name; rows that name none stay single."""
    alone = F.when(F.col("setup_frame").isNull() | F.col("command_frame").isNull(), F.col("frame_number"))
    keys = ["capture_id", "stream_index", "direction", "setup_frame", "command_frame", "unresolved_frame"]
    grouped = data.withColumn("unresolved_frame", alone).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_rows"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame")
    )
    lookup = control.select("capture_id", "frame_number", "command", "argument")
    setup = lookup.select("capture_id", F.col("frame_number").alias("setup_frame"), F.lit(True).alias("has_setup"))
    command = lookup.select(
        "capture_id", F.col("frame_number").alias("command_frame"), "command", "argument", F.lit(True).alias("has_command")
    )
    joined = _lookup(_lookup(grouped, setup, "setup_frame"), command, "command_frame")
    status = F.when(F.col("has_setup").isNull() | F.col("has_command").isNull(), "unresolved").otherwise("indexed")
    return joined.select(*keys, "command", "argument", "data_rows", "first_frame", "last_frame", status.alias("status"))


def _lookup(df: DataFrame, small: DataFrame, frame: str) -> DataFrame:
    """Left join on a frame reference.  Rows without a reference stay out of the shuffle."""
    named = df.where(F.col(frame).isNotNull()).join(small, ["capture_id", frame], "left")
    return named.unionByName(df.where(F.col(frame).isNull()), allowMissingColumns=True)


def fifo_pair(rows: DataFrame, keys: Sequence[str], position: str = "frame_number") -> DataFrame:
    """k-th start of a key with its k-th completion; a completion with nothing open is unmatched.

    ``starts`` and ``completes`` are flags; a row with both counts as a start first.  With
    ``d = completions - starts`` up to a row, the unmatched completions up to it are ``max(0, running max of
    d at completions)``, so a completion's rank is its count less that number.
    """
    keys = list(keys)
    completes = F.col("completes")
    deficit = completes.cast("int") - F.col("starts").cast("int")
    lost = scan(
        rows, keys, position,
        {
            "__s": running_count(F.col("starts")),
            "__c": running_count(completes),
            "__lost": running_peak(deficit, completes),
            "__lost_before": running_peak(deficit, completes, inclusive=False),
        },
    )
    after = F.greatest(F.coalesce(F.col("__lost"), F.lit(0)), F.lit(0))
    before = F.greatest(F.coalesce(F.col("__lost_before"), F.lit(0)), F.lit(0))
    matched = lost.where("completes").select(
        *keys, F.col(position).alias("end_frame"),
        F.when(after == before, F.col("__c") - after).alias("rank"),
    )
    starts = lost.where("starts").select(*keys, F.col(position).alias("start_frame"), F.col("__s").alias("rank"))
    joined = starts.join(matched.where("rank IS NOT NULL"), [*keys, "rank"], "left").select(
        *keys, "rank", "start_frame", "end_frame",
        F.when(F.col("end_frame").isNull(), "incomplete").otherwise("matched").alias("status"),
    )
    unmatched = matched.where("rank IS NULL").select(
        *keys, "rank", F.lit(None).cast("long").alias("start_frame"), "end_frame", F.lit("unmatched").alias("status")
    )
    return joined.unionByName(unmatched)


def assign_asof(
    rows: DataFrame, openings: DataFrame, keys: Sequence[str], position: str, opened_at: str, opening_id: str
) -> DataFrame:
    """Latest opening at or before each row of the same key: one ordered scan over the union of both."""
    left = rows.select("*", F.lit(1).alias("__side"), F.lit(None).cast(openings.schema[opening_id].dataType).alias("__open"))
    right = openings.select(*keys, F.col(opened_at).alias(position), F.lit(0).alias("__side"), F.col(opening_id).alias("__open"))
    both = left.unionByName(right, allowMissingColumns=True)
    filled = scan(both, keys, position, {"__found": last_value(F.col("__open"), inclusive=True)}, ties=["__side"])
    return filled.where("__side = 1").select(*rows.columns, F.col("__found").alias(opening_id))


def pair_echo(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Reply frame of each echo request; of several replies naming one request the last wins."""
    last = replies.where("response_to IS NOT NULL").groupBy("capture_id", F.col("response_to").alias("frame_number")).agg(
        F.max("frame_number").alias("reply_frame")
    )
    return requests.join(last, ["capture_id", "frame_number"], "left")


def prompt_responses(records: DataFrame) -> DataFrame:
    """Client lines that answer the prompt still pending when they are sent.

    A prompt is pending until a client line uses it or a server record that is not an echo clears it, so
    a line answers exactly when the latest earlier marker is a prompt.
    """
    echoed = echo_flags(records)
    prompt = (F.col("side") == "server") & F.startswith(F.col("label"), F.lit("prompt"))
    clears = (F.col("side") == "server") & ~F.col("is_echo")
    uses = (F.col("side") == "client") & (F.col("label") == "line")
    marker = F.when(prompt, F.struct(F.lit(True).alias("open"), F.col("record_id").alias("id"))).when(
        clears | uses, F.struct(F.lit(False).alias("open"), F.col("record_id").alias("id"))
    )
    marked = scan(echoed, ["capture_id", "dialogue_id"], "record_id", {"__marker": last_value(marker)})
    return marked.where(uses & F.col("__marker.open")).select(
        "capture_id", "dialogue_id", "record_id", F.col("__marker.id").alias("related_id"), F.lit("responds-to").alias("relation")
    )


ECHO_DEPTH = 16


def echo_flags(records: DataFrame, depth: int = ECHO_DEPTH) -> DataFrame:
    """Latest equal client record of each server record, if it is among the last ``depth`` client records.

    The latest equal one is found per (dialogue, body) with a scan, not by joining equal bodies, so a body
    that is repeated many times gives no pairs.
    """
    client = F.col("side") == "client"
    narrow = records.select(
        "capture_id", "dialogue_id", "record_id", "side", "label",
        F.sha2(F.encode(F.coalesce("body", F.lit("")), "UTF-8"), 256).alias("__body"),
    )
    numbered = scan(narrow, ["capture_id", "dialogue_id"], "record_id", {"__clients": running_count(client)})
    found = scan(
        numbered, ["capture_id", "dialogue_id", "__body"], "record_id",
        {"__echo": last_value(F.when(client, F.struct(F.col("record_id").alias("id"), F.col("__clients").alias("n"))))},
    )
    tested = (F.col("side") == "server") & ~F.startswith(F.col("label"), F.lit("prompt"))
    recent = tested & F.col("__echo").isNotNull() & (F.col("__clients") - F.col("__echo.n") < depth)
    return found.select(
        "capture_id", "dialogue_id", "record_id", "side", "label",
        F.coalesce(recent, F.lit(False)).alias("is_echo"), F.when(recent, F.col("__echo.id")).alias("echo_of"),
    )


def echo_links(records: DataFrame) -> DataFrame:
    return echo_flags(records).where("is_echo").select(
        "capture_id", "dialogue_id", "record_id", F.col("echo_of").alias("related_id"), F.lit("echo-of").alias("relation")
    )


def correlate_parts(parts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Link a part to an artifact only when its message has one of each; other parts stay unresolved.

    Counts come from aggregates, so a message with very many parts is never gathered.
    """
    part_counts = parts.groupBy("capture_id", "message_id").agg(F.count(F.lit(1)).alias("part_count"))
    found = artifacts.groupBy("capture_id", "message_id").agg(
        F.count(F.lit(1)).alias("artifact_count"), F.min("artifact_id").alias("artifact_id"), F.min("detected_type").alias("detected_type")
    )
    counts = part_counts.join(found, ["capture_id", "message_id"], "left").withColumn(
        "artifact_count", F.coalesce("artifact_count", F.lit(0).cast("long"))
    )
    joined = spread_join(parts, counts, ["capture_id", "message_id"], "part_id", "inner")
    single = (F.col("part_count") == 1) & (F.col("artifact_count") == 1)
    declared = F.lower("declared_type")
    detected = F.lower("detected_type")
    differs = (F.coalesce(declared, F.lit("")) != "") & (F.coalesce(detected, F.lit("")) != "") & (declared != detected)
    return joined.select(
        "capture_id", "message_id", "part_id", "part_count", "artifact_count",
        F.when(single, F.col("artifact_id")).alias("artifact_id"),
        F.when(~single, "unresolved").when(differs, "type-mismatch").otherwise("matched").alias("role"),
    )


def mismatch_findings(correlated: DataFrame) -> DataFrame:
    return correlated.where("role = 'type-mismatch'").select(
        "capture_id", "message_id", "part_id", "artifact_id",
        F.lit("declared-actual-type-mismatch").alias("detector"), F.lit("medium").alias("severity"), F.lit(0.95).alias("confidence"),
    )


# Fixed pattern: words that report success.
SUCCESS = "(?i)\\b(?:upload(?:ed)?[ \\t_-]+success(?:ful(?:ly)?)?|success(?:ful(?:ly)?)?)\\b"


def contradictions(tx: DataFrame, max_body_bytes: int | None = None) -> DataFrame:
    """Server errors whose complete body reports success; incomplete bodies are listed as skipped.

    Expects ``body_status`` from ``classify_body``.
    """
    errors = tx.where("response_code BETWEEN 500 AND 599")
    whole = (F.col("body_status") == "complete") & F.col("response_body").isNotNull()
    if max_body_bytes is not None:
        whole = whole & (F.octet_length("response_body") <= max_body_bytes)
    phrase = F.regexp_extract("response_body", SUCCESS, 0)
    before = F.element_at(F.split("response_body", SUCCESS, 2), 1)
    hit = whole & (phrase != "")
    return errors.where(~F.coalesce(whole, F.lit(False)) | hit).select(
        "capture_id", "tx_id", "response_frame", "response_code",
        F.when(hit, "contradiction").otherwise("skipped-incomplete").alias("outcome"),
        F.when(hit, F.octet_length(before)).alias("offset"),
        F.when(hit, phrase).alias("phrase"),
        F.when(hit, F.lit(0.95)).alias("confidence"),
        F.when(hit, F.lit("high")).alias("severity"),
    )


def overlap_join(
    ranges: DataFrame, spans: DataFrame, keys: Sequence[str], bucket_bytes: int = 65_536
) -> DataFrame:
    """Pairs of half-open ranges of the same key that overlap.

    Both sides are cut at bucket borders, so the join is an equality on (key, bucket) and a long stream
    is spread over its buckets; a pair is kept only in the first bucket both sides touch.
    ``ranges(start, end)`` and ``spans(span_start, span_end)``.
    """

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / bucket_bytes), F.floor((high - 1) / bucket_bytes)))

    left = ranges.where("end > start").select("*", buckets(F.col("start"), F.col("end")).alias("__bucket"))
    right = spans.where("span_end > span_start").select("*", buckets(F.col("span_start"), F.col("span_end")).alias("__bucket"))
    joined = left.join(right, [*keys, "__bucket"]).where("span_start < end AND span_end > start")
    first_common = F.floor(F.greatest("start", "span_start") / bucket_bytes)
    return joined.where(F.col("__bucket") == first_common).drop("__bucket")


def contributing_frames(matches: DataFrame, spans: DataFrame, keys: Sequence[str], match_id: str) -> DataFrame:
    """Frames whose bytes make up each match of a rebuilt stream."""
    pairs = overlap_join(matches, spans, keys)
    return pairs.select(*keys, match_id, "frame_number").distinct()


def covers_stream(spans: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the spans of a key run without a gap from zero to its total.

    ``spans(start, end)`` and ``totals(total)``.
    """
    reach = scan(spans, keys, "start", {"__reach": running_max(F.col("end"), inclusive=False)}, ties=["end"])
    checked = reach.groupBy(*keys).agg(
        F.bool_and(F.col("start") <= F.coalesce("__reach", F.lit(0))).alias("contiguous"), F.max("end").alias("reached")
    )
    return totals.join(checked, list(keys), "left").select(
        *keys, "total", F.coalesce(F.col("reached"), F.lit(0)).alias("reached"),
        F.coalesce(F.col("contiguous") & (F.col("reached") == F.col("total")), F.col("total") == 0).alias("covers"),
    )


def transfer_sessions(packets: DataFrame) -> DataFrame:
    """Block transfers opened by a read or write request to the service port, with what later packets add.

    Later packets name the request frame they belong to: the server's last port, its first answer, the
    last error and the last block size within the allowed range.
    """
    opened = packets.where("opcode IN (1, 2) AND destination_port = 69")
    filename = F.when(F.col("opcode") == 1, F.col("source_file")).otherwise(F.col("destination_file"))
    heads = opened.select(
        "capture_id", F.col("frame_number").alias("request_frame"), "opcode",
        F.coalesce(F.nullif(filename, F.lit("")), F.concat(F.lit("tftp-frame-"), F.col("frame_number"), F.lit(".bin"))).alias("filename"),
        F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit("octet")).alias("mode"),
        F.col("source").alias("client"), F.col("source_port").alias("client_port"), F.col("destination").alias("server"),
    )
    named = packets.where("request_frame IS NOT NULL AND NOT (opcode IN (1, 2) AND destination_port = 69)")
    routes = heads.select("capture_id", "request_frame", "client", "server")
    later = spread_join(named, routes, ["capture_id", "request_frame"], "frame_number", "inner").where(
        "frame_number > request_frame"
    )
    from_server = (F.col("source") == F.col("server")) & (F.col("destination") == F.col("client"))
    frame = F.col("frame_number")
    size = F.when(F.lower("option_name") == "blksize", F.try_to_number(F.col("option_value"), F.lit("99999"))).cast("int")
    facts = later.groupBy("capture_id", "request_frame").agg(
        F.max_by("source_port", F.when(from_server, frame)).alias("server_port"),
        F.min(F.when(from_server, frame)).alias("response_frame"),
        F.max_by("error_code", F.when(F.col("error_code").isNotNull(), frame)).alias("error_code"),
        F.max_by("error_message", F.when(F.col("error_code").isNotNull(), frame)).alias("error_message"),
        F.max_by(size, F.when(size.between(8, 65464), frame)).alias("block_size"),
    )
    return heads.join(facts, ["capture_id", "request_frame"], "left").withColumn(
        "block_size", F.coalesce("block_size", F.lit(512))
    )
