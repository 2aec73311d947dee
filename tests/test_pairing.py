import pytest

from packetloom.operators import pairing, records

MESSAGE = "capture_id int, stream_index long, frame_number long, kind string, request_in_frame long, response_in_frame long"


def test_pairs_by_either_reference(spark):
    messages = spark.createDataFrame(
        [(1, 1, 1, "request", None, 4), (1, 1, 2, "request", None, None), (1, 1, 3, "response", 1, None), (1, 1, 4, "response", None, None), (1, 1, 5, "response", 99, None)],
        MESSAGE,
    )
    rows = {(r.request_frame, r.response_frame): (r.status, r.role, r.ordinal) for r in pairing.pair_transactions(messages).collect()}
    assert rows == {
        (1, 3): ("matched", "response", 0), (1, 4): ("matched", "extra_response", 1),
        (2, None): ("unmatched-request", "request", 0), (None, 5): ("orphan-response", "response", 0),
    }
    tx = {r.status: r.extra_responses for r in pairing.transactions(pairing.pair_transactions(messages)).collect()}
    assert tx["matched"] == 1


def test_fifo(spark):
    rows = spark.createDataFrame(
        [(1, 1, False, True), (1, 2, True, False), (1, 3, True, False), (1, 4, False, True), (1, 5, True, True), (1, 6, False, True), (1, 7, False, True), (1, 8, True, False)],
        "s int, frame_number long, starts boolean, completes boolean",
    )
    found = {(r.start_frame, r.end_frame, r.status) for r in pairing.fifo_pair(rows, ["s"]).collect()}
    assert found == {(None, 1, "unmatched"), (2, 4, "matched"), (3, 5, "matched"), (5, 6, "matched"), (None, 7, "unmatched"), (8, None, "incomplete")}


def test_asof_takes_latest_opening(spark):
    rows = spark.createDataFrame([(1, "r", 5), (2, "r", 9), (3, "r", 4), (4, "q", 9)], "id int, route string, p long")
    opens = spark.createDataFrame([("r", 5, "a"), ("r", 8, "b")], "route string, at long, name string")
    assert {r.id: r.name for r in pairing.assign_asof(rows, opens, ["route"], "p", "at", "name").collect()} == {1: "a", 2: "b", 3: None, 4: None}


RECORD = "capture_id int, dialogue_id int, record_id long, side string, label string, body string"


def test_prompts_and_echoes(spark):
    df = spark.createDataFrame(
        [
            (1, 1, 1, "server", "prompt:login", "login:"), (1, 1, 2, "client", "text", "ad"), (1, 1, 3, "server", "text", "ad"),
            (1, 1, 4, "client", "line", "admin"), (1, 1, 5, "client", "line", "again"), (1, 1, 6, "server", "prompt:password", "Password:"),
            (1, 1, 7, "server", "line", "denied"), (1, 1, 8, "client", "line", "x"),
        ],
        RECORD,
    )
    assert [(r.record_id, r.related_id) for r in pairing.prompt_responses(df).collect()] == [(4, 1)]
    assert [(r.record_id, r.related_id) for r in pairing.echo_links(df).collect()] == [(3, 2)]


def test_echo_depth(spark):
    rows = [(1, 1, 0, "client", "line", "old")] + [(1, 1, i, "client", "line", f"c{i}") for i in range(1, 17)] + [(1, 1, 20, "server", "line", "old"), (1, 1, 21, "server", "line", "c1")]
    assert [(r.record_id, r.related_id) for r in pairing.echo_links(spark.createDataFrame(rows, RECORD)).collect()] == [(21, 1)]


def test_unique_parts(spark):
    parts = spark.createDataFrame([(1, 1, 1, "image/png"), (1, 2, 2, "image/png"), (1, 2, 3, "text/plain"), (1, 4, 4, "TEXT/plain")], "capture_id int, message_id int, part_id long, declared_type string")
    artifacts = spark.createDataFrame([(1, 1, 7, "application/zip"), (1, 2, 8, "image/png"), (1, 4, 9, "text/plain")], "capture_id int, message_id int, artifact_id long, detected_type string")
    correlated = pairing.correlate_parts(parts, artifacts)
    assert {r.part_id: r.role for r in correlated.collect()} == {1: "type-mismatch", 2: "unresolved", 3: "unresolved", 4: "matched"}
    assert pairing.mismatch_findings(correlated).count() == 1


def test_records_cover_the_text(spark):
    text = "one\r\ntwo\rthree\n\x07four\r\x00abcdefghijk tail Password: "
    df = spark.createDataFrame([(1, "server", text)], "id int, side string, t string")
    rows = records.segment_records(df, "t", "side", 8).orderBy("offset").collect()
    assert "".join(r.value for r in rows) == text
    assert [r.label for r in rows][:7] == ["line", "line", "line", "control", "line", "bounded", "bounded"]
    assert rows[-1].label in ("prompt", "bounded")
    whole = records.segment_records(spark.createDataFrame([(1, "server", "User Name: "), (2, "client", "x: ")], "id int, side string, t string"), "t", "side").collect()
    assert {(r.id, r.label, r.prompt) for r in whole} == {(1, "prompt", "name"), (2, "text", None)}


def _blocks(spark, chunks, window=records.WINDOW):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "s int, o long, t string")
    rows = records.extract_data_blocks(df, ["s"], "o", "t", window).orderBy("start").collect()
    data = "".join(chunks).encode()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    return [(data[r.start : r.end].decode(), r.status) for r in rows]


def test_data_blocks(spark):
    done, left = "complete", "incomplete"
    assert _blocks(spark, ["DATA\r\nhello\r\nDATA\r\nmore\r\n.\r\nQUIT\r\n", "\r\nDATA\r\nlast\r\n.\r\n"]) == [("hello\r\nDATA\r\nmore\r\n", done), ("last\r\n", done)]
    assert _blocks(spark, ["DATA\r\n", "hello there you", "\r\n", ".", "\r\n"]) == [("hello there you\r\n", done)]
    assert _blocks(spark, ["no data\r\n.\r\nDATA\r\nnever closed"]) == [("never closed", left)]
    # A dot right after a DATA line ends no block that this line opens, but one that is open.
    assert _blocks(spark, ["DATA\r\n.\r\nDATA\r\n.\r\nDATA\r\nx\r\n.\r\n"]) == [(".\r\nDATA\r\n", done), ("x\r\n", done)]


MAIL = "EHLO ü\r\nDATA\r\n..één\r\n..\r\nmore|.. and\r\n.x\r\n.\r\nDATA\r\n...two\n..three\r\n.\r\n250 ok\r\ndata\r\n..open"


@pytest.mark.parametrize(("size", "window"), [(1, 16), (3, 8), (1000, 32), (2, 4096)])
def test_blocks_depend_on_neither_chunks_nor_windows(spark, size, window):
    chunks = [MAIL[i : i + size] for i in range(0, len(MAIL), size)]
    assert [s for _, s in _blocks(spark, chunks, window)] == ["complete", "complete", "incomplete"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "s int, o long, t string")
    pieces = records.block_text(records.extract_data_blocks(df, ["s"], "o", "t", window), df, ["s"], "o", "t", window).collect()
    whole = {n: b"".join(bytes(r.piece) for r in sorted(pieces, key=lambda r: r.piece_start) if r.ordinal == n).decode() for n in range(3)}
    assert whole == {0: ".één\r\n.\r\nmore|.. and\r\n.x\r\n", 1: "..two\n.three\r\n", 2: ".open"}


def test_transfer_sessions(spark):
    schema = (
        "capture_id int, frame_number long, source string, destination string, source_port int, destination_port int, opcode int, source_file string, destination_file string, "
        "mode string, request_frame long, error_code int, error_message string, option_name string, option_value string"
    )
    packets = spark.createDataFrame(
        [
            (1, 1, "c", "s", 5000, 69, 1, "", None, None, None, None, None, None, None),
            (1, 2, "s", "c", 3001, 5000, 6, None, None, None, 1, None, None, "blksize", "1024"),
            (1, 3, "s", "c", 3002, 5000, 3, None, None, None, 1, None, None, "blksize", "4"),
            (1, 4, "s", "c", 3002, 5000, 5, None, None, None, 1, 2, "denied", None, None),
            (1, 5, "c", "s", 5001, 69, 2, None, "up.bin", "netascii", None, None, None, None, None),
        ],
        schema,
    )
    rows = {r.request_frame: r for r in pairing.transfer_sessions(packets).collect()}
    assert (rows[1].filename, rows[1].server_port, rows[1].response_frame, rows[1].error_code, rows[1].block_size) == ("tftp-frame-1.bin", 3002, 2, 2, 1024)
    assert (rows[5].filename, rows[5].mode, rows[5].block_size) == ("up.bin", "netascii", 512)
