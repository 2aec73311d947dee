"""Records of rebuilt streams against a byte-by-byte reading, whatever the chunks and windows."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import terminal


def by_bytes(data: bytes, bounds: set[int], limit: int):
    """One byte after the other, with the pending record held."""
    out, start, held = [], 0, b""

    def emit(label):
        nonlocal start, held
        if held:
            out.append((start, start + len(held), label))
            start, held = start + len(held), b""

    for place, value in enumerate(data):
        one = bytes([value])
        if held.endswith(b"\r"):
            if value in (0, 10):
                held += one
                emit("line")
                continue
            emit("line")
        if value < 32 and value not in (10, 13):
            emit("text")
            held = one
            emit("control")
        else:
            held += one
            if value == 10:
                emit("line")
            elif len(held) >= limit:
                emit("bounded")
        if place + 1 in bounds and held.rstrip(b" \t").endswith(b":"):
            emit("prompt")
    emit("line" if held.endswith(b"\r") else "text")
    return out


def streams():
    rng = random.Random(11)
    texts = [b"", b":", b"\r", b"\n", b"login:", b"login:" + b" " * 40, b"\r\0\r\n\0\r\r\n", b"x" * 64, b"x" * 7 + b"\r\n", b"x" * 8 + b"\r\0"]
    for k in range(40):
        letters = [b"ab: \t\r\n\0\x07\xff", b"abcdefg:  ", b"a:", b"x \r"][k % 4]
        texts.append(bytes(rng.choice(letters) for _ in range(rng.randrange(1, 300))))
    out = []
    for k, t in enumerate(texts):
        bounds = {p for p in range(1, len(t) + 1) if rng.random() < 0.3} | {len(t)}
        out.append((k, t, bounds))
    return out


@pytest.mark.parametrize(("chunk", "window", "limit", "fan"), [(1, 8, 8, 2), (7, 5, 8, 3), (64, 32, 2, 4), (13, 65_536, 16, 1024), (5, 3, 40, 2)])
def test_records_of_any_block(spark, monkeypatch, chunk, window, limit, fan):
    monkeypatch.setattr(terminal, "FAN_IN", fan)
    given = streams()
    chunks = spark.createDataFrame(
        [(1, k, i, bytearray(t[i * chunk : (i + 1) * chunk])) for k, t, _ in given for i in range(-(-len(t) // chunk))], "c int, s int, n long, data binary")
    ends = spark.createDataFrame([(1, k, p) for k, _, b in given for p in b], "c int, s int, at long")
    rows = terminal.stream_records(chunks, ["c", "s"], "n", "data", ends, limit, window)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["s"], r["ordinal"])):
        assert r["ordinal"] == len(got.setdefault(r["s"], []))
        got[r["s"]].append((r["start"], r["end"], r["label"]))
    for k, t, bounds in given:
        assert got.get(k, []) == by_bytes(t, bounds, limit), (k, t, sorted(bounds))
    if chunk == 13:
        values = terminal.record_bytes(rows, chunks, ["c", "s"], "n", "data", limit, 20).collect()
        assert len(values) == sum(map(len, got.values()))
        assert all(bytes(r["value"]) == given[r["s"]][1][r["start"] : r["end"]] for r in values)


@pytest.mark.parametrize(("window", "limit", "fan", "rows", "step"), [(4, 8, 3, 3, 2), (2, 5, 2, 7, 3), (6, 40, 4, 1, 256)])
def test_starts_are_walked_in_order_without_a_group_for_each_stream(spark, monkeypatch, window, limit, fan, rows, step):
    monkeypatch.setattr(terminal, "FAN_IN", fan)
    monkeypatch.setattr(terminal, "STEP_ROWS", step)
    plans = []
    real = terminal.cut
    monkeypatch.setattr(terminal, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    given = streams()
    chunks = spark.createDataFrame([(k, 0, bytearray(t)) for k, t, _ in given if t], "s int, n long, data binary")
    ends = spark.createDataFrame([(k, p) for k, _, b in given for p in b], "s int, at long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = terminal.stream_records(chunks, ["s"], "n", "data", ends, limit, window).orderBy("s", "ordinal").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [(k, i, *r) for k, t, b in given for i, r in enumerate(by_bytes(t, b, limit))]
    assert [tuple(r) for r in found] == expected
    # Tasks walk sorted rows; a Python group for each stream and block would cost more than the work in it.
    assert any("MapInArrow" in plan for plan in plans) and not any("GroupsInArrow" in plan for plan in plans)


def test_without_sources_there_are_no_prompts(spark):
    chunks = spark.createDataFrame([(1, 0, "name: "), (1, 1, "x\r\nend:")], "s int, n long, data string")
    rows = terminal.stream_records(chunks, ["s"], "n", "data").orderBy("start").collect()
    assert [(r["start"], r["end"], r["label"]) for r in rows] == [(0, 9, "line"), (9, 13, "text")]
    assert terminal.stream_records(chunks.where("s > 1"), ["s"], "n", "data").collect() == []


def test_sources_of_records(spark):
    records = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 6), (1, 2, 6, 20)], "s int, ordinal long, start long, end long")
    spans = spark.createDataFrame([(1, 7, 100, 105, 0), (1, 9, 110, 113, 5), (1, 8, 113, 125, 8)], "s int, frame_number long, start long, end long, output_offset long")
    rows = terminal.record_sources(records, spans, ["s"]).orderBy("stream_offset").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 7, 0, 0, 5), (1, 9, 0, 5, 1), (2, 9, 0, 6, 2), (2, 8, 2, 8, 12)]
    named = records.groupBy("s").agg(F.max("end").alias("size")).collect()
    assert sum(r["byte_length"] for r in rows) == named[0]["size"]
