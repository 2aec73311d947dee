import random

from packetloom.operators import sequence


def _unwrap(numbers, modulus=65_536):
    half = modulus // 2
    high, out = numbers[0], []
    for n in numbers:
        value = high + (n - high + half) % modulus - half
        out.append(value)
        high = max(high, value)
    return out


def test_wrap_keeps_order(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([65534, 65535, 0, 1, 65535])], "k int, p long, seq int")
    rows = sequence.unwrap_seq(df, ["k"], "p").orderBy("p").collect()
    assert [r.extended for r in rows] == [65534, 65535, 65536, 65537, 65535]


def test_stray_jumps_equal_fold(spark, monkeypatch):
    rng = random.Random(5)
    data = {1: [rng.randrange(65_536) for _ in range(300)], 2: [(60_000 + i * 40) % 65_536 for i in range(300)]}
    monkeypatch.setattr(sequence, "span_of", lambda position, span=0: __import__("pyspark.sql.functions", fromlist=["expr"]).expr(f"`{position}` div 20"))
    monkeypatch.setattr(sequence, "FAN_IN", 4)
    df = spark.createDataFrame([(k, i, s) for k, numbers in data.items() for i, s in enumerate(numbers)], "k int, p long, seq int")
    for k, numbers in data.items():
        rows = sequence.unwrap_seq(df.where(f"k = {k}"), ["k"], "p").orderBy("p").collect()
        assert [r.extended for r in rows] == _unwrap(numbers)


def test_block_transfer_over_wrap(spark):
    blocks = [(65534, "a" * 8), (65535, "b" * 8), (0, "c" * 8), (1, "d"), (0, "c" * 8)]
    packets = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(blocks)], "k int, p long, seq int, data string")
    sessions = spark.createDataFrame([(1, 8, 9, None), (2, 8, 9, None), (3, 8, None, None), (4, 8, 9, 1)], "k int, block_size int, server_port int, error_code int")
    first, status = sequence.reassemble_blocks(packets, sessions, ["k"], "p", "data")
    found = {r.k: r for r in status.collect()}
    assert found[1].missing_blocks == 65_533 and found[1].duplicate_packets == 1 and found[1].status == "partial"
    assert [found[k].status for k in (2, 3, 4)] == ["no-data", "unresolved", "server-error"]
    assert [r.data for r in first.orderBy("extended").collect()] == ["a" * 8, "b" * 8, "c" * 8, "d"]


def test_complete_transfer_and_conflict(spark):
    packets = spark.createDataFrame([(1, 0, 1, "12345678"), (1, 1, 2, "x"), (2, 0, 1, "12345678"), (2, 1, 1, "1234567X"), (2, 2, 2, "x")], "k int, p long, seq int, data string")
    sessions = spark.createDataFrame([(1, 8, 9, None), (2, 8, 9, None)], "k int, block_size int, server_port int, error_code int")
    _, status = sequence.reassemble_blocks(packets, sessions, ["k"], "p", "data")
    assert {r.k: r.status for r in status.collect()} == {1: "complete", 2: "conflicting"}


def test_rtp_quality_counts(spark):
    packets = spark.createDataFrame([(1, 0, 65535, "a"), (1, 1, 0, "b"), (1, 2, 0, "b"), (1, 3, 0, "x"), (1, 4, 3, "c")], "k int, p long, seq int, data string")
    row = sequence.rtp_quality(packets, ["k"], "p", "data").collect()[0]
    assert (row.packets, row.unique_packets, row.duplicate_packets, row.conflicting_packets, row.missing_packets) == (5, 3, 1, 1, 2)
