from pyspark.sql import functions as F

from packetloom.operators import profile
from packetloom.sources.fields import hex_bytes, http_kind, normalize_inventory, read_fields, split_malformed
from packetloom.streaming.landing import land_fields

DNS = "7\t1.5\t10.0.0.1\t\t192.0.2.53\t\t3\tabc.example.test\n8\t1.6\t\tfe80::1\t\tfe80::2\t\tx.test\n"


def test_bad_rows_are_counted_not_lost(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(DNS + "nine\t1.7\ta\t\tb\t\t1\tq.test\n10\t2.0\n11\t2.1\ta\t\tb\t\t1\t\n")
    good, bad = split_malformed(read_fields(spark, str(tmp_path / "a.tsv"), "dns").cache(), "dns")
    assert sorted(r.frame_number for r in good.collect()) == [7, 8]
    assert sorted(r.reason for r in bad.collect()) == ["corrupt-row", "corrupt-row", "missing-query_name"]


def test_inventory_normalisation(spark, tmp_path):
    rows = [
        "1\t0.1\t60\t60\teth:IP:tcp\t10.0.0.1\t\t10.0.0.2\t\t4\t1000\t80\t12\t1\t0\t\t\t\t",
        "2\t0.2\t60\t60\teth:ipv6:udp:dns\t\tfe80::1\t\tfe80::2\t\t\t\t\t\t\t9\t53\t5353\t6",
    ]
    (tmp_path / "i.tsv").write_text("\n".join(rows) + "\n")
    good, bad = split_malformed(read_fields(spark, str(tmp_path / "i.tsv"), "inventory"), "inventory")
    found = normalize_inventory(good).orderBy("frame_number").collect()
    assert bad.count() == 0
    assert (found[0].transport, found[0].stream_index, found[0].payload_length, found[0].syn, found[0].ack) == ("tcp", 4, 12, True, False)
    assert found[0].labels == ["eth", "ip", "tcp"]
    assert (found[1].transport, found[1].source, found[1].payload_length) == ("udp", "fe80::1", 0)


def test_small_helpers(spark):
    df = spark.createDataFrame([("GET", None, "aa:BB"), ("", 200, "zz"), (None, None, None)], "method string, response_code int, h string")
    assert [r[0] for r in df.select(http_kind()).collect()] == ["request", "response", None]
    assert [r[0] for r in df.select(F.hex(hex_bytes(F.col("h")))).collect()] == ["AABB", None, None]


def test_roles_come_from_the_handshake_only(spark):
    frames = spark.createDataFrame(
        [
            (1, 1, "tcp", 1, "b:80", "a:9", True, True), (1, 2, "tcp", 1, "a:9", "b:80", True, False), (1, 3, "tcp", 2, "a:9", "b:80", False, True), (1, 4, "udp", 1, "a:9", "b:80", True, False),
        ],
        "capture_id int, frame_number long, transport string, stream_index long, endpoint_a string, endpoint_b string, syn boolean, ack boolean",
    )
    found = {(r.transport, r.stream_index): (r.initiator, r.midstream) for r in profile.stream_roles(frames).collect()}
    assert found == {("tcp", 1): ("a:9", False), ("tcp", 2): (None, True), ("udp", 1): (None, True)}


def test_coverage_ladder(spark):
    rows = spark.createDataFrame(
        [(False, "complete", None, False), (True, "failed", None, True), (True, None, "partial", True), (True, None, "truncated", False), (True, "complete", None, False), (True, None, None, False)],
        "able boolean, a string, r string, b boolean",
    )
    status = profile.coverage_status(F.col("able"), F.col("a"), F.col("r"), F.col("b"))
    assert [r[0] for r in rows.select(status).collect()] == ["unavailable", "failed", "budget-limited", "partial", "complete", "not-run"]


def test_landing_takes_each_file_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.tsv").write_text(DNS)
    for _ in range(2):
        land_fields(spark, str(source), "dns", target, state).awaitTermination()
    assert spark.read.parquet(target + "/rows").count() == 2
    (source / "b.tsv").write_text("20\t1.5\ta\t\tb\t\t3\tq.test\nbad\n")
    land_fields(spark, str(source), "dns", target, state).awaitTermination()
    assert spark.read.parquet(target + "/rows").count() == 3
    assert [r.reason for r in spark.read.parquet(target + "/rejected").collect()] == ["corrupt-row"]
