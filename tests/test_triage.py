"""Triage evidence of block transfers: every packet of every stream is read."""

import hashlib

import __spark_entry__ as entry_file
from packetloom.catalog import triage
from packetloom.views import view

SMALL = "/root/testdata/sf0.001"


def test_transfers_hold_all_packets_of_all_streams(spark, tmp_path):
    # Of ten events the third is lost, the fifth comes twice and the seventh comes again altered.
    sizes = {2: 18, 3: 8, 5: 4, 7: 2, 10: 1}
    events = [(1_000 * user + i, user) for user, n in sizes.items() for i in range(n)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = triage.transfers(spark, str(tmp_path)).orderBy("stream_index", "extended").collect()
    blocks = {user: [r["extended"] for r in rows if r["stream_index"] == user] for user in sizes}
    assert blocks == {2: list(range(1, 19)), 3: [1, 2, 4, 5, 6, 7, 8], 5: [1, 2, 4], 7: [1, 2], 10: [1]}
    assert [r["extended"] for r in rows if r["payload"] == "altered"] == [7, 17]
    assert {r["stream_index"]: r["status"] for r in rows} == {2: "complete", 3: "conflicting", 5: "partial", 7: "complete", 10: "server-error"}


def test_lineage_leads_from_each_block_of_each_stream(spark):
    edges = entry_file.queries()["triage_lineage"](spark, SMALL).where("source_kind = 'tftp-data'").select("source_id", "parent_id", "content_hash").collect()
    packets = view(spark, SMALL, "seq_packets").collect()
    even = {(p["stream_index"], p["true_seq"], p["payload"]) for p in packets if p["stream_index"] % 2 == 0}
    odd = {(p["stream_index"], p["true_seq"]) for p in packets if p["stream_index"] % 2}
    assert len(edges) == len({e["source_id"] for e in edges}) == len(even) + len(odd)
    assert {e["parent_id"] for e in edges} == {str(p["stream_index"]) for p in packets}
    # In odd streams an altered copy is in conflict with a block, so its content is no evidence.
    altered = hashlib.sha256(b"altered").hexdigest()
    assert sum(e["content_hash"] == altered for e in edges) == sum(p["payload"] == "altered" and p["stream_index"] % 2 == 0 for p in packets)
