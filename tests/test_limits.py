"""Limits that reach the status: skipped segments, skipped packets, limited captures; triage inputs and their lineage."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import budget, profile, rank, reassembly, sequence

SEGMENTS = "capture_id int, stream_index int, direction string, frame_number long, seq long, payload binary"


def fold(rows, most, budget):
    """Frame by frame: what is kept, and why the rest is not."""
    kept, skips, used = [], {}, 0
    for frame, size in sorted(rows):
        if not size:
            continue
        if len(kept) >= most:
            skips[frame] = "segment-limit"
        elif used + size > budget:
            skips[frame] = "payload-budget"
        else:
            kept.append(frame)
            used += size
    return kept, skips


def test_segment_limits_are_shared_by_both_directions(spark):
    rng = random.Random(6)
    rows, given = [], {}
    for stream in range(5):
        for frame in range(1, 60):
            size = rng.choice([0, 1, 5, 20, 33])
            given.setdefault(stream, []).append((frame, size))
            rows.append((1, stream, rng.choice(["a>b", "b>a"]), frame, frame * 10, bytearray(b"x" * size)))
    kept, skips = reassembly.limit_segments(spark.createDataFrame(rows, SEGMENTS).repartition(4), 25, 300)
    got = {}
    for r in kept.collect():
        got.setdefault(r["stream_index"], []).append(r["frame_number"])
    reasons = {}
    for r in skips.collect():
        reasons.setdefault(r["stream_index"], {})[r["frame_number"]] = r["reason"]
    for stream, frames in given.items():
        expected = fold(frames, 25, 300)
        assert (sorted(got.get(stream, [])), reasons.get(stream, {})) == expected


@pytest.mark.parametrize("hot_rows, hot_bytes", [(1000, 10_000), (1000, 600), (90, 10_000), (1000, 0)])
def test_segments_carry_their_payload_through_the_walk(spark, monkeypatch, hot_rows, hot_bytes):
    monkeypatch.setattr(budget, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(budget, "HOT_BYTES", hot_bytes)
    rng = random.Random(14)
    rows = []
    for stream in range(6):
        for frame in range(1, 40 if stream % 2 else 120):
            size = rng.choice([0, 1, 5, 20, 33])
            rows.append((1, stream, rng.choice(["a>b", "b>a"]), frame, frame * 10, rng.randbytes(size)))
    sent = {(r[1], r[3]): r for r in rows}
    segments = spark.createDataFrame(rows, SEGMENTS).repartition(4)
    kept, skips = reassembly.limit_segments(segments, 25, 300)
    # Both are read from the written walk, without a join that would shuffle all payload again.
    for frame in (kept, skips):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    found, reasons = {}, {}
    for r in kept.collect():
        assert tuple(r) == sent[r["stream_index"], r["frame_number"]]
        found.setdefault(r["stream_index"], []).append(r["frame_number"])
    for r in skips.collect():
        direction, payload = (sent[r["stream_index"], r["frame_number"]][i] for i in (2, 5))
        assert (r["direction"], r["payload_length"]) == (direction, len(payload))
        reasons.setdefault(r["stream_index"], {})[r["frame_number"]] = r["reason"]
    for stream in range(6):
        expected = fold([(f, len(r[5])) for (s, f), r in sent.items() if s == stream], 25, 300)
        assert (sorted(found.get(stream, [])), reasons.get(stream, {})) == expected
    # The skips alone need no payload.
    narrow, same = reassembly.limit_segments(segments, 25, 300, carry=False)
    assert "payload" not in narrow.columns and narrow.count() == kept.count()
    assert same.exceptAll(skips).count() == skips.exceptAll(same).count() == 0


def test_skipped_direction_is_truncated_even_without_segments(spark):
    rows = [(1, 1, "a>b", 1, 0, bytearray(b"abc")), (1, 1, "a>b", 2, 3, bytearray(b"def")), (1, 1, "b>a", 3, 0, bytearray(b"too much")), (1, 2, "a>b", 1, 0, bytearray(b"x"))]
    kept, skips = reassembly.limit_segments(spark.createDataFrame(rows, SEGMENTS), 10, 6)
    found = {(r["stream_index"], r["direction"]): (r["status"], r["segments"], r["skipped_segments"], r["unique_bytes"], r["first_frame"])
             for r in reassembly.stream_status(kept, reassembly.reassemble(kept), skips=skips).collect()}
    assert found == {(1, "a>b"): ("complete", 2, 0, 6, 1), (1, "b>a"): ("truncated", 0, 1, 0, None), (2, "a>b"): ("complete", 1, 0, 1, 1)}


def test_transfers_that_lost_packets_are_budget_limited(spark):
    packets = spark.createDataFrame([(1, 1, 1, "aa"), (1, 2, 2, "b"), (2, 3, 1, "aa"), (2, 4, 1, "zz"), (5, 5, 1, "a")], "s int, frame_number long, seq int, payload string")
    sessions = spark.createDataFrame([(1, 2, 9, None), (2, 2, 9, None), (3, 2, 9, None), (4, 2, 9, 1), (5, 2, None, None), (6, 2, 9, None)], "s int, block_size int, server_port int, error_code int")
    skips = spark.createDataFrame([(2,), (3,), (3,), (4,), (5,)], "s int")
    _, status = sequence.reassemble_blocks(packets, sessions, ["s"], "frame_number", "payload", skips)
    assert {r["s"]: (r["status"], r["skipped_packets"]) for r in status.collect()} == {
        1: ("complete", 0), 2: ("budget-limited", 1), 3: ("budget-limited", 2), 4: ("server-error", 1), 5: ("unresolved", 1), 6: ("no-data", 0)}


def test_coverage_follows_the_limits_of_each_capture(spark):
    observations = spark.createDataFrame([(1, "http", 5), (2, "http", 5)], "capture_id int, label string, frame_count long")
    profiles = spark.createDataFrame([(1, 7, "tcp"), (2, 7, "tcp")], "capture_id int, stream_index int, transport string")
    analyzers = spark.createDataFrame([(1, "http", "complete"), (2, "http", "complete")], "capture_id int, label string, status string")
    rebuilt = spark.createDataFrame([(1, 7, "complete"), (2, 7, "complete")], "capture_id int, stream_index int, status string")
    skips = spark.createDataFrame([(2, "row-limit"), (2, "row-limit")], "capture_id int, reason string")
    rows = profile.coverage(observations, profiles, analyzers, rebuilt, ["http"], skips).collect()
    assert {(r["capture_id"], r["subject_kind"]): r["status"] for r in rows} == {
        (1, "protocol"): "complete", (1, "conversation"): "complete", (2, "protocol"): "budget-limited", (2, "conversation"): "budget-limited"}


def test_triage_inputs_need_their_own_test_and_lineage_knows_whole_contents(spark):
    rows = spark.createDataFrame([("a", "h1", 5, True, None), ("b", "h2", 3, False, "a"), ("c", "h1", 5, None, "a"), ("d", "h3", 0, True, "a"), ("a", "h1", 5, True, None)],
                                 "id string, hash string, size int, good boolean, parent string")
    kind = rank.evidence(rows, "transform", F.col("id"), F.col("hash"), F.col("size"), F.col("good"), F.col("parent"))
    body = rank.evidence(rows.where("id = 'a'"), "http-body", F.col("id"), F.col("hash"), F.col("size"), F.col("good"))
    inputs, lineage = rank.triage_inputs(kind, body)
    assert sorted(tuple(r) for r in inputs.collect()) == [("http-body", "a", "h1", 5), ("transform", "a", "h1", 5)]
    assert sorted((r["source_id"], r["parent_id"], r["usable"]) for r in lineage.collect()) == [("b", "a", False), ("c", "a", True), ("d", "a", False)]
