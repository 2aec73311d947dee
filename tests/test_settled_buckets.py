"""Buckets settled in tasks: small steps, crowded buckets, and the size of tasks over narrow rows."""

import random

import pyarrow as pa
import pytest

from packetloom.operators import reassembly
from packetloom.session import PARTITION_BYTES, small_partitions
from tests.test_reassembly import _brute, _rows, _runs, _segments


def _items(seed, rows=200):
    rng = random.Random(seed)
    items = [(frame, rng.choice([0, 5, 2040, 4090, 8180]) + rng.randrange(60), bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40)))) for frame in range(1, rows)]
    items += [(rows + i, 6_000, b"keepalive") for i in range(40)] + [(rows + 50, 6_000, b"keepAlive"), (rows + 51, 6_003, b"pAliveX"), (rows + 52, 1_900, b"ab" * 2_300)]
    rng.shuffle(items)
    return items


def _ledger(df):
    return sorted((r.frame_number, r.owner, r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("hot_rows", [30, 100_000])
def test_crowded_buckets_give_the_same_ledgers(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(reassembly, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(reassembly, "STEP_ROWS", 7)
    items = _items(3)
    owner, later = _brute(items)
    parts = reassembly.reassemble(_segments(spark, items))
    assert _rows(parts["spans"]) == [tuple(r) for r in _runs([(f, p) for p, (f, _) in owner.items()])]
    assert _ledger(parts["duplicates"]) == _runs([(f, o, p) for f, p, o, same in later if same])
    assert _ledger(parts["conflicts"]) == _runs([(f, o, p) for f, p, o, same in later if not same])


@pytest.mark.parametrize(("step_rows", "step_items", "batch"), [(1, 1, 1), (5, 50, 3), (1_000, 1 << 20, 64)])
def test_steps_of_any_size_settle_alike(monkeypatch, step_rows, step_items, batch):
    monkeypatch.setattr(reassembly, "STEP_ITEMS", step_items)
    rows = []
    for stream, seed in ((1, 4), (None, 5)):
        for frame, seq, payload in _items(seed, 60):
            for bucket in range(seq // reassembly.BUCKET, (seq + len(payload) - 1) // reassembly.BUCKET + 1):
                low, high = max(seq, bucket * reassembly.BUCKET), min(seq + len(payload), (bucket + 1) * reassembly.BUCKET)
                rows.append((1, stream, "a>b", bucket, frame, low, high, payload[low - seq : high - seq]))
    rows.sort(key=lambda r: (r[1] or 0, r[3], r[4]))
    names = ["capture_id", "stream_index", "direction", "bucket", "frame_number", "low", "high", "payload"]
    whole = pa.table(dict(zip(names, zip(*rows), strict=True)))
    out = [r for part in reassembly._settler(True, step_rows)(iter(whole.to_batches(batch))) for r in part.to_pylist()]
    for stream, seed in ((1, 4), (None, 5)):
        owner, later = _brute(_items(seed, 60))
        got = [(r["frame_number"], r["owner"], p, r["same"]) for r in out if r["stream_index"] == stream for p in range(r["low"], r["high"])]
        assert sorted((f, p) for f, o, p, _ in got if f == o) == sorted((f, p) for p, (f, _) in owner.items())
        assert sorted((f, p, o, same) for f, o, p, same in got if f != o) == sorted(later)


def test_tasks_over_narrow_rows_are_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64MB")
        reassembly.reassemble(_segments(spark, [(1, 0, b"abc")]), ["gaps"])
        assert spark.conf.get(name) == str(PARTITION_BYTES)
        spark.conf.set(name, "1m")
        small_partitions(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
