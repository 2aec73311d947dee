"""The signature scan holds little beside its input, whatever an Arrow batch holds."""

import tracemalloc

import pyarrow as pa

from packetloom.operators import signatures


def test_a_large_batch_is_scanned_in_steps():
    value = b"." * 9_000 + b"\xff\xd8\xff" + b"." * 997
    rows = 1_600
    batch = pa.record_batch({
        "k": pa.array(range(rows), pa.int64()), "byte_length": pa.array([len(value)] * rows, pa.int32()),
        "__base": pa.array([0] * rows, pa.int64()), "__piece": pa.array([value] * rows, pa.binary())})
    tracemalloc.start()
    found = [r for part in signatures._scan(["k"], signatures.WINDOW)(iter([batch])) for r in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["k"], r["offset"]) for r in found) == [(k, 9_000) for k in range(rows)]
    # Held whole, the places of all bytes alone take sixteen times the batch.
    assert peak < 4 * rows * len(value)


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        df = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff"))], "k int, data binary")
        assert signatures.signature_hits(df, "data").count() == 1
        assert int(spark.conf.get(name)) * (signatures.WINDOW + signatures.AHEAD) <= 64 << 20
    finally:
        spark.conf.set(name, before)
