import random

from pyspark.sql import functions as F

from packetloom.operators import pairing, reassembly

SCHEMA = "capture_id int, stream_index long, direction string, frame_number long, seq long, payload binary"


def _rows(df):
    return sorted((r.frame_number, r.start, r.end) for r in df.collect())


def _segments(spark, items, stream=1):
    return spark.createDataFrame([(1, stream, "a>b", f, s, bytearray(p)) for f, s, p in items], SCHEMA)


def test_overlap_gives_addition_duplicates_and_conflict(spark):
    parts = reassembly.reassemble(_segments(spark, [(1, 10, b"abcdef"), (2, 12, b"cXefYZ")]))
    assert _rows(parts["spans"]) == [(1, 10, 16), (2, 16, 18)]
    assert _rows(parts["duplicates"]) == [(2, 12, 13), (2, 14, 16)]
    assert _rows(parts["conflicts"]) == [(2, 13, 14)]
    assert parts["gaps"].count() == 0
    hashes = reassembly.conflict_hashes(parts["conflicts"], _segments(spark, [(1, 10, b"abcdef"), (2, 12, b"cXefYZ")])).collect()[0]
    import hashlib

    assert hashes.first_hash == hashlib.sha256(b"d").hexdigest()
    assert hashes.conflicting_hash == hashlib.sha256(b"X").hexdigest()


def _brute(items):
    owner, later = {}, []
    for frame, seq, payload in sorted(items):
        for i, byte in enumerate(payload):
            pos = seq + i
            if pos in owner:
                later.append((frame, pos, owner[pos][0], byte == owner[pos][1]))
            else:
                owner[pos] = (frame, byte)
    return owner, later


def _runs(cells):
    runs = []
    for cell in sorted(cells):
        *key, pos = cell
        if runs and runs[-1][0] == key and runs[-1][2] == pos:
            runs[-1][2] = pos + 1
        else:
            runs.append([key, pos, pos + 1])
    return sorted((*key, start, end) for key, start, end in runs)


def test_random_streams_equal_byte_by_byte_rebuild(spark):
    rng = random.Random(11)
    items = []
    for frame in range(1, 160):
        seq = rng.choice([0, 5, 8180, 8190, 16380]) + rng.randrange(40)
        items.append((frame, seq, bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))))
    # One segment repeated very often, once with other bytes.
    items += [(200 + i, 20_000, b"keepalive") for i in range(60)] + [(300, 20_000, b"keepAlive")]
    owner, later = _brute(items)
    rng.shuffle(items)
    parts = reassembly.reassemble(_segments(spark, items))
    assert _rows(parts["spans"]) == [tuple(r) for r in _runs([(f, p) for p, (f, _) in owner.items()])]

    def ledger(name):
        return sorted((r.frame_number, r.owner, r.start, r.end) for r in parts[name].collect())

    assert ledger("duplicates") == _runs([(f, o, p) for f, p, o, same in later if same])
    assert ledger("conflicts") == _runs([(f, o, p) for f, p, o, same in later if not same])
    content = reassembly.stream_content(parts, block=64).orderBy("block_no").collect()
    assert b"".join(bytes(r.data) for r in content) == bytes(owner[p][1] for p in sorted(owner))
    assert {len(r.data) for r in content[:-1]} == {64} and [r.output_offset for r in content] == [64 * r.block_no for r in content]
    gaps = [(r.start, r.end) for r in parts["gaps"].orderBy("start").collect()]
    points = sorted(owner)
    assert gaps == [(a + 1, b) for a, b in zip(points, points[1:]) if b > a + 1]


def test_status_precedence(spark):
    segments = _segments(spark, [(1, 0, b"ab"), (2, 4, b"c")], 1).unionByName(
        _segments(spark, [(3, 0, b"ab"), (4, 0, b"ax"), (5, 9, b"z")], 2)
    ).unionByName(_segments(spark, [(6, 0, b"abc")], 3)).unionByName(_segments(spark, [(7, 0, b"")], 4))
    parts = reassembly.reassemble(segments)
    found = {r.stream_index: r.status for r in reassembly.stream_status(segments, parts).collect()}
    assert found == {1: "partial", 2: "conflicting", 3: "complete", 4: "empty"}
    limited = {r.stream_index: r.status for r in reassembly.stream_status(segments, parts, max_output=2).collect()}
    assert limited[3] == "truncated"


def test_contributing_frames_over_bucket_borders(spark):
    spans = spark.createDataFrame([(1, 0, 65_530, 1), (1, 65_530, 65_545, 2), (1, 65_545, 200_000, 3)], "s int, span_start long, span_end long, frame_number int")
    matches = spark.createDataFrame([(1, 65_528, 65_550, 0), (1, 10, 12, 1)], "s int, start long, end long, m int")
    rows = pairing.contributing_frames(matches, spans, ["s"], "m").collect()
    assert sorted((r.m, r.frame_number) for r in rows) == [(0, 1), (0, 2), (0, 3), (1, 1)]
    assert pairing.overlap_join(matches, spans, ["s"]).where(F.col("m") == 0).count() == 3


def test_covers_stream(spark):
    spans = spark.createDataFrame([(1, 0, 4), (1, 2, 9), (2, 1, 9), (3, 0, 5)], "s int, start long, end long")
    totals = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 0)], "s int, total long")
    assert {r.s: r.covers for r in pairing.covers_stream(spans, totals, ["s"]).collect()} == {1: True, 2: False, 3: False, 4: True}
