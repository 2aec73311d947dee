"""Status of streams from what buckets count, against the ledgers of all ranges; segments cut from texts."""

import random

import pyarrow as pa
import pytest

from packetloom.operators import reassembly
from packetloom.plans import pages
from packetloom.views import OVERLAP, PIECE, view
from tests.test_reassembly import _brute, _runs, _segments
from tests.test_settled_buckets import _items


def _size(ranges):
    return len(ranges), sum(r[-1] - r[-2] for r in ranges)


@pytest.mark.parametrize("hot_rows", [30, 100_000])
@pytest.mark.parametrize("step_rows", [7, 65_536])
def test_status_needs_no_range_inside_a_bucket(spark, monkeypatch, hot_rows, step_rows):
    monkeypatch.setattr(reassembly, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(reassembly, "STEP_ROWS", step_rows)
    items = _items(11)
    segments = _segments(spark, items)
    owner, later = _brute(items)
    spans = _runs([(f, p) for p, (f, _) in owner.items()])
    same, other = (_runs([(f, o, p) for f, p, o, s in later if s == kind]) for kind in (True, False))
    covered = sorted(owner)
    gaps = [(a + 1, b) for a, b in zip(covered, covered[1:]) if b > a + 1]
    parts = reassembly.reassemble(segments, [*reassembly.STATUS, "extents"])
    assert sorted((r.start, r.end) for r in parts["gaps"].collect()) == gaps
    r = reassembly.stream_status(segments, parts).first()
    assert (r.span_count, r.unique_bytes) == _size(spans)
    assert (r.duplicate_count, r.duplicate_bytes, r.conflict_count, r.conflict_bytes) == (*_size(same), *_size(other))
    assert (r.gap_count, r.gap_bytes, r.status) == (len(gaps), sum(b - a for a, b in gaps), "conflicting")
    page = pages.streams_page(reassembly.stream_status(segments, parts), parts["extents"]).first()
    assert (page.sequence_start, page.sequence_end) == (covered[0], covered[-1] + 1)
    assert (page.source_frame_start, page.source_frame_end) == (min(s[0] for s in spans), max(s[0] for s in spans))


@pytest.mark.parametrize("want", [["duplicates"], ["conflicts"], ["gaps"], ["ranges"]])
def test_only_wanted_ranges_are_made(spark, want):
    items = _items(12)
    owner, later = _brute(items)
    got = sorted(tuple(r)[3:] for r in reassembly.reassemble(_segments(spark, items), want)[want[0]].collect())
    covered = sorted(owner)
    assert got == {
        "duplicates": _runs([(f, o, p) for f, p, o, s in later if s]), "conflicts": _runs([(f, o, p) for f, p, o, s in later if not s]),
        "ranges": _runs([(f, p) for p, (f, _) in owner.items()]), "gaps": [(a + 1, b) for a, b in zip(covered, covered[1:]) if b > a + 1],
    }[want[0]]


def test_steps_part_no_run(monkeypatch):
    # The later frame repeats one owner's bytes over two cells; a step of few bytes must not make two ranges of them.
    monkeypatch.setattr(reassembly, "STEP_ITEMS", 4)
    pieces = [(1, 100, b"abcdefghij"), (2, 102, b"cdefgh"), (3, 105, b"f")]
    rows = [(1, 1, "a>b", 0, frame, at, at + len(data), data) for frame, at, data in pieces]
    names = ["capture_id", "stream_index", "direction", "bucket", "frame_number", "low", "high", "payload"]
    whole = pa.table(dict(zip(names, zip(*rows), strict=True)))
    out = [r for part in reassembly._settler(True, 10)(iter(whole.to_batches())) for r in part.to_pylist()]
    assert sorted((r["frame_number"], r["owner"], r["low"], r["high"]) for r in out) == [(1, 1, 100, 110), (2, 1, 102, 108), (3, 1, 105, 106)]


def test_segments_are_cut_by_builtin_code(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "x", "a" * 40, "b" * 41, "ß€\U0001f600\n\x00" * 30, "".join(rng.choice("ab \n.é") for _ in range(3_000))] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    segments = view(spark, str(tmp_path), "segments")
    expected = []
    for doc, text in enumerate(texts):
        folded = "".join(c if "\x01" <= c <= "\x7f" else "?" for c in text or "").encode()
        for i in range(-(-len(folded) // PIECE)):
            piece, mix = folded[i * PIECE : i * PIECE + PIECE + OVERLAP], doc + i
            for copy in (0, 1) if mix % 13 == 0 or mix % 11 == 0 else (0,):
                if mix % 17:
                    expected.append((1, doc, "a>b", i * 2 + copy, i * PIECE, b"#" + piece[1:] if copy and mix % 13 == 0 else piece))
    assert sorted((*tuple(r)[:5], bytes(r.payload)) for r in segments.collect()) == sorted(expected)
    plan = segments._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "regexp_extract_all" not in plan
