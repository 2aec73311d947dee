"""Byte streams rebuilt from overlapping segments: the first seen byte wins, everything else is listed.

Who owns a byte depends on sequence number, length and frame alone.  Segments are cut at bucket borders (2 KiB of stream), so
work is spread over (stream, bucket) and a long stream is never gathered.  Inside a bucket the segment borders give elementary
intervals; each belongs to the earliest frame covering it.  Where no bytes are compared, payload stays behind, and of segments
with equal place and length only the earliest is cut; where they are, payload goes to its bucket once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.operators.budget import greedy_limits
from packetloom.operators.ordered import running_max, running_sum, scan, span_of, spread_join
from packetloom.session import cut, small_partitions

STREAM = ["capture_id", "stream_index", "direction"]
BUCKET = 2_048
# Buckets of more pieces than this are settled on their leaders; bytes and cells of the others are looked at together.
HOT_ROWS = 65_536
# Pieces, bytes and expanded items that one step of a task holds.
STEP_ROWS, STEP_BYTES, STEP_ITEMS = 65_536, 32 << 20, 1 << 21
# Kinds of ranges: accepted ones, and those of later frames that repeat or contradict accepted bytes.
KINDS = frozenset(["span", "duplicate", "conflict"])
_SETTLED = {"frame_number": "long", "owner": "long", "low": "long", "high": "long", "same": "boolean"}
_EXTENT = ("first_frame", "last_frame")
_COUNTS = tuple(f"{kind}_{what}" for kind in ("span", "duplicate", "conflict") for what in ("count", "bytes"))
_BRIEF = {**_SETTLED, **dict.fromkeys((*_EXTENT, *_COUNTS), "long")}
CONTENT_BLOCK = 65_536
# Span of stream positions that one step of an ordered scan covers.
POSITIONS = 1 << 20


def _pieces(segments: DataFrame, *carried: str) -> DataFrame:
    """Segments clipped to buckets: bucket, frame_number, low, high and, if ``payload`` is carried, their bytes there."""
    touched = segments.select(
        *STREAM, "frame_number", "seq", "length", *carried,
        F.explode(F.sequence(F.expr(f"seq div {BUCKET}"), F.expr(f"(seq + length - 1) div {BUCKET}"))).alias("bucket"))
    low = F.greatest(F.col("seq"), F.col("bucket") * BUCKET)
    high = F.least(F.col("seq") + F.col("length"), (F.col("bucket") + 1) * BUCKET)
    part = F.substring("payload", (low - F.col("seq") + 1).cast("int"), (high - low).cast("int"))
    return touched.select(
        *STREAM, F.col("bucket").cast("long").alias("bucket"), F.col("frame_number").cast("long").alias("frame_number"),
        low.cast("long").alias("low"), high.cast("long").alias("high"), *[part.alias(name) for name in carried])


def _steps(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of rows of a bounded number of items (one larger row is a range of its own)."""
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP_ITEMS, "right")))
        yield slice(begin, end)
        begin = end


def _expand(sizes: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each item of the rows, its row (from ``base``) and place in it."""
    ends = np.cumsum(sizes)
    return np.repeat(np.arange(base, base + len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)


def _runs(*columns: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last items of runs with equal columns and places that rise by one."""
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1] + 1
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(place)) - 1


def _settle(
    rows: pa.RecordBatch, first: np.ndarray, group: np.ndarray, later: bool, kinds: frozenset[str] = KINDS, mode: str = "ranges"
) -> Iterator[pa.RecordBatch]:
    """Owners in whole buckets whose rows come by frame.  ``first``: first row of each bucket, ``group``: bucket of each row.

    ``kinds``: which ranges are given.  In mode ``holes`` two more kinds of rows have no frame: where a bucket's accepted bytes
    begin and end (same), and the ranges between those that no frame covers (not same).  Mode ``brief`` gives these, but of the
    other ranges only those at the borders of buckets; the row of a bucket counts the rest.
    """
    frame, low, high = (rows[c].to_numpy() for c in ("frame_number", "low", "high"))
    # Places in one line, with one unused place between buckets.
    shift = group * (BUCKET + 1) - rows["bucket"].to_numpy() * BUCKET
    low, high = low + shift, high + shift
    borders = np.unique(np.concatenate([low, high]))
    begin = np.searchsorted(borders, low)
    sizes = np.searchsorted(borders, high) - begin
    owner = np.full(len(borders), len(frame), dtype=np.int64)
    for part in _steps(sizes):
        row, at = _expand(sizes[part], part.start)
        np.minimum.at(owner, begin[row] + at, row)
    brief = mode == "brief"
    counts = {name: np.zeros(len(first), dtype=np.int64) for name in _COUNTS} if brief else {}
    streams = rows.select(STREAM)

    def made(row: np.ndarray, mine: np.ndarray | None, theirs: np.ndarray | None, start: np.ndarray, end: np.ndarray, same: bool, more=None) -> pa.RecordBatch:
        keys = streams.take(pa.array(row))
        none = pa.nulls(len(row), pa.int64())
        mine, theirs = (none if c is None else pa.array(c) for c in (mine, theirs))
        return pa.RecordBatch.from_arrays(
            [*(keys[c] for c in STREAM), mine, theirs, pa.array(start - shift[row]), pa.array(end - shift[row]), pa.array(np.full(len(row), same)),
             *((pa.array(more[c]) if more else none for c in (*_EXTENT, *_COUNTS)) if brief else ())],
            names=[*STREAM, *(_BRIEF if brief else _SETTLED)])

    def given(kind: str, row: np.ndarray, mine: np.ndarray, theirs: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind not in kinds:
            return
        if brief:
            inner = ((start - shift[row]) % BUCKET != 0) & ((end - shift[row]) % BUCKET != 0)
            mark, size = group[row[inner]], (end - start)[inner]
            counts[f"{kind}_count"] += np.bincount(mark, minlength=len(first))
            counts[f"{kind}_bytes"] += np.bincount(mark, size, len(first)).astype(np.int64)
            row, mine, theirs, start, end = (c[~inner] for c in (row, mine, theirs, start, end))
        if len(row):
            yield made(row, mine, theirs, start, end, kind != "conflict")

    cells = np.flatnonzero(owner < len(frame))
    lead = owner[cells]
    owned = frame[lead]
    head, tail = _runs(owned, place=cells)
    yield from given("span", lead[head], owned[head], owned[head], borders[cells[head]], borders[cells[tail] + 1])
    if later:
        yield from _later(rows, group, shift, low, borders, begin, sizes, owner, given)
    if mode == "ranges":
        return
    # Every bucket has an owned cell, so its cells are a run of the owned ones.
    bucket = group[lead]
    change = np.flatnonzero(bucket[1:] != bucket[:-1])
    head, tail = np.append(0, change + 1), np.append(change, len(cells) - 1)
    extent = {"first_frame": np.minimum.reduceat(owned, head), "last_frame": np.maximum.reduceat(owned, head)}
    yield made(lead[head], None, None, borders[cells[head]], borders[cells[tail] + 1], True, {**extent, **counts})
    head = np.flatnonzero((bucket[1:] == bucket[:-1]) & (cells[1:] != cells[:-1] + 1))
    if len(head):
        yield made(lead[head], None, None, borders[cells[head] + 1], borders[cells[head + 1]], False)


def _later(rows, group, shift, low, borders, begin, sizes, owner, given) -> Iterator[pa.RecordBatch]:
    """The ranges of pieces whose places an earlier frame owns, by whether the bytes agree (they do where none are given)."""
    frame = rows["frame_number"].to_numpy()
    payload = rows["payload"] if "payload" in rows.schema.names else None
    if payload is not None:
        offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64)
        data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
        # Where the byte of a place stands in the buffer.
        at_zero = offsets[:-1] - low
    for part in _steps(sizes):
        row, at = _expand(sizes[part], part.start)
        cell = begin[row] + at
        other = frame[owner[cell]] != frame[row]
        row, cell = row[other], cell[other]
        if not len(row):
            continue
        lead = owner[cell]
        if payload is None:
            head, tail = _runs(row, frame[lead], place=cell)
            yield from given("duplicate", row[head], frame[row[head]], frame[lead[head]], borders[cell[head]], borders[cell[tail] + 1])
            continue
        width = borders[cell + 1] - borders[cell]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        ends = np.append(starts[1:], len(row))
        # Whole pieces at a time, so that no run is parted.
        for step in _steps(np.add.reduceat(width, starts)):
            span = slice(starts[step.start], ends[min(step.stop, len(ends)) - 1])
            item, inside = _expand(width[span], span.start)
            mine, theirs = row[item], lead[item]
            place = borders[cell[item]] + inside
            equal = data[at_zero[mine] + place] == data[at_zero[theirs] + place]
            head, tail = _runs(mine, frame[theirs], equal, place=place)
            for kind, same in (("duplicate", True), ("conflict", False)):
                h, t = head[equal[head] == same], tail[equal[head] == same]
                yield from given(kind, mine[h], frame[mine[h]], frame[theirs[h]], place[h], place[t] + 1)


def _settler(later: bool, step_rows: int, kinds: frozenset[str] = KINDS, mode: str = "ranges"):
    """Task function over pieces sorted by bucket and frame: ranges with their owner, and with ``later`` also those of other frames.
    For ``kinds`` and ``mode`` see ``_settle``."""
    keys = [*STREAM, "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, size, most_rows, most_bytes = 0, 0, step_rows, STEP_BYTES

        def whole() -> tuple[pa.RecordBatch, np.ndarray]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            change = np.zeros(rows.num_rows, dtype=bool)
            change[0] = True
            for key in keys:
                values = rows[key].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= values[1:] != values[:-1]
            return rows, np.flatnonzero(change)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count, size = count + batch.num_rows, size + batch.nbytes
            if count >= most_rows or size >= most_bytes:
                rows, first = whole()
                done = int(first[-1])
                if done:
                    yield from _settle(rows.slice(0, done), first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first)), later, kinds, mode)
                rest = rows.slice(done)
                # Copied, so that what is done can go.
                held = [rest.take(pa.array(np.arange(rest.num_rows)))]
                count, size = rest.num_rows, held[0].nbytes
                most_rows, most_bytes = max(step_rows, 2 * count), max(STEP_BYTES, 2 * size)
        if held:
            rows, first = whole()
            yield from _settle(rows, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows))), later, kinds, mode)

    return run


def _settled(pieces: DataFrame, later: bool, kinds: frozenset[str] = KINDS, mode: str = "holes") -> DataFrame:
    """Ranges inside buckets: frame_number, owner, low, high and whether the bytes agree (true where none are given); also the
    buckets' holes, which have no frame."""
    types = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in STREAM)
    # The stream's number comes first, since it tells most rows apart.
    order = ["stream_index", "bucket", "capture_id", "direction", "frame_number"]
    dealt = pieces.repartition(*STREAM, "bucket").sortWithinPartitions(*order)
    columns = _BRIEF if mode == "brief" else _SETTLED
    return dealt.mapInArrow(_settler(later, STEP_ROWS, kinds, mode), f"{types}, {', '.join(f'{n} {t}' for n, t in columns.items())}")


def _merge(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Touching cells of one frame as one range.  A frame holds one segment, so its window is small."""
    order = Window.partitionBy(*STREAM, *keys).orderBy("low")
    island = F.col("low") - F.sum(F.col("high") - F.col("low")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = cells.withColumn("__island", F.coalesce(island, F.col("low")))
    return marked.groupBy(*STREAM, *keys, "__island").agg(F.min("low").alias("start"), F.max("high").alias("end")).drop("__island")


def _rejoin(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges settled in buckets, put together across their borders; the others stay as they are."""
    inner = (F.col("low") % BUCKET != 0) & (F.col("high") % BUCKET != 0)
    whole = ranges.where(inner).select(*STREAM, *keys, F.col("low").alias("start"), F.col("high").alias("end"))
    return whole.unionByName(_merge(ranges.where(~inner).select(*STREAM, *keys, "low", "high"), keys))


LEDGERS = ("ranges", "spans", "cells", "duplicates", "conflicts", "gaps", "tallies", "extents")
#: What the status of streams needs.
STATUS = ("tallies", "gaps")
_NEEDS = {"duplicates": {"duplicate"}, "conflicts": {"conflict"}, "gaps": set(), "tallies": KINDS}


def reassemble(segments: DataFrame, want: Sequence[str] = LEDGERS) -> dict[str, DataFrame]:
    """Ledgers of every stream direction.

    ``ranges``: accepted ranges with their frame.  ``spans``: those with their place in the output.  ``cells``: those with
    their bytes.  ``duplicates`` and ``conflicts``: ranges of later frames that repeat or contradict accepted bytes.
    ``gaps``: ranges no frame covers.  ``tallies``: for each stream direction, how many accepted, repeated and contradicted ranges
    and bytes there are.  ``extents``: some rows for each bucket that have the least and greatest frame, start and end of its
    accepted ranges.

    ``segments``: capture_id, stream_index, direction, frame_number, seq, payload (binary).  ``want`` names
    the ledgers to build: spans and gaps need no payload, cells join it once, duplicates, conflicts and tallies compare it.  Only the
    ranges they need leave the tasks; tallies, extents and gaps need none inside a bucket.
    """
    usable = segments.where("payload IS NOT NULL AND octet_length(payload) > 0")
    small_partitions(segments.sparkSession)
    narrow = usable.select(*STREAM, "frame_number", "seq", F.octet_length("payload").alias("length"))
    brief = "tallies" in want and set(want) <= {*STATUS, "extents"}
    kinds = frozenset().union(*(_NEEDS.get(name, {"span"}) for name in want))
    hot = None
    if {"duplicates", "conflicts", "tallies"} & set(want):
        settled, hot = _compared(usable, narrow, kinds, brief)
    else:
        settled = cut(_settled(_pieces(_leaders(narrow)), later=False, kinds=kinds))
    names = ["frame_number", "owner", "same"]
    if hot is None:
        touched = _rejoin(settled.where("frame_number IS NOT NULL"), names)
    else:
        # Unequal bytes of crowded buckets come one by one.
        crowded = hot[0].withColumn("same", F.lit(True)).unionByName(hot[1].withColumn("same", F.lit(False)))
        later = settled.where("frame_number <> owner").select(*crowded.columns).unionByName(crowded)
        touched = _rejoin(settled.where("frame_number = owner"), names).unionByName(_merge(later, names))
    ranges = touched.where("frame_number = owner").drop("owner", "same")
    other = touched.where("frame_number <> owner")
    ledgers = {"gaps": _gaps(settled), "duplicates": other.where("same").drop("same"), "conflicts": other.where("NOT same").drop("same")}
    if brief and hot is None:
        ledgers["tallies"] = _tallies(touched, settled)
        ends = F.explode(F.array(*_EXTENT)).alias("frame_number")
        ledgers["extents"] = settled.where("frame_number IS NULL AND same").select(*STREAM, F.col("low").alias("start"), F.col("high").alias("end"), ends)
    else:
        ledgers.update(ranges=ranges, spans=_with_output(ranges), tallies=_tallies(touched), extents=ranges)
    if "cells" in want:
        part = F.substring("payload", (F.col("start") - F.col("seq") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        ledgers["cells"] = ranges.join(usable.select(*STREAM, "frame_number", "seq", "payload"), [*STREAM, "frame_number"]).select(
            *STREAM, F.col("start").alias("low"), F.col("end").alias("high"), "frame_number", part.alias("data")
        )
    return {name: ledgers[name] for name in want}


def _tallies(touched: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Ranges and bytes of each kind in a stream direction: those of ``touched``, and those that buckets counted before."""
    own, size = F.col("frame_number") == F.col("owner"), F.col("end") - F.col("start")
    kinds = {"span": own, "duplicate": ~own & F.col("same"), "conflict": ~own & ~F.col("same")}
    amounts = {f"{kind}_{what}": F.when(of, F.lit(1).cast("long") if what == "count" else size) for kind, of in kinds.items() for what in ("count", "bytes")}
    rows = touched.select(*STREAM, *(amounts[c].alias(c) for c in _COUNTS))
    if settled is not None:
        rows = rows.unionByName(settled.where("frame_number IS NULL AND same").select(*STREAM, *_COUNTS))
    return rows.groupBy(*STREAM).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS))


def _gaps(settled: DataFrame) -> DataFrame:
    """Ranges no frame covers: those inside buckets as they were found, those between buckets from where buckets begin and end."""
    ends = settled.where("frame_number IS NULL").select(*STREAM, F.col("low").alias("start"), F.col("high").alias("end"), "same")
    return ends.where("NOT same").drop("same").unionByName(stream_gaps(ends.where("same").drop("same")))


def _leaders(narrow: DataFrame) -> DataFrame:
    """Of segments with equal place and length, the earliest frame and how many there are."""
    return narrow.groupBy(*STREAM, "seq", "length").agg(F.min("frame_number").alias("frame_number"), F.count("*").alias("copies"))


def _compared(usable: DataFrame, narrow: DataFrame, kinds: frozenset[str], brief: bool) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Settled ranges of all buckets, with the bytes of later frames held against their owner's where a bucket is.

    Payload is shuffled once, to its bucket.  Buckets of more than ``HOT_ROWS`` pieces, as where a segment is sent very often,
    are settled on their leaders alone; the second result holds what repeats and contradicts there, or is none.
    """
    crowded = cut(_pieces(narrow).groupBy(*STREAM, "bucket").agg(F.count("*").alias("pieces")).where(F.col("pieces") > HOT_ROWS).drop("pieces"))
    pieces = _pieces(usable.withColumn("length", F.octet_length("payload")), "payload")
    if crowded.isEmpty():
        return cut(_settled(pieces, True, kinds, "brief" if brief else "holes")), None
    key = [*STREAM, "bucket"]
    narrow = cut(narrow)
    cold = _settled(pieces.join(crowded, key, "left_anti"), True, kinds)
    leaders = _leaders(narrow)
    led = cut(_settled(_pieces(leaders).join(crowded, key, "left_semi"), later=True))
    later = led.where("frame_number <> owner").select(*STREAM, "frame_number", "owner", "low", "high")
    owned = led.where("frame_number = owner").select(*STREAM, "frame_number", F.col("low").alias("start"), F.col("high").alias("end"))
    compared = _compare(usable, later.unionByName(_copies(narrow, leaders, owned, later)))
    return cut(cold.unionByName(led.where("frame_number = owner OR frame_number IS NULL"))), compared


def _copies(narrow: DataFrame, leaders: DataFrame, owned: DataFrame, later: DataFrame) -> DataFrame:
    """Later ranges of the segments that lie where their leader lies: what it owns, and what it finds owned.

    Both joins go by span of frames beside their keys, so a segment repeated very often stays spread.
    """
    place = [*STREAM, "seq", "length"]
    first = leaders.where("copies > 1").select(*place, F.col("frame_number").alias("leader"))
    led = spread_join(narrow, first, place, "frame_number", "inner").where("frame_number <> leader").select(*STREAM, "leader", "frame_number")
    led = cut(led.withColumn("__slot", span_of("frame_number")))
    slots = led.select(*STREAM, "leader", "__slot").distinct()
    known = owned.select(*STREAM, F.col("frame_number").alias("leader"), F.col("frame_number").alias("owner"), F.col("start").alias("low"), F.col("end").alias("high"))
    ranges = known.unionByName(later.withColumnRenamed("frame_number", "leader"))
    return led.join(slots.join(ranges, [*STREAM, "leader"]), [*STREAM, "leader", "__slot"]).select(*STREAM, "frame_number", "owner", "low", "high")


def _compare(segments: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges of later frames that repeat their owner's bytes and those that contradict them.

    Both slices of a range are asked for in one join, so payload is shuffled once.  Of a segment that very many
    contradict only the narrow asking side is long, which the skew join splits.
    """
    asked = later.select("*", F.explode(F.array("frame_number", "owner")).alias("segment"))
    keyed = segments.select(*STREAM, F.col("frame_number").alias("segment"), "seq", "payload")
    part = F.substring("payload", (F.col("low") - F.col("seq") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    given = asked.join(keyed, [*STREAM, "segment"]).select(*later.columns, "segment", part.alias("part"))
    met = given.groupBy(*later.columns).agg(
        F.max(F.when(F.col("segment") == F.col("frame_number"), F.col("part"))).alias("slice"),
        F.max(F.when(F.col("segment") == F.col("owner"), F.col("part"))).alias("owner_slice"),
    )
    # Both ledgers read this table, so it is written once; bytes of equal slices are left out.
    judged = cut(met.select(*later.columns, *(F.when(F.col("slice") != F.col("owner_slice"), F.col(c)).alias(c) for c in ("slice", "owner_slice"))))
    same = judged.where("slice IS NULL").select(*later.columns)
    # Only unequal slices are looked at byte by byte.
    size = (F.col("high") - F.col("low")).cast("int")
    bytewise = judged.where("slice IS NOT NULL").select(
        *STREAM, "frame_number", "owner",
        F.explode_outer(
            F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.struct(
                    (F.col("low") + i - 1).alias("low"),
                    (F.col("low") + i).alias("high"),
                    (F.substring(F.col("slice"), i, F.lit(1)) == F.substring(F.col("owner_slice"), i, F.lit(1))).alias("equal"),
                ),
            )
        ).alias("b"),
    ).select(*STREAM, "frame_number", "owner", "b.low", "b.high", "b.equal")
    return same.unionByName(bytewise.where("equal").drop("equal")), bytewise.where("NOT equal").drop("equal")


def _with_output(spans: DataFrame) -> DataFrame:
    placed = scan(
        spans, STREAM, "start", {"output_offset": running_sum(F.col("end") - F.col("start"), inclusive=False)}, span=POSITIONS
    )
    return placed.select(*STREAM, "frame_number", "start", "end", "output_offset")


def stream_gaps(spans: DataFrame) -> DataFrame:
    """Ranges between accepted spans.  Spans do not overlap, so the end before a span is the running maximum."""
    reach = scan(spans, STREAM, "start", {"__reach": running_max(F.col("end"), inclusive=False)}, span=POSITIONS)
    return reach.where("start > __reach").select(*STREAM, F.col("__reach").alias("start"), F.col("start").alias("end"))


def conflict_hashes(conflicts: DataFrame, segments: DataFrame) -> DataFrame:
    """Hashes of both versions of every conflicting range."""
    asked = conflicts.select("*", F.explode(F.array("frame_number", "owner")).alias("segment"))
    keyed = segments.select(*STREAM, F.col("frame_number").alias("segment"), "seq", "payload")
    part = F.substring("payload", (F.col("start") - F.col("seq") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    # One join gives the bytes of both frames, so payload is shuffled once.
    given = asked.join(keyed, [*STREAM, "segment"]).select(*conflicts.columns, "segment", F.sha2(part, 256).alias("hash"))
    met = given.groupBy(*conflicts.columns).agg(
        F.max(F.when(F.col("segment") == F.col("frame_number"), F.col("hash"))).alias("conflicting_hash"),
        F.max(F.when(F.col("segment") == F.col("owner"), F.col("hash"))).alias("first_hash"),
    )
    return met.where("conflicting_hash IS NOT NULL AND first_hash IS NOT NULL")


def stream_content(ledgers: dict[str, DataFrame], block: int = CONTENT_BLOCK) -> DataFrame:
    """Rebuilt bytes without the gaps, as rows ``(stream, block_no, output_offset, data)`` of ``block`` bytes each, the last shorter.

    A whole stream is never one value; readers join on the range they need.
    """
    size = F.col("high") - F.col("low")
    placed = scan(ledgers["cells"], STREAM, "low", {"__out": running_sum(size, inclusive=False)}, span=POSITIONS)
    dealt = placed.select("*", F.explode(F.sequence(F.expr(f"__out div {block}"), F.expr(f"(__out + high - low - 1) div {block}"))).alias("block_no"))
    first = F.greatest("__out", F.col("block_no") * block)
    last = F.least(F.col("__out") + size, (F.col("block_no") + 1) * block)
    part = F.substring("data", (first - F.col("__out") + 1).cast("int"), (last - first).cast("int"))
    grouped = dealt.groupBy(*STREAM, "block_no").agg(
        F.min(first).alias("output_offset"),
        F.array_sort(F.collect_list(F.struct(first.alias("at"), F.hex(part).alias("digits")))).alias("parts"),
    )
    return grouped.select(
        *STREAM, "block_no", "output_offset", F.unhex(F.array_join(F.transform("parts", lambda p: p["digits"]), "")).alias("data")
    )


def limit_segments(segments: DataFrame, max_segments: int, max_bytes: int, carry: bool = True) -> tuple[DataFrame, DataFrame]:
    """Segments that fit the limits of their stream, both directions together, and a narrow row for each one that does not.

    In frame order, a segment that would pass ``max_bytes`` of payload is passed over (``payload-budget``) and later, smaller ones
    may still fit; after ``max_segments`` are taken, all others are skipped (``segment-limit``).  Segments without payload
    cost nothing and are left out of both.  Both are read from one written table.  Without ``carry`` the segments that fit have
    narrow rows too, and no payload is moved.
    """
    narrow = [*STREAM, "frame_number", "payload_length"]
    sized = segments.where("octet_length(payload) > 0").withColumn("payload_length", F.octet_length("payload").cast("long"))
    rows = sized if carry else sized.select(*narrow)
    marked = greedy_limits(
        rows, ["capture_id", "stream_index"], "frame_number", "payload_length", max_bytes, max_segments,
        [c for c in rows.columns if c not in narrow], "payload-budget", "segment-limit")
    return marked.where("reason IS NULL").select(*(segments.columns if carry else narrow)), marked.where("reason IS NOT NULL").select(*narrow, "reason")


def stream_status(segments: DataFrame, ledgers: dict[str, DataFrame], max_output: int | None = None, skips: DataFrame | None = None) -> DataFrame:
    """Byte counts and status of every stream direction: truncated, empty, conflicting, partial or complete.

    ``skips`` lists segments that a limit kept out before: a direction with any is truncated, whatever else holds, also where
    none of its segments is left; ``skipped_segments`` counts them.
    """
    heads = segments.groupBy(*STREAM).agg(
        F.count(F.when(F.octet_length("payload") > 0, 1)).alias("segments"),
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
    )
    if skips is not None:
        heads = heads.join(skips.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("skipped_segments")), STREAM, "full")

    tallies = ledgers["tallies"].select(
        *STREAM, "span_count", F.col("span_bytes").alias("unique_bytes"), "duplicate_count", "duplicate_bytes", "conflict_count", "conflict_bytes")
    gaps = ledgers["gaps"].groupBy(*STREAM).agg(F.count(F.lit(1)).alias("gap_count"), F.sum(F.col("end") - F.col("start")).cast("long").alias("gap_bytes"))
    joined = heads.join(tallies, STREAM, "left").join(gaps, STREAM, "left")
    filled = joined.fillna(0, [c for c in joined.columns if c not in (*STREAM, "first_frame", "last_frame")])
    over = F.lit(False) if max_output is None else F.col("unique_bytes") > max_output
    lost = F.lit(False) if skips is None else F.col("skipped_segments") > 0
    status = (
        F.when(lost, "truncated")
        .when(F.col("unique_bytes") == 0, "empty")
        .when(over, "truncated")
        .when(F.col("conflict_count") > 0, "conflicting")
        .when(F.col("gap_count") > 0, "partial")
        .otherwise("complete")
    )
    return filled.withColumn("status", status)


def text_stream_rollup(statuses: DataFrame) -> DataFrame:
    """One status per stream over its directions."""
    state = F.col("status")
    return statuses.groupBy("capture_id", "stream_index").agg(
        F.when(F.bool_or(state == "truncated"), "truncated")
        .when(F.bool_or(state == "conflicting"), "conflicting")
        .when(F.bool_or(state == "partial"), "partial")
        .otherwise("reconstructed")
        .alias("status"),
        F.sum("unique_bytes").cast("long").alias("output_bytes"),
        F.count(F.lit(1)).alias("directions"),
    )
