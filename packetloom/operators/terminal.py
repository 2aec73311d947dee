"""Records of rebuilt terminal streams: lines, control bytes, bounded pieces and prompts, across the borders of all blocks.

Where a line or a control byte ends a record depends on two neighbouring bytes alone.  Only two things depend on what came
before: where a piece reaches the length limit, and whether a prompt's colon still stands in the piece that a segment ends.
Both follow from the place where the last piece began, modulo the limit.  So a stream is cut into windows by position, each
window is reduced to the map from that place before it to the place after it, the maps are joined ``FAN_IN`` at a time, and
the windows of a block are then walked once in order.  A window travels as one narrow row of break positions; payload is
read once.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import last_value, lead, row_number, scan
from packetloom.operators.records import POSITIONS, prompt_name, stream_windows
from packetloom.session import cut, small_partitions

MAX_BYTES = 4_096
WINDOW = 1 << 20
FAN_IN = 1_024
# Windows that one step of a task holds as Python values.
STEP_ROWS = 256

# What ends a record at a position; at one position in this order.
CONTROL, LINE, RETURN, PAIRED, SOURCE, REST = range(6)
# Colon positions of a source's end: none, or not known inside the window.
NONE, UNKNOWN = -1, -2


def _find(window: int):
    """Task function: break positions of each window, and its last byte that is no blank."""

    def breaks(raw: bytes, at: int, begin: int, bounds: np.ndarray) -> dict[str, object]:
        ahead = begin - at
        data = np.frombuffer(raw, np.uint8)
        own = data[ahead : ahead + window]
        more = len(data) > ahead + window
        before = np.concatenate([data[:1] if ahead else [255], own[:-1]])
        after = np.concatenate([own[1:], data[ahead + window :][:1] if more else [255]])
        paired = (own == 0) & (before == 13)
        lone = (own == 13) & (after != 10) & (after != 0)
        control = np.flatnonzero((own < 32) & (own != 10) & (own != 13) & ~paired)
        found = [
            (control, REST), (control + 1, CONTROL), (np.flatnonzero(own == 10) + 1, LINE),
            (np.flatnonzero(lone) + 1, RETURN), (np.flatnonzero(paired) + 1, PAIRED),
        ]
        if not more:
            found.append((np.array([len(own)]), REST))
        solid = np.flatnonzero((own != 32) & (own != 9))
        inside = np.sort(bounds[(bounds > begin) & (bounds <= begin + len(own))] - begin)
        last = np.searchsorted(solid, inside) - 1
        colon = np.where(last < 0, UNKNOWN, NONE)
        known = last >= 0
        place = solid[last[known]] if len(solid) else np.zeros(0, np.int64)
        colon[known] = np.where(own[place] == 58, place + begin, NONE)
        kept = colon != NONE
        found.append((inside[kept], SOURCE))
        at_ = np.concatenate([a for a, _ in found]) + begin
        code = np.concatenate([np.full(len(a), k) for a, k in found])
        colons = np.concatenate([np.full(len(at_) - int(kept.sum()), NONE), colon[kept]])
        order = np.lexsort((code, at_))
        tail = int(solid[-1]) if len(solid) else None
        return {
            "begin": begin, "size": len(own), "at": at_[order], "code": code[order], "colon": colons[order],
            "tail": None if tail is None else {"colon": begin + tail if own[tail] == 58 else NONE},
        }

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            keys = [c for c in batch.schema.names if c not in ("__at", "__raw", "__bounds")]
            rows = [
                breaks(raw.encode("latin-1"), at, number * window, np.array(bounds or [], dtype=np.int64))
                for raw, at, number, bounds in zip(*(batch[c].to_pylist() for c in ("__raw", "__at", "__window", "__bounds")), strict=True)
            ]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in _FOUND_ARROW.items()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], names=[*keys, *_FOUND_ARROW])

    return run


_FOUND_ARROW = {
    "begin": pa.int64(), "size": pa.int64(), "at": pa.list_(pa.int64()), "code": pa.list_(pa.int64()), "colon": pa.list_(pa.int64()),
    "tail": pa.struct([("colon", pa.int64())]),
}
_FOUND = "begin long, size long, at array<long>, code array<long>, colon array<long>, tail struct<colon: long>"


def _steps(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, STEP_ROWS) for at in range(0, batch.num_rows, STEP_ROWS))


def _events(row: dict) -> list[tuple[int, int, int]]:
    """Breaks of a window; a source's end whose colon lies in an earlier window takes it from there, or goes."""
    carried = NONE if row["carried"] is None else row["carried"]["colon"]
    events = ((at, code, carried if colon == UNKNOWN else colon) for at, code, colon in zip(row["at"], row["code"], row["colon"], strict=True))
    return [e for e in events if e[1] != SOURCE or e[2] != NONE]


def _walk(events: list[tuple[int, int, int]], start: int, limit: int, begin: int, end: int, out: list | None) -> int:
    """Records that end behind ``begin`` and not behind ``end``, appended to ``out``; returns where the last piece begins."""
    piece = begin - (begin - start) % limit
    for at, code, colon in events:
        # A line end may fill the last byte of a piece; everything else meets the limit first.
        reach = at - 1 if code in (LINE, PAIRED, RETURN) else at
        whole = max(0, (reach - piece) // limit)
        if out is not None:
            out.extend((piece + k * limit, piece + (k + 1) * limit, "bounded") for k in range(whole))
        piece += whole * limit
        if at <= piece or (code == SOURCE and colon < piece):
            continue
        if out is not None:
            size = at - piece
            label = {CONTROL: "control", LINE: "line", SOURCE: "prompt", REST: "text"}.get(code)
            if code == RETURN:
                label = "bounded" if size == limit else "line"
            elif code == PAIRED:
                label = "control" if size == 1 else "line"
            out.append((piece, at, label))
        piece = at
    whole = max(0, (end - piece) // limit)
    if out is not None:
        out.extend((piece + k * limit, piece + (k + 1) * limit, "bounded") for k in range(whole))
    return piece + whole * limit


def _exits(row: dict, limit: int) -> bytes:
    """Where the last piece begins after a window, for each number of bytes that one may have begun before it.

    One value where some break holds whatever came before; nothing where there is no break at all.
    """
    events, begin, end = _events(row), row["begin"], row["begin"] + row["size"]
    if not events:
        return b""
    first = next((i for i, e in enumerate(events) if e[1] != SOURCE), None)
    if first is not None:
        return np.array([_walk(events[first + 1 :], events[first][0], limit, events[first][0], end, None)], np.int64).tobytes()
    places = begin - np.arange(limit, dtype=np.int64)
    for at, _, colon in events:
        piece = places + (at - places) // limit * limit
        places = np.where((at > piece) & (colon >= piece), at, places)
    return places.tobytes()


def _through(begin: int, exits: bytes, place: int, limit: int) -> int:
    """Where the last piece begins after a window, if it began at ``place`` before it."""
    if not exits:
        return place
    return struct.unpack_from("<q", exits, 8 * ((begin - place) % limit) if len(exits) > 8 else 0)[0]


def _both(begin: int, exits: bytes, at: int, own: bytes, limit: int) -> bytes:
    """One map for windows from ``begin`` on and the next one, which begins at ``at``."""
    if len(own) <= 8:
        return own or exits
    places = np.frombuffer(exits, np.int64) if exits else begin - np.arange(limit, dtype=np.int64)
    return np.frombuffer(own, np.int64)[(at - places) % limit].tobytes()


def _changes(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[list[bool], tuple]:
    """Which rows have other keys than the row before, and the keys of the last row."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = tuple(batch[key][0].as_py() for key in keys) != last
    for key in keys:
        values = batch[key].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    return changed.tolist(), tuple(batch[key][batch.num_rows - 1].as_py() for key in keys)


def _joiner(keys: list[str], limit: int):
    """Task function over maps of windows in order: one map for each key and ``__block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, exits, held = None, 0, b"", None

        def made(rows: pa.RecordBatch, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            columns = (pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.binary()), strict=True))
            return pa.RecordBatch.from_arrays([*(rows[c] for c in (*keys, "__block")), *columns], names=[*keys, "__window", "begin", "exits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            changed, last = _changes(batch, [*keys, "__block"], last)
            done: list[tuple[int, bytes]] = []
            ends: list[int] = []
            for i, (new, at, own) in enumerate(zip(changed, batch["begin"].to_pylist(), batch["exits"].to_pylist(), strict=True)):
                if new:
                    if i:
                        ends.append(i - 1)
                        done.append((begin, exits))
                    elif held is not None:
                        yield made(held, [(begin, exits)])
                    begin, exits = at, own
                else:
                    exits = _both(begin, exits, at, own, limit)
            if ends:
                yield made(batch.take(pa.array(ends)), done)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield made(held, [(begin, exits)])

    return run


def _follower(keys: list[str], limit: int):
    """Task function over maps in order: where the last piece begins before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            changed, last = _changes(batch, keys, last)
            starts = []
            for new, at, exits in zip(changed, batch["begin"].to_pylist(), batch["exits"].to_pylist(), strict=True):
                place = 0 if new else place
                starts.append(place)
                place = _through(at, exits, place, limit)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*keys, "__window")), pa.array(starts, pa.int64())], names=[*keys, "__window", "start"])

    return run


def _dealt(rows: DataFrame, keys: list[str], flag: str, *block: str) -> DataFrame:
    """Rows by key and block in the order of windows; those without ``flag`` come before the window they name."""
    return rows.repartition(*keys, *block).sortWithinPartitions(*keys, "__window", F.col(flag).isNotNull())


def _entries(found: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Where the last piece begins before each block of ``FAN_IN`` windows: keys, ``__window`` (the block's first) and ``begin``.

    Maps are walked in order, many keys in a task: once to join each block's, and once over the blocks of a key.
    """
    head = [found.schema[k] for k in keys] + [T.StructField("__window", T.LongType())]
    exit_schema = T.StructType([*head, T.StructField("begin", T.LongType()), T.StructField("exits", T.BinaryType())])
    start_schema = T.StructType([*head, T.StructField("start", T.LongType())])

    def reduced(batches) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            exits = [_exits(row, limit) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in (*keys, "__window", "begin")), pa.array(exits, pa.binary())], names=exit_schema.names)

    windows = found.mapInArrow(reduced, exit_schema).withColumn("__block", F.expr(f"__window div {FAN_IN}"))
    blocks = _dealt(windows, keys, "exits", "__block").mapInArrow(_joiner(keys, limit), exit_schema)
    entered = _dealt(blocks, keys, "exits").mapInArrow(_follower(keys, limit), start_schema)
    return entered.select(*keys, (F.col("__window") * FAN_IN).alias("__window"), F.col("start").alias("begin"))


def stream_records(
    chunks: DataFrame, keys: Sequence[str], order: str, data: str, sources: DataFrame | None = None, max_bytes: int = MAX_BYTES, window: int = WINDOW
) -> DataFrame:
    """Records of rebuilt streams as ranges that cover them exactly: keys, ``ordinal``, ``start``, ``end`` and ``label``.

    ``chunks`` are a stream's bytes in any pieces; neither they nor ``window`` change the result.  ``line`` ends with a line feed, a
    return, or a return and a line feed or null byte; ``control`` is one control byte; ``bounded`` reached ``max_bytes``;
    ``text`` is a rest before a control byte or at the end.  ``sources(keys, at)`` are the positions where a source of a
    server's stream ends: a piece whose last byte but blanks is a colon ends there as ``prompt``.
    """
    if max_bytes < 2 or window < 2:
        raise ValueError("records and windows have at least two bytes")
    keys = list(keys)
    small_partitions(chunks.sparkSession)
    windows = stream_windows(chunks, keys, order, data, window, 1, 1)
    if sources is None:
        bounded = windows.withColumn("__bounds", F.lit(None).cast("array<long>"))
    else:
        # No more positions than a window has bytes.
        ends = sources.where("at > 0").select(*keys, F.expr(f"(at - 1) div {window}").alias("__window"), F.col("at").cast("long").alias("at"))
        bounded = windows.join(ends.groupBy(*keys, "__window").agg(F.collect_set("at").alias("__bounds")), [*keys, "__window"], "left")
    schema = T.StructType([*(windows.schema[k] for k in (*keys, "__window")), *T.StructType.fromDDL(_FOUND)])
    found = cut(bounded.select(*keys, "__window", "__at", "__raw", "__bounds").mapInArrow(_find(window), schema))
    before = scan(found.select(*keys, "__window", "tail"), keys, "__window", {"carried": last_value(F.col("tail"))}).drop("tail")
    found = cut(found.drop("tail").join(before, [*keys, "__window"]))
    out_schema = T.StructType([*(found.schema[k] for k in keys), *T.StructType.fromDDL("start long, end long, label string")])

    def follow(batches) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in _steps(batches):
            rows: list[int] = []
            out: list[tuple[int, int, str]] = []
            for i, row in enumerate(batch.select([c for c in batch.schema.names if c not in keys]).to_pylist()):
                if row["size"] is None:
                    # A block is entered here.
                    place = row["begin"]
                    continue
                place = _walk(_events(row), place, max_bytes, row["begin"], row["begin"] + row["size"], out)
                rows += [i] * (len(out) - len(rows))
            fixed = batch.select(keys).take(pa.array(rows, pa.int64()))
            columns = zip(*out, strict=True) if out else ([], [], [])
            parts = (pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays([*(fixed[k] for k in keys), *parts], names=out_schema.names)

    walked = found.unionByName(_entries(found, keys, max_bytes), allowMissingColumns=True).withColumn("__block", F.expr(f"__window div {FAN_IN}"))
    rows = _dealt(walked, keys, "size", "__block").mapInArrow(follow, out_schema)
    ranked = scan(cut(rows), keys, "start", {"ordinal": row_number()}, span=POSITIONS)
    return ranked.select(*keys, (F.col("ordinal") - 1).alias("ordinal"), "start", "end", "label")


def record_bytes(
    records: DataFrame, chunks: DataFrame, keys: Sequence[str], order: str, data: str, max_bytes: int = MAX_BYTES, window: int = WINDOW
) -> DataFrame:
    """Records with their bytes (``value``) and, for prompts, the name asked for (``prompt``).

    A record begins in one window and reaches at most ``max_bytes`` beyond it, so each is read from one window.
    """
    keys = list(keys)
    windows = stream_windows(chunks, keys, order, data, window, 0, max_bytes)
    placed = records.withColumn("__window", F.expr(f"start div {window}")).join(windows, [*keys, "__window"])
    raw = F.substring("__raw", (F.col("start") - F.col("__at") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return placed.select(*records.columns, F.encode(raw, "ISO-8859-1").alias("value"), F.when(F.col("label") == "prompt", prompt_name(raw)).alias("prompt"))


def stream_matches(
    chunks: DataFrame, keys: Sequence[str], order: str, data: str, scan_text: Callable[[DataFrame], DataFrame], window: int = WINDOW, longest: int = MAX_BYTES
) -> DataFrame:
    """Matches of a text scan over rebuilt streams in stream positions (``start``, ``end``), also across the borders of blocks.

    ``scan_text`` takes rows with the column ``text`` and returns them with ``offset`` and ``value``.  A match of up to ``longest``
    bytes belongs to the window that holds its first byte.
    """
    keys = list(keys)
    windows = stream_windows(chunks, keys, order, data, window, 0, longest).select(
        *keys, F.col("__at"), F.regexp_replace("__raw", "[^\\x00-\\x7f]", "?").alias("text"))
    found = scan_text(windows).where(F.col("offset") < window)
    start = F.col("__at") + F.col("offset")
    return found.select(*[c for c in found.columns if c not in ("__at", "offset")], start.alias("start"), (start + F.octet_length("value")).alias("end"))


def record_sources(records: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which frames supplied which part of each record: keys, ``ordinal``, ``frame_number``, ``record_offset``, ``stream_offset``, ``byte_length``.

    Records and spans (``output_offset``, ``start``, ``end``, ``frame_number``) each cover the output without overlap.  So every place
    where one of them begins opens a part that belongs to the record and the span that began last; one ordered scan over
    both finds them.
    """
    keys = list(keys)
    size = F.col("end") - F.col("start")
    mine = records.where("start < end").select(
        *keys, F.col("start").alias("at"), F.struct("ordinal", "start", "end").alias("record"), F.lit(None).cast("struct<frame: long, end: long>").alias("source"))
    theirs = spans.where("start < end").select(
        *keys, F.col("output_offset").alias("at"), F.lit(None).cast("struct<ordinal: long, start: long, end: long>").alias("record"),
        F.struct(F.col("frame_number").cast("long").alias("frame"), (F.col("output_offset") + size).alias("end")).alias("source"))
    begun = mine.unionByName(theirs).groupBy(*keys, "at").agg(F.max("record").alias("record"), F.max("source").alias("source"))
    walked = scan(cut(begun), keys, "at", {
        "record": last_value(F.col("record"), inclusive=True), "source": last_value(F.col("source"), inclusive=True), "next": lead(F.col("at"))}, span=POSITIONS)
    end = F.least("record.end", "source.end", "next")
    return walked.where((F.col("record.end") > F.col("at")) & (F.col("source.end") > F.col("at"))).select(
        *keys, F.col("record.ordinal").alias("ordinal"), F.col("source.frame").alias("frame_number"),
        (F.col("at") - F.col("record.start")).alias("record_offset"), F.col("at").alias("stream_offset"), (end - F.col("at")).alias("byte_length"))
