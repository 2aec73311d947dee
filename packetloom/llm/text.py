"""Words, hashes and grouped batches as numpy arrays over Arrow columns; shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Rows of whole texts that one Arrow batch holds at most.
BATCH_ROWS = 500

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

#: A-Z to a-z, and the two sets of bytes that part words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def small_batches(spark) -> None:
    """Keep Arrow batches of whole texts small in this session; a smaller setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (an invertible finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, size: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        values = np.full(max(size, SLICE_BYTES + 1), base, dtype=np.uint64)
        values[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(values)
    return known


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null rows are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    if not len(column) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes (one longer row is a range of its own)."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(n, max(end, begin + 1))
        yield begin, end
        begin = end


class Rolling:
    """Hashes of any byte range of one buffer in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[: len(data)], out=self.sums[1:])

    def range(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _powers(_INVERSE, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of some rows: byte ranges, hashes, and for each row the index of its first word (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> None:
        self.data = LOWER[data]
        inside = ~parting[self.data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.rolling = Rolling(self.data)
        self.hashes = self.rolling.range(self.starts, self.ends)

    def text(self, index: int) -> str:
        return self.data[self.starts[index] : self.ends[index]].tobytes().decode("utf-8", "replace")


def word_hash(word: str) -> int:
    """Hash that ``Words`` gives this (lower-cased) word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Rolling(data).range(np.array([0]), np.array([len(data)]))[0])


def binaries(pieces: Iterable[bytes]) -> pa.Array:
    return pa.array(list(pieces), pa.binary())


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches that arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            values = np.asarray(column.fill_null(0)) if not pa.types.is_string(column.type) else np.asarray(column.dictionary_encode().indices)
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(starts, starts[1:], strict=False):
            key = tuple(c[begin].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)
