"""File signatures in byte values: one pass over windows, whatever the size of a value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import cut, small_batches

# Magics in hex, their format and media type.
SIGNATURES = [
    ("89504E470D0A1A0A", "png", "image/png"),
    ("FFD8FF", "jpeg", "image/jpeg"),
    ("504B0304", "zip", "application/zip"),
    ("255044462D", "pdf", "application/pdf"),
    ("526172211A0700", "rar4", "application/vnd.rar"),
    ("526172211A070100", "rar5", "application/vnd.rar"),
    ("1F8B08", "gzip", "application/gzip"),
    ("4D5A", "pe", "application/vnd.microsoft.portable-executable"),
]
# Mark of the far header, where the pointer to it stands, and the flag bits that must be zero.
PE_MARK, PE_POINTER, GZIP_RESERVED = "50450000", 60, 0xE0

WINDOW = 1 << 16
# Windows that one Arrow batch holds at most, and bytes that a task looks at together.
BATCH_ROWS = 500
STEP_BYTES = 1 << 20
# A header field reaches so far beyond the first byte of its magic.
AHEAD = 64


class Automaton:
    """Transitions of all magics at once: a table from (state, byte) to state, and what ends at each state."""

    def __init__(self, words: Sequence[bytes]) -> None:
        steps: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, word in enumerate(words):
            state = 0
            for byte in word:
                if byte not in steps[state]:
                    steps[state][byte] = len(steps)
                    steps.append({})
                    ends.append([])
                state = steps[state][byte]
            ends[state].append(k)
        self.words, self.steps, self.ends = list(words), steps, ends
        self.first = np.zeros(256, dtype=bool)
        self.first[list(steps[0])] = True

    def find(self, data: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Number of a word and the places where it begins and ends before its stop (``stops``: one for each byte, by row).

        All places are followed side by side: from the bytes that begin a word, each state keeps the places that reach it.
        """
        begun = np.flatnonzero(self.first[data])
        left = [(0, begun, 0)]
        while left:
            state, places, depth = left.pop()
            places = places[places + depth < stops[places]]
            byte = data[places + depth]
            for value, after in self.steps[state].items():
                here = places[byte == value]
                if not len(here):
                    continue
                for k in self.ends[after]:
                    yield k, here
                left.append((after, here, depth + 1))


def _scan(keys: list[str], window: int):
    """Task function: hits that begin in a window; far marks are hits of their own, named by an empty format."""
    words = [bytes.fromhex(magic) for magic, _, _ in SIGNATURES] + [bytes.fromhex(PE_MARK)]
    names = [name for _, name, _ in SIGNATURES] + [""]
    automaton = Automaton(words)

    def hits(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(offsets)
        base = batch["__base"].to_numpy()
        total = batch["byte_length"].to_numpy()
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        for k, places in automaton.find(data, offsets[1:][row_of]):
            rows = row_of[places]
            inside = places - offsets[rows] < window
            places, rows = places[inside], rows[inside]
            at = base[rows] + places - offsets[rows]
            far = np.full(len(places), -1, np.int64)
            if names[k] == "gzip":
                good = total[rows] >= at + 4
                good[good] = (data[places[good] + 3] & GZIP_RESERVED) == 0
            elif names[k] == "pe":
                good = total[rows] >= at + AHEAD
                pointer = np.zeros(len(places), np.int64)
                for j in range(4):
                    pointer[good] |= data[places[good] + PE_POINTER + j].astype(np.int64) << (8 * j)
                good &= pointer >= AHEAD
                far = at + pointer
            else:
                good = np.ones(len(places), dtype=bool)
            chosen = pa.array(rows[good])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(chosen) for c in keys), batch["byte_length"].take(chosen), pa.array([names[k]] * len(chosen), pa.string()),
                 pa.array(at[good], pa.int64()), pa.array(far[good], pa.int64())],
                names=[*keys, "byte_length", "format", "offset", "far"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["__piece"]
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(column):
                # Arrays of a step take several times its bytes.
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + STEP_BYTES, "right")) - 1)
                yield from hits(batch.slice(begin, end - begin), whole[ends[begin] : ends[end]], ends[begin : end + 1] - ends[begin])
                begin = end

    return run


def signature_hits(df: DataFrame, data: str, window: int = WINDOW) -> DataFrame:
    """Every position of every known file signature in a binary column: the other columns, byte_length, format and offset.

    A value is read in windows, and few of them at a time, so its size is not bounded by what a task can hold; a hit belongs to the
    window of its first byte, and no hit carries its value.  A hit whose header points far ahead counts where the mark it points
    to stands: both are hits, joined by value and position.  The other columns tell values apart.
    """
    small_batches(df.sparkSession, BATCH_ROWS)
    keys = [c for c in df.columns if c != data]
    size = F.octet_length(F.col(data))
    pieces = df.where(size > 0).select(*keys, size.alias("byte_length"), F.col(data).alias("__data"), F.explode(
        F.sequence(F.lit(0), F.expr(f"(octet_length(`{data}`) - 1) div {window}").cast("int"))).alias("__number"))
    cut_out = pieces.select(
        *keys, "byte_length", (F.col("__number").cast("long") * window).alias("__base"),
        F.substring("__data", F.col("__number") * window + 1, F.lit(window + AHEAD)).alias("__piece"))
    schema = T.StructType([*(cut_out.schema[c] for c in (*keys, "byte_length")), *T.StructType.fromDDL("format string, offset long, far long")])
    found = cut_out.mapInArrow(_scan(keys, window), schema)
    hits = cut(found.where("format <> '' OR byte_length > 0"))
    marks = hits.where("format = ''").select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("offset").alias("__mark"))
    same = F.col("far") == F.col("__mark")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    pointed = hits.where("far >= 0").join(marks, same, "left_semi")
    columns = [*keys, "byte_length", "format", F.col("offset").cast("int").alias("offset")]
    return hits.where("far < 0 AND format <> ''").select(*columns).unionByName(pointed.select(*columns))


def signature_census(hits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per format: hits, values holding one, hits with bytes before them, first and last offset."""
    return hits.groupBy(*scope, "format").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count(F.when(F.col("offset") > 0, 1)).alias("with_prefix"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )
