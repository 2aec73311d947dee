"""Benchmark decontamination: windows of training words against a hash set of normalised benchmark n-grams.

The distinct benchmark windows (ten words, or a whole shorter item) are sorted by hash and broadcast; tasks roll over the words
of whole texts, look every window up, and verify each hit against the window's own words.  One pass gives counts, items and
spans.  The set is broadcast only up to a stated number of windows.  A larger set is cut into slices of that size: tasks first
keep the windows whose hash stands in a bitmap of fixed size, and what is left, which is little, is then looked up slice by
slice in passes over these rows alone.  Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.text import MARKS, Words, mix, slices, small_batches, utf8
from packetloom.session import cut, scratch_path

WINDOW = 10
#: Most windows in one broadcast (about 100 bytes each), and the bits of the bitmap before slices.
BROADCAST_WINDOWS = 1_000_000
BITMAP_BITS = 27

#: What parts words, as a pattern over lower-cased text.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_REPORT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", _SPAN),
]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: ``words`` (blank between them), ``size`` in words, and the sorted ``items`` that hold it."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    worded = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w"))
    sized = worded.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = sized.select("item", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("words"))
    return each.groupBy("words", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Rolled:
    """Hashes of any run of words from the hashes of the words."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes) + 1
        self.back = _powers(_INVERSE, n)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(hashes * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the run of ``size`` words that starts at each word; runs may cross rows."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size] + _U(size))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_hashes(texts: list[str]) -> np.ndarray:
    """Hash of each text's whole run of words."""
    data = np.frombuffer(b"\n".join(t.encode() for t in texts), np.uint8)
    sizes = np.array([len(t.encode()) + 1 for t in texts], np.int64)
    words = Words(data, np.concatenate([[0], np.cumsum(sizes)[:-1], [len(data)]]).astype(np.int64), MARKS)
    rolled = Rolled(words.hashes)
    first, count = words.first[:-1], np.diff(words.first)
    return mix((rolled.sums[first + count] - rolled.sums[first]) * rolled.back[first] + count.astype(np.uint64))


class HashSet:
    """Sorted hashes of windows with their words and items, and a small bitmap before the search."""

    SLOTS = 20

    def __init__(self, words: list[str], sizes: list[int], items: list[list[str]]) -> None:
        hashes = text_hashes(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.words = [words[i].encode() for i in order]
        self.items = [items[i] for i in order]
        self.sizes = sorted(set(sizes))
        self.slots = np.zeros(1 << self.SLOTS, dtype=bool)
        self.slots[self.hashes >> _U(64 - self.SLOTS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are in the set, and where in the set (the first of equal ones)."""
        at = np.flatnonzero(self.slots[hashes >> _U(64 - self.SLOTS)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == len(self.hashes)] = 0
        real = self.hashes[place] == hashes[at]
        return at[real], place[real]

    def verified(self, place: int, words: bytes) -> list[str] | None:
        """Items of the window with just these words; windows of equal hash stand side by side."""
        value = self.hashes[place]
        while place < len(self.hashes) and self.hashes[place] == value:
            if self.words[place] == words:
                return self.items[place]
            place += 1
        return None


class Texts:
    """Words of some rows, the hashes of their windows, and their spelling with one blank between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words = Words(data, offsets, MARKS)
        self.first = self.words.first
        self.rolled = Rolled(self.words.hashes)
        self.row_end = np.repeat(self.first[1:], np.diff(self.first))

    def candidates(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows that stay in their row, and their hashes."""
        hashes = self.rolled.windows(size)
        starts = np.arange(len(hashes))
        inside = starts + size <= self.row_end[: len(hashes)]
        return starts[inside], hashes[inside]

    def spelling(self, start: int, size: int) -> bytes:
        w = self.words
        return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[start : start + size], w.ends[start : start + size], strict=True))


def _report(n_words: list[int], marks: list[list[tuple[int, int]]], items: list[set[str]]) -> list[pa.Array]:
    """Columns of the report from each row's windows (first word, word after) and items."""
    hit, shas, spans = [], [], []
    for found, names in zip(marks, items, strict=True):
        runs: list[dict] = []
        for first, stop in sorted(found):
            if runs and first <= runs[-1]["last"] + 1:
                runs[-1]["last"] = max(runs[-1]["last"], stop - 1)
            else:
                runs.append({"first": first, "last": stop - 1})
        spans.append(runs)
        hit.append(sum(r["last"] - r["first"] + 1 for r in runs))
        shas.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return [
        pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(shas, pa.string()),
        pa.array([h > 0 for h in hit], pa.bool_()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]


def _scan(known):
    """Task function: the report of every row, appended to its columns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        found = known.value
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for begin, end in slices(offsets):
                low, high = offsets[begin], offsets[end]
                texts = Texts(data[low:high], offsets[begin : end + 1] - low)
                marks: list[list[tuple[int, int]]] = [[] for _ in range(end - begin)]
                items: list[set[str]] = [set() for _ in range(end - begin)]
                for size in found.sizes:
                    starts, hashes = texts.candidates(size)
                    at, place = found.find(hashes)
                    rows = np.searchsorted(texts.first, starts[at], "right") - 1
                    for start, where, row in zip(starts[at].tolist(), place.tolist(), rows.tolist(), strict=True):
                        holders = found.verified(where, texts.spelling(start, size))
                        if holders is not None:
                            own = start - int(texts.first[row])
                            marks[row].append((own, own + size))
                            items[row].update(holders)
                report = _report(np.diff(texts.first).tolist(), marks, items)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, end - begin) for k in range(batch.num_columns - 1)), *report],
                    names=[*batch.schema.names[:-1], *(f.name for f in _REPORT)])

    return run


def _survivors(bitmap, sizes: list[int]):
    """Task function: windows of each row whose hash stands in the bitmap, and the row's number of words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bits, shift = bitmap.value, _U(64 - BITMAP_BITS)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = batch["row"].to_numpy()
            for begin, end in slices(offsets):
                low, high = offsets[begin], offsets[end]
                texts = Texts(data[low:high], offsets[begin : end + 1] - low)
                count = np.diff(texts.first)
                rows, firsts, lengths, values, words = [ids[begin:end]], [np.full(end - begin, -1)], [count], [np.zeros(end - begin, np.int64)], [""] * (end - begin)
                for size in sizes:
                    starts, hashes = texts.candidates(size)
                    slot = hashes >> shift
                    at = np.flatnonzero((bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1)
                    row = np.searchsorted(texts.first, starts[at], "right") - 1
                    rows.append(ids[begin:end][row])
                    firsts.append(starts[at] - texts.first[row])
                    lengths.append(np.full(len(at), size))
                    values.append(hashes[at].view(np.int64))
                    words.extend(texts.spelling(s, size).decode("utf-8", "replace") for s in starts[at].tolist())
                yield pa.record_batch({
                    "row": np.concatenate(rows).astype(np.int64), "first": np.concatenate(firsts).astype(np.int64),
                    "size": np.concatenate(lengths).astype(np.int64), "hash": np.concatenate(values).astype(np.int64), "words": pa.array(words, pa.string())})

    return run


def _looked_up(known):
    """Task function: of the surviving windows, those of this slice of the set, with their items."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        found = known.value
        for batch in batches:
            at, place = found.find(batch["hash"].to_numpy().view(np.uint64))
            held = [(i, found.verified(p, batch["words"][i].as_py().encode())) for i, p in zip(at.tolist(), place.tolist(), strict=True)]
            real = [(i, names) for i, names in held if names is not None]
            kept = batch.take(pa.array([i for i, _ in real], pa.int64()))
            yield pa.record_batch({"row": kept["row"], "first": kept["first"], "size": kept["size"], "items": pa.array([n for _, n in real], pa.list_(pa.string()))})

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the hashes of all windows, joined from pieces of fixed size."""
    def hashed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (text_hashes(batch["words"].to_pylist()) >> _U(64 - BITMAP_BITS)).astype(np.int64)
            yield pa.record_batch({"piece": slot >> 19, "byte": (slot >> 3) & 0xFFFF, "bit": np.int64(1) << (slot & 7)})

    def piece(group: pa.Table) -> pa.Table:
        values = np.zeros(1 << 16, dtype=np.uint8)
        values[group["byte"].to_numpy()] = group["bits"].to_numpy()
        return pa.table({"piece": group["piece"][:1], "values": pa.array([values.tobytes()], pa.binary())})

    bytes_ = windows.select("words").mapInArrow(hashed, "piece long, byte long, bit long").groupBy("piece", "byte").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << BITMAP_BITS - 3, dtype=np.uint8)
    # At most one row for each piece of the bitmap.
    for row in bytes_.groupBy("piece").applyInArrow(piece, "piece long, values binary").collect():
        out[row["piece"] << 16 : row["piece"] + 1 << 16] = np.frombuffer(row["values"], np.uint8)
    return out


def _hash_set(windows: DataFrame) -> HashSet:
    rows = windows.select("words", "size", "items").toArrow()
    return HashSet(rows["words"].to_pylist(), rows["size"].to_pylist(), rows["items"].to_pylist())


def _by_slices(docs: DataFrame, windows: DataFrame, total: int, most: int, own: list[str], text: Column) -> DataFrame:
    """The report where the windows are too many for one broadcast."""
    spark = docs.sparkSession
    context = spark.sparkContext
    numbered = cut(docs.select(*own, text.alias("__text"), F.monotonically_increasing_id().alias("__row")))
    # Fewer than the windows' length; read from the data.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    left = cut(numbered.select(F.col("__row").alias("row"), F.col("__text").alias("text")).mapInArrow(
        _survivors(context.broadcast(_bitmap(windows)), sizes), "row long, first long, size long, hash long, words string"))
    count = ceil(total / most) + 1
    sliced = scratch_path(spark, "windows")
    windows.withColumn("slice", F.pmod(F.xxhash64("words"), F.lit(count)).cast("int")).write.partitionBy("slice").parquet(sliced)
    parts = spark.read.schema("words string, size int, items array<string>, slice int").parquet(sliced)
    hits = None
    for k in range(count):
        known = context.broadcast(_hash_set(parts.where(F.col("slice") == k)))
        some = cut(left.where("first >= 0").mapInArrow(_looked_up(known), "row long, first long, size long, items array<string>"))
        hits = some if hits is None else hits.union(some)
    # No more windows than a text has words; texts are the rows of the input.
    gathered = hits.groupBy("row").agg(
        F.collect_list(F.struct("first", (F.col("first") + F.col("size")).alias("stop"))).alias("marks"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = left.where("first < 0").select("row", F.col("size").alias("n_words")).join(gathered, "row", "left").select(
        "row", F.struct("n_words", "marks", "items").alias("found"))

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["found"].to_pylist()
            marks = [[(m["first"], m["stop"]) for m in f["marks"] or []] for f in found]
            report = _report([f["n_words"] for f in found], marks, [set(f["items"] or []) for f in found])
            yield pa.RecordBatch.from_arrays([batch["row"], *report], names=["row", *(f.name for f in _REPORT)])

    done = counted.mapInArrow(finish, T.StructType([T.StructField("row", T.LongType()), *_REPORT])).withColumnRenamed("row", "__row")
    return numbered.drop("__text").join(done, "__row").select(*own, *(f.name for f in _REPORT))


def scan_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS, keep: list[str] | None = None,
) -> DataFrame:
    """Columns of ``docs`` (or those in ``keep``) and, for each row, n_words, n_hit, n_items, items_sha256, contaminated and ``spans``.

    Words are lower-cased (A-Z) and parted by ASCII bytes other than letters and digits.  ``spans`` are maximal runs of hit words
    (first and last, from 0).  Null or empty texts have no words.  Items without words give no window; equal item ids are one
    item; a null item id is an item spelled as empty text.  Every row is reported, also repeated ones; columns with the names
    of the new ones are replaced.  No benchmark: nothing is hit.  No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in _REPORT}]
    windows = cut(benchmark_windows(benchmark, window, item, item_text))
    total = windows.count()
    whole = F.col(text).cast("string")
    if total > broadcast_windows:
        return _by_slices(docs, windows, total, broadcast_windows, own, whole)
    known = spark.sparkContext.broadcast(_hash_set(windows))
    schema = T.StructType([*(docs.schema[c] for c in own), *_REPORT])
    return docs.select(*own, whole.alias("__text")).mapInArrow(_scan(known), schema)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its runs of words ``spans`` (the bytes from a run's first word to the end of its last)."""
    return _cut_spans(text.cast("string"), spans)


@F.pandas_udf(T.StringType())
def _cut_spans(text, spans):
    out = text.copy()
    for k, (value, runs) in enumerate(zip(text, spans, strict=True)):
        if value is None or runs is None or not len(runs):
            continue
        data = np.frombuffer(value.encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), MARKS)
        keep = np.ones(len(data), dtype=bool)
        for run in runs:
            keep[words.starts[run["first"]] : words.ends[run["last"]]] = False
        out.iloc[k] = data[keep].tobytes().decode()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **options) -> DataFrame:
    """``docs`` without contamination: hit runs of words cut out of the texts (``spans``), or contaminated rows left out (``documents``).

    Takes the options of ``scan_contamination`` and returns the columns of ``docs``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    kept = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__body"))
    found = scan_contamination(kept, benchmark, "__body", **options)
    if remove == "documents":
        return found.where("NOT contaminated").select("__doc.*")
    clean = F.when(F.col("contaminated"), without_spans(F.col("__body"), F.col("spans"))).otherwise(F.col("__body"))
    return found.select(*((clean if c == text else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns))
