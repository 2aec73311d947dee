"""Document fingerprints: content-defined chunks by a normalised gear hash, and their digests weighted by length.

The gear hash of a byte depends on the 32 bytes up to it, so that a boundary moves with its text.  Before the normal
length a boundary must pass the harder of two masks, after it the easier; chunks have bounded length.  A fingerprint is
the set of chunk digests with their lengths; containment is the shared length over the smaller text's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.text import Rolling, slices, small_batches

MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 32, 64, 512
HARD, EASY = 7, 4

_GEAR = np.random.default_rng(19991231).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The hash of each place: its byte and the 31 before it, each shifted by its distance."""
    h = _GEAR[data]
    reach = 1
    while reach < 32:
        moved = h.copy()
        moved[reach:] += h[:-reach] << np.uint32(reach)
        h = moved
        reach *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all rows, in order, and the number of chunks of each row.  No boundary is looked for in the
    first 32 bytes of a chunk, so what lies before a row is never part of a hash."""
    h = gear(data) >> np.uint32(32 - HARD)
    easy = np.flatnonzero((h & np.uint32((1 << EASY) - 1)) == 0)
    hard = (h[easy] == 0).tolist()
    places = (easy + 1).tolist()
    first = np.searchsorted(easy + 1, offsets[:-1]).tolist()
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        k, known = first[row], len(ends)
        while end - begin > MIN_BYTES:
            least, normal, most = begin + MIN_BYTES, begin + NORMAL_BYTES, min(begin + MAX_BYTES, end)
            while k < len(places) and places[k] < least:
                k += 1
            at = k
            while at < len(places) and places[at] < normal and not hard[at]:
                at += 1
            begin = places[at] if at < len(places) and places[at] < most else most
            ends.append(begin)
        if end > begin:
            ends.append(end)
        counts[row] = len(ends) - known
    return np.array(ends, np.int64), counts


def fingerprints(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct chunk digests (sorted) and their lengths, for each text.  Repeats of a chunk count once."""
    offsets = np.cumsum([0, *map(len, texts)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in slices(offsets):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        ends, counts = chunk_ends(data, offsets[lo : hi + 1] - offsets[lo])
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        digests = Rolling(data).range(starts, ends)
        at = 0
        for n in counts.tolist():
            distinct, first = np.unique(digests[at : at + n], return_index=True)
            out.append((distinct, (ends - starts)[at : at + n][first]))
            at += n
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared length over the length of the shorter set; 1 for two empty texts, 0 if one is empty."""
    x, y = int(a[1].sum()), int(b[1].sum())
    if not x or not y:
        return float(x == y)
    shared, at, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return float(a[1][at].sum() / min(x, y)) if len(shared) else 0.0


def shown(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """The whole set as text: 16 hex digits of digest and 4 of length for each chunk."""
    digests, lengths = fingerprint
    both = np.empty(len(digests), dtype=[("d", ">u8"), ("n", ">u2")])
    both["d"], both["n"] = digests, lengths
    return both.tobytes().hex()


def _edited(text: str, following: str) -> str:
    part = len(text) // 3
    return text[: len(text) - part] + following[:part] if part else text


def with_next(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """Documents dealt over ``buckets`` ranges of doc_id, one partition each, in descending order, and at the end of each
    partition (role 1) the largest document of the range below, which is the next of its last.

    Only doc_ids are looked at to draw the ranges; the driver keeps two numbers for each partition.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ids = base.select("doc_id")
    shares = [k / buckets for k in range(1, buckets)]
    # Any integers part the ids; all that is compared with them is compared as integers.
    bounds = np.array(sorted({int(b) for b in ids.approxQuantile("doc_id", shares, 0.2 / buckets)}) if shares else [], dtype=np.int64)
    below = np.iinfo(np.int64).min

    def whole(values: pa.Array) -> np.ndarray:
        # A null doc_id is below all others.
        return values.fill_null(below).to_numpy(zero_copy_only=False)

    @F.arrow_udf("int")
    def slot(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, whole(values)).astype(np.int32))

    tops = {r["bucket"]: r["top"] for r in ids.select(slot("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    above = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    highest = {b: below if top is None else top for b, top in tops.items()}

    @F.arrow_udf("array<int>")
    def targets(values: pa.Array) -> pa.Array:
        numbers = whole(values)
        slots = np.searchsorted(bounds, numbers).tolist()
        return pa.array([[2 * b, 2 * above[b] + 1] if highest[b] == v else [2 * b] for b, v in zip(slots, numbers.tolist(), strict=True)], pa.list_(pa.int32()))

    return (
        base.select(F.explode(targets("doc_id")).alias("to"), "doc_id", "text")
        .select(F.floor(F.col("to") / 2).cast("int").alias("bucket"), (F.col("to") % 2).alias("role"), "doc_id", "text")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "role", F.desc_nulls_last("doc_id"), "text")
    )


def edited_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is that with the next smaller doc_id, after the last comes the first; equal doc_ids stand in the
    order of their texts, a null doc_id comes last.  A null text is empty; an empty text has an empty fingerprint, is like
    another empty text (1) and unlike any other (0).  One document alone is its own next.  No rows: no rows.  Other
    columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                columns = [c.to_pylist() for c in batch.slice(begin, 200).columns[1:]]
                held += zip(*columns, strict=True)
                # The last row waits for the one after it; of lent rows only the first is anybody's next.
                if sum(1 for r in held if r[0] == 0) > 1:
                    own = [r for r in held if r[0] == 0]
                    lent = [r for r in held if r[0] == 1]
                    yield _measured(own, names)
                    held = own[-1:] + lent[:1]
        own = [r for r in held if r[0] == 0]
        lent = [r for r in held if r[0] == 1]
        if own:
            yield _measured(own + (lent[:1] or own[-1:]), names)

    return with_next(docs, buckets, text).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _measured(part: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Results of all rows but the last, each against the one after it."""
    texts = [r[2] for r in part]
    plain = fingerprints([t.encode() for t in texts])
    edited = [_edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    changed = fingerprints(edited)
    n = len(part) - 1
    return pa.RecordBatch.from_arrays([
        pa.array([r[1] for r in part[:n]], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([shown(f) for f in plain[:n]]),
        pa.array([shown(f) for f in changed]),
        pa.array([likeness(plain[k], changed[k]) for k in range(n)], pa.float64()),
        pa.array([likeness(plain[k], plain[k + 1]) for k in range(n)], pa.float64()),
    ], names)
