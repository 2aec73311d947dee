"""Vector codes by product quantisation in exact integers: distances from limb-split matrix products.

Components become integers.  Squared distances between parts and codebook entries are |x|^2 - 2 x.c + |c|^2, where the dot
products are matrix products of limbs: integers are broken into limbs so small that every float64 product sum stays below
2**53, so BLAS gives exact integers in any order of summation, which are put together in int64.  Each round is one pass that
leaves sums and counts of a task's parts for each entry; these are integers too, so neither the partitions nor a repeated
task change a codebook.  Only codebooks (16 entries a part) travel through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import cut

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels with more than this share of all rows number fewer than its inverse, so their sums are broadcast.
HOT_SHARE = 1 / 256

#: Limit of a component's size: with it and rows of up to 2**15 components a distance stays in 63 bits.
LARGEST = 1 << 22


def limbs(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Float64 limbs of int64 values, lowest first: all but the last in [0, 2**bits), the last with the sign."""
    out = []
    for _ in range(count - 1):
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    out.append(values.astype(np.float64))
    return out


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices in exact arithmetic, through float64 products of limbs.

    The result must fit an int64; the limbs take care of everything between.
    """
    width = x.shape[1]
    if not width or not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    bits = (53 - int(width).bit_length()) // 2
    need = [max(1, -(-(int(np.abs(m).max()).bit_length() + 1) // bits)) for m in (x, c)]
    out = np.zeros((len(x), len(c)), np.int64)
    low = [limbs(m, bits, n) for m, n in zip((x, c), need, strict=True)]
    for i, a in enumerate(low[0]):
        for j, b in enumerate(low[1]):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``c`` (the lowest of equally near ones) for each row of ``x``, and the squared distance."""
    if not len(c):
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    far = (c * c).sum(axis=1) - 2 * exact_products(x, c)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)


def borders(dims: int, parts: int) -> list[int]:
    """Borders of the parts: equal ones, or the first ones longer by one where ``dims`` does not divide."""
    return [0, *np.cumsum([len(p) for p in np.array_split(np.arange(dims), parts)]).tolist()]


Codebooks = dict[int, list[np.ndarray]]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each length in a batch: length, rows and matrix."""
    column = batch["v"]
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield dims, rows, values.reshape(len(rows), dims)


def _sums(books, parts: int):
    """Task function: sums and counts of the task's parts at their nearest entries, by length, part, entry and position.

    The count stands at position -1.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dims, _, matrix in _matrices(batch):
                cuts, entries = borders(dims, parts), books.value[dims]
                table = held.setdefault(dims, [np.zeros((len(e), b - a + 1), np.int64) for e, a, b in zip(entries, cuts, cuts[1:], strict=False)])
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = np.ascontiguousarray(matrix[:, a:b])
                    best, _ = nearest(part, entries[p])
                    order = np.argsort(best, kind="stable")
                    used, first, n = np.unique(best[order], return_index=True, return_counts=True)
                    table[p][used, 0] += n
                    if b > a:
                        table[p][used, 1:] += np.add.reduceat(part[order], first, axis=0)
        for dims, tables in held.items():
            for p, table in enumerate(tables):
                entry, position = np.nonzero(np.broadcast_to(table[:, :1] > 0, table.shape))
                yield pa.record_batch({
                    "dims": np.full(len(entry), dims, np.int64), "part": np.full(len(entry), p, np.int64),
                    "entry": entry.astype(np.int64), "position": position.astype(np.int64) - 1, "total": table[entry, position]})

    return run


def _codes(books, parts: int):
    """Task function: code and error of each vector, in place of the vector."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for dims, rows, matrix in _matrices(batch):
                cuts = borders(dims, parts)
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    best, far = nearest(np.ascontiguousarray(matrix[:, a:b]), books.value[dims][p])
                    code[rows, p] = best
                    error[rows] += far
            spelled = [code[k].tobytes().hex() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(spelled, pa.string()), pa.array(error)], names=[*batch.schema.names[:-1], "code", "error"])

    return run


def integer_vectors(vectors: DataFrame, keep: list[str], column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``keep`` and ``v``, the components as floor(scale * x), of vectors without null or non-finite components."""
    x = F.col(column)
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(whole).select(*keep, F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def fit_codebooks(kept: DataFrame, order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks by length of the vectors ``v``: for each part an array of entries.

    They start as the parts of the ``entries`` smallest rows by ``order`` (nulls last, then by the vector itself); fewer rows give
    fewer entries, repeated rows equal entries, of which the later ones stay unused.
    """
    context = kept.sparkSession.sparkContext
    books: Codebooks = {}
    bounds = kept.groupBy(F.size("v").alias("dims")).agg(
        F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), F.negate(F.coalesce(F.array_min("v"), F.lit(0))))).alias("largest")).collect()
    for row in bounds:
        if row["largest"] > LARGEST:
            raise ValueError(f"a component of size {row['largest']} after scaling is over {LARGEST}")
        first = kept.where(F.size("v") == row["dims"]).orderBy(F.asc_nulls_last(order), "v").limit(entries).select("v").collect()
        matrix = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), row["dims"])
        cuts = borders(row["dims"], parts)
        books[row["dims"]] = [matrix[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds if books else 0):
        known = context.broadcast(books)
        # One number for each position of each entry: no more than the codebooks hold.
        totals = kept.select("v").mapInArrow(_sums(known, parts), "dims long, part long, entry long, position long, total long").groupBy(
            "dims", "part", "entry", "position").agg(F.sum("total").alias("total")).toArrow()
        dims, part, entry, position, total = (totals[c].to_numpy() for c in ("dims", "part", "entry", "position", "total"))
        fresh: Codebooks = {d: [e.copy() for e in tables] for d, tables in books.items()}
        count = {(d, p, e): n for d, p, e, at, n in zip(dims, part, entry, position, total, strict=True) if at < 0}
        for d, p, e, at, n in zip(dims, part, entry, position, total, strict=True):
            if at >= 0:
                fresh[d][p][e, at] = n // count[d, p, e]
        books = fresh
        known.unpersist()
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' decimal components by length, part, entry and position, joined by commas."""
    numbers = (str(x) for d in sorted(books) for table in books[d] for x in table.ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _label_sums(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together; labels that hold a large share are not shuffled."""
    sums = cut(coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")))
    rows = sums.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    named = sums.select(F.col(label).alias("__label"), "label_error", "__n")
    # Fewer than 1 / HOT_SHARE rows.
    hot = named.where(F.col("__n") > HOT_SHARE * rows).withColumn("__hot", F.lit(True))
    spread = coded.join(F.broadcast(hot), F.col(label).eqNullSafe(F.col("__label")), "left")
    done = spread.where("__hot").select(*coded.columns, "label_error")
    rest = spread.where("__hot IS NULL").select(*coded.columns).join(
        named.where(F.col("__n") <= HOT_SHARE * rows), F.col(label).eqNullSafe(F.col("__label"))).select(*coded.columns, "label_error")
    return done.union(rest)


def compress(
    vectors: DataFrame, column: str = "embedding", order: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``order``, ``label``, code, error, label_error and codebooks_sha256 of each vector that is kept.

    Vectors that are null or hold null or non-finite components are dropped.  Codes have two hex digits a part.  Vectors of each
    length have codebooks of their own; a length that the parts do not divide gives longer first parts.  Repeated rows are coded
    each; null ids come last in the order.  A scaled component over ``LARGEST`` raises an error, as distances could pass 63 bits.
    Other columns are ignored.  No rows: no rows.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits")
    kept = cut(integer_vectors(vectors, [order, label], column, scale))
    books = fit_codebooks(kept, order, parts, entries, rounds)
    known = kept.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([kept.schema[order], kept.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = cut(kept.mapInArrow(_codes(known, parts), schema))
    return _label_sums(coded, label).withColumn("codebooks_sha256", F.lit(digest(books)))
