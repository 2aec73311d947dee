"""Phrase collocations by dynamic itemset counting: lengths are counted side by side in cyclic scans of shards.

The corpus is written once, dealt over a few shards, and one shard is scanned per step, round and round.  Words are counted
from the first step on.  A longer phrase becomes active at the step after both its subphrases (all but its last word, all
but its first) have reached the threshold in what was counted so far, and stays active for one full cycle, so each of its
occurrences is counted once.  Counting ends a full cycle after the last phrase that could activate others.

Tasks know when phrases reached the threshold from a table of ``2 ** SLOT_BITS`` bytes, whatever the corpus: by hash, the first
step at which a phrase of this slot did.  A slot is set once and for all, and a phrase's step is the latest of its slot's and its
subphrases' steps.  So phrases that share a slot may only become active earlier, for one full cycle still, and all counts are
exact.  Counts are kept in a ledger table keyed by the phrase itself;
phrases that end their cycle below the threshold leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.text import LOWER, Rolling, mix, slices, small_batches, utf8, word_hash
from packetloom.session import cut, scratch_path

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
SHARDS = 3
SLOT_BITS = 24
CHUNK_BYTES = 8 << 20
UNKNOWN = "und"
#: Languages with more than this share of all words number fewer than its inverse, so their totals are broadcast.
HOT_SHARE = 1 / 256

#: Bytes that part words inside a piece, and bytes that part pieces.
BLANKS = b" \t"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True

#: Lower-cased bytes of words; blanks and breaks as one byte.
_SPELLED = np.where(_BLANK | _BREAK, np.uint8(32), LOWER)

_COUNTED = "lang string, phrase string, n long, end int"
_LEDGER = f"{_COUNTED}, reach int"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of some rows: spelling buffer with one blank between words, places in it, hashes, rows, and whether a word
    and the one after it stand in one piece."""
    # Words keep their bytes, all between them is one blank byte each; the rest goes by word, since bytes are many.
    breaks = np.flatnonzero(_BREAK.take(data))
    data = _SPELLED.take(data)
    inside = data != 32
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = inside & edge[:-1], inside & edge[1:]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    joined = np.ones(len(starts) + 1, dtype=bool)
    # A piece ends with the word before a break or before another row's words; with no word before, the place past all is meant.
    joined[first - 1] = False
    joined[np.searchsorted(starts, breaks) - 1] = False
    joined = joined[:-1]
    hashes = Rolling(data).range(starts, ends)
    blank = ~inside.take(ends, mode="clip")
    blank[ends == n] = False
    inside[ends[blank]] = True
    sizes = ends - starts
    place = np.cumsum(sizes + blank) - sizes - blank
    return data[inside], place, place + sizes, hashes, rows, joined


def _salts(langs: list[str]) -> np.ndarray:
    """What languages add to the hashes of first words; never hashes of words, since `es` is a word in `de` and `de` one in `es`."""
    return mix(np.array([word_hash(name) for name in langs], dtype=np.uint64)) * _STEP


class _Chunk:
    """Words of some rows of a task, held until there are enough to count."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[None]:
        """Take a batch; yields whenever the chunk is full."""
        data, offsets = utf8(batch["text"])
        names = batch["lang"].to_pylist()
        ids = np.array([self.langs.setdefault(name, len(self.langs)) for name in names], dtype=np.int32)
        for begin, end in slices(offsets):
            low, high = offsets[begin], offsets[end]
            spelling, starts, ends, hashes, rows, joined = _tokens(data[low:high], offsets[begin : end + 1] - low)
            self.parts.append((spelling, starts + self.size, ends + self.size, hashes, ids[begin:end][rows], joined))
            self.size += len(spelling)
            if self.size >= CHUNK_BYTES:
                yield None
                self.clear()

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*self.parts, strict=True)]


def _spelled(spelling: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    places = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=places[1:])
    at = np.repeat((starts - places[:-1]).astype(np.int32), sizes) + np.arange(places[-1], dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(spelling[at])])


def _scanner(step: int, table, max_words: int, shards: int, slot_bits: int):
    """Task function for one step: counts per chunk of all words (in the first cycle) and of the active longer phrases, each with
    the last step of its cycle.  An empty phrase counts all words of a language."""

    def counted(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        spelling, starts, ends, hashes, langs, joined = chunk.arrays()
        names = pa.array(list(chunk.langs), pa.string())

        def rows(k: int, h: np.ndarray, at: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(h)
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            first = np.flatnonzero(new)
            one = order[first]
            where = at[one]
            return pa.record_batch({
                "lang": names.take(pa.array(langs[where])), "phrase": _spelled(spelling, starts[where], ends[where + k - 1]),
                "n": np.diff(first, append=len(h)).astype(np.int64), "end": last[one].astype(np.int32)})

        if not len(hashes):
            return
        h = mix(_salts(list(chunk.langs))[langs] + hashes)
        if step <= shards:
            whole_cycle = np.full(len(h), shards)
            yield pa.record_batch({
                "lang": names, "phrase": pa.array([""] * len(names), pa.string()),
                "n": np.bincount(langs, minlength=len(names)).astype(np.int64), "end": whole_cycle[:1].repeat(len(names)).astype(np.int32)})
            yield rows(1, h, np.arange(len(h)), whole_cycle)
        known, shift = table.value, _U(64 - slot_bits)
        # First steps of the phrases that start at each word, and the starts where both subphrases have one.
        reach = np.append(known[h >> shift], np.uint8(0))
        at = np.flatnonzero(joined & (reach[:-1] > 0) & (reach[1:] > 0))
        h = h[at]
        for k in range(2, max_words + 1):
            if not len(at):
                return
            h = mix(h * _STEP + hashes[at + k - 1])
            last = np.maximum(reach[at], reach[at + 1])
            active = last >= step - shards
            if active.any():
                yield rows(k, h[active], at[active], last[active].astype(np.int32) + shards)
            own = known[h >> shift]
            # A slot that another phrase set counts from where both subphrases have a step.
            own = np.where(own > 0, np.maximum(own, last), np.uint8(0))
            reach = np.zeros(len(hashes) + 1, dtype=np.uint8)
            reach[at] = own
            both = (own > 0) & (reach[at + 1] > 0)
            at, h = at[both], h[both]

    def run(batches) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for _ in chunk.add(batch):
                yield from counted(chunk)
        if chunk.parts:
            yield from counted(chunk)

    return run


def _slots(max_words: int, slot_bits: int):
    """Task function: slots of phrases of fewer than ``max_words`` words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                words = phrase.split(" ")
                if len(words) < max_words:
                    hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
                    h = mix(_salts([lang]) + hashes[:1])
                    for one in hashes[1:]:
                        h = mix(h * _STEP + one)
                    out.append(int(h[0] >> _U(64 - slot_bits)))
            yield pa.record_batch({"slot": pa.array(out, pa.int64())})

    return run


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shards: int = SHARDS,
    slot_bits: int = SLOT_BITS,
) -> DataFrame:
    """lang, phrase, k (words) and n of all phrases of up to ``max_words`` words with n >= ``min_count``, and for each
    language a row with k = 0 and all its words.

    Occurrences are contiguous words of one piece, overlaps included; words are lower-cased (A-Z).  A null text is empty, a null
    language is ``und``.  Repeated rows count each.  In a chunk of a few megabytes, phrases are told apart by 64 bits of hash,
    across chunks by their words.  No rows: no rows.
    """
    if shards * max_words > 255:
        raise ValueError("steps must fit a byte")
    spark = docs.sparkSession
    small_batches(spark)
    corpus = scratch_path(spark, "shards")
    docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    ).write.partitionBy("shard").parquet(corpus)
    parts = spark.read.schema("lang string, text string, shard int").parquet(corpus)

    slots = np.zeros(1 << slot_bits, dtype=np.uint8)
    ledger, path, step, last = None, None, 0, 0
    while step < last + shards:
        step += 1
        table = spark.sparkContext.broadcast(slots)
        rows = parts.where(F.col("shard") == (step - 1) % shards).select("lang", "text").mapInArrow(
            _scanner(step, table, max_words, shards, slot_bits), _COUNTED).withColumn("reach", F.lit(None).cast("int"))
        merged = (rows if ledger is None else rows.union(ledger)).groupBy("lang", "phrase").agg(
            F.sum("n").alias("n"), F.max("end").alias("end"), F.max("reach").alias("reach"))
        previous, path = path, scratch_path(spark, "phrases")
        merged.where((F.col("end") > step) | (F.col("n") >= min_count) | (F.col("phrase") == "")).select(
            "lang", "phrase", "n", "end", F.coalesce("reach", F.when(F.col("n") >= min_count, F.lit(step))).alias("reach")).write.parquet(path)
        ledger = spark.read.schema(_LEDGER).parquet(path)
        if previous is not None:
            _forget(spark, previous)
        table.unpersist()
        # No more rows than the table has slots.
        fresh = ledger.where((F.col("reach") == step) & (F.col("phrase") != "")).select("lang", "phrase").mapInArrow(
            _slots(max_words, slot_bits), "slot long").distinct().toArrow()["slot"].to_numpy()
        if len(fresh):
            last = step
            slots = slots.copy()
            slots[fresh[slots[fresh] == 0]] = step
    _forget(spark, corpus)
    k = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return ledger.where((F.col("phrase") == "") | (F.col("n") >= min_count)).select("lang", "phrase", k.alias("k"), "n")


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
    shards: int = SHARDS, slot_bits: int = SLOT_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations.

    A candidate has at least two words and a = its count.  Of its cuts into a first part (count l) and a rest (count r) the one
    with the lowest floor(1000 * a * n / (l * r)) counts, ties to the shortest first part; n counts the language's words.
    Candidates inside a longer one with the same count are dropped (a one-word longer one suffices, since counts never rise with
    length).  Order: score and a descending, phrase ascending by its UTF-8 bytes.  See ``frequent_phrases`` for the rest.
    """
    found = frequent_phrases(docs, text, lang, min_count, max_words, shards, slot_bits)
    totals = found.where("k = 0").select("lang", F.col("n").alias("all"))
    known = found.where("k > 0").select("lang", "phrase", "n")
    words = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    subs = words.where("k > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.expr("slice(w, 1, k - 1)"), " "), F.array_join(F.expr("slice(w, 2, k - 1)"), " "))).alias("phrase"))
    left = words.join(subs, ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select(
        "lang", "phrase", "a", "at", F.array_join(F.expr("slice(w, 1, at)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, at + 1, size(w) - at)"), " ").alias("rest"))
    sized = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    sized = _with_total(sized, totals)
    # Exact: 38 digits hold 1000 * a * n and l * r far beyond 64 bits; div rounds down (all are positive).
    score = F.expr("(cast(a * 1000 as decimal(19, 0)) * cast(all as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = sized.select("lang", "phrase", "a", F.col("all").alias("n"), F.struct(score.alias("score"), "at", "l", "r").alias("cut")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("cut").alias("cut"))
    scored = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    return _ranked(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _with_total(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` with all words of their language; languages with a large share of all words are not shuffled."""
    words = totals.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    # Fewer than 1 / HOT_SHARE rows.
    hot = totals.where(F.col("all") > HOT_SHARE * words).withColumn("__hot", F.lit(True))
    near = rows.join(F.broadcast(hot), "lang", "left")
    rest = near.where("__hot IS NULL").select(*rows.columns).join(totals.where(F.col("all") <= HOT_SHARE * words), "lang")
    return near.where("__hot").drop("__hot").unionByName(rest)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, without putting a language into one task.

    Rows are dealt over ranges of the whole order; a row's rank is its place in its range after the rows of the language in
    earlier ranges.
    """
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(scored.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # One row for each language in a range: no more than ranges and languages together.
    sizes = dealt.groupBy("lang", "range").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("lang").orderBy("range")) - F.col("size")).drop("size")
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return dealt.join(before, ["lang", "range"]).withColumn("rank", (F.col("before") + place).cast("long")).where(F.col("rank") <= top)
