"""Exact Jaccard join of documents on word shingles: size-banded tiles, bitmap bounds, exact intersection.

Steps, each a Spark stage over all documents:

1. every text becomes a set of shingle hashes; equal sets are one class (exact copies are never compared);
2. the hashes are shuffled once, packed, to count in how many classes each occurs.  A hash of one class only can be
   in no overlap, so only the others go back to their class;
3. a class whose rarest ``n - ceil(t * n) + 1`` hashes are all its own has no partner and ends here.  The others
   enter tiles (hash of that prefix, size band).  Of two sets that reach the threshold, the larger one shares a tile with
   the rarest ``n - ceil(2 * t / (1 + t) * n) + 1`` hashes of the smaller one, which leads there (``first``); so the many
   sets that only share one frequent passage follow in its tiles, and none of them leads;
4. in each tile all members are held against one that leads; linked ones are contracted to components;
5. what a tile still holds of different components is compared, leading against following ones, in blocks, under the
   bitmap bound.

Bitmaps bound the overlap from above: every bit set in one of two bitmaps only stands for a hash of one set only.
What passes is decided by intersecting the sorted arrays.  Nothing is capped and no link is lost; pairs inside a
component that is already linked are skipped, so a group of thousands of copies costs a row per member and tile.

Hashes have 64 bits (48 and the partition's 16 after the shuffle); a class is known by a 64-bit digest and its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.text import SPACES, Words, binaries, grouped, mix, slices, small_batches, utf8
from packetloom.session import cut

WORDS = 5
PERCENT = 75
TOKENS_PER_PART = 1_500_000
HELD_TOKENS = 1_000_000
BLOCK = 2_048
BITMAP_WORDS = 16
HEAVY_KEYS = 10_000
BAND = log(4 / 3)

_U = np.uint64
_PLACE = mix(np.arange(1, 64, dtype=np.uint64)) | _U(1)
_LOW = _U((1 << 48) - 1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    data, offsets = utf8(column)
    for begin, end in slices(offsets):
        base = offsets[begin]
        found = Words(data[base : offsets[end]], offsets[begin : end + 1] - base, SPACES)
        w, first = found.hashes, found.first
        rolled = np.zeros(max(0, len(w) - words + 1), dtype=np.uint64)
        for k in range(words):
            rolled += w[k : k + len(rolled)] * _PLACE[k]
        rolled = mix(rolled)
        for row in range(end - begin):
            lo, hi = int(first[row]), int(first[row + 1])
            if hi - lo >= words:
                yield begin + row, np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                whole = (w[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64, keepdims=True) ^ _PLACE[50 + hi - lo]
                yield begin + row, mix(whole)
            else:
                yield begin + row, np.zeros(0, np.uint64)


def _digest(hashes: np.ndarray) -> int:
    return int(mix(np.array([mix(hashes ^ _PLACE[60]).sum(dtype=np.uint64)]))[0])


def shingle_classes(docs: DataFrame, text: str = "text", words: int = WORDS, key: list | None = None) -> DataFrame:
    """doc_id, n_shingles and the class digest (null without words) of every document; ``key`` columns ride along."""

    def run(batches):
        for batch in batches:
            sizes, digests = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, hashes in shingle_sets(batch.column(1), words):
                sizes[row] = len(hashes)
                if len(hashes):
                    digests[row] = int(np.uint64(_digest(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digests, pa.int64()), *batch.columns[2:]], names)

    narrow = docs.select("doc_id", F.col(text).cast("string").alias("text"), *(key or []))
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[2:])
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_shingles", "class_id", *narrow.columns[2:]]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_shingles long, class_id long{extra}")


def _packed(part: np.ndarray, owner: np.ndarray, tokens: np.ndarray, parts: int):
    """Order by part, keep owners together; (part, slice) of each part and the runs of owners in it."""
    order = np.argsort(part, kind="stable")
    part, owner, tokens = part[order], owner[order], tokens[order]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        lo, hi = int(bounds[p]), int(bounds[p + 1])
        if hi > lo:
            own = owner[lo:hi]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield p, order[lo:hi], own[heads], np.diff(np.r_[heads, hi - lo]), tokens[lo:hi]


def _spread(docs: DataFrame, text: str, words: int, parts: int) -> DataFrame:
    """Shingle hashes packed by part: one row per part for about a million hashes.  A task sends each class once."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        digests: list[int] = []
        count = 0

        def flush():
            nonlocal held, digests, count
            tokens = np.concatenate(held)
            sizes = np.array([len(h) for h in held], np.uint32)
            owner = np.repeat(np.arange(len(held)), sizes)
            ids = np.array(digests, np.uint64)
            rows = []
            for p, _, own, counts, t in _packed(((tokens >> _U(48)) % _U(parts)).astype(np.int32), owner, tokens, parts):
                rows.append((p, ids[own].tobytes(), sizes[own].tobytes(), counts.astype(np.uint32).tobytes(),
                             t.astype(np.uint32).tobytes(), ((t & _LOW) >> _U(32)).astype(np.uint16).tobytes()))
            held, digests, count = [], [], 0
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(binaries(c) for c in columns[1:])],
                ["part", "ids", "sizes", "counts", "low", "high"])

        for batch in batches:
            for _, hashes in shingle_sets(batch.column(0), words):
                if len(hashes) and (digest := _digest(hashes)) not in seen:
                    seen.add(digest)
                    held.append(hashes)
                    digests.append(digest)
                    count += len(hashes)
                    if count >= HELD_TOKENS:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        run, "part int, ids binary, sizes binary, counts binary, low binary, high binary")


def _joined(batches, names: list[str], kinds: list[type]) -> list[np.ndarray]:
    pieces: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for piece, name, kind in zip(pieces, names, kinds, strict=True):
            piece += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(pieces, kinds, strict=True)]


def _counted(spread: DataFrame, parts: int) -> DataFrame:
    """Hashes of two classes or more, with the number of classes, packed by the class's part."""

    def run(batches):
        rows: list[tuple] = []
        part = [0]

        def seen():
            for b in batches:
                if b.num_rows:
                    part[0] = b.column("part")[0].as_py()
                yield b

        ids, sizes, counts, low, high = _joined(
            seen(), ["ids", "sizes", "counts", "low", "high"], [np.uint64, np.uint32, np.uint32, np.uint32, np.uint16])
        if len(ids):
            tokens = low.astype(np.uint64) | (high.astype(np.uint64) << _U(32))
            del low, high
            _, at = np.unique(ids, return_index=True)
            once = np.zeros(len(ids), dtype=bool)
            once[at] = True
            owner = np.repeat(np.arange(len(ids)), counts)
            keep = once[owner]
            tokens, owner = tokens[keep], owner[keep]
            order = np.argsort(tokens)
            ordered = tokens[order]
            heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            runs = np.diff(np.r_[heads, len(ordered)])
            several = np.repeat(runs >= 2, runs)
            df = np.repeat(np.minimum(runs, 65535), runs)[several].astype(np.uint16)
            order = order[several]
            back = np.argsort(owner[order], kind="stable")
            order, df = order[back], df[back]
            own, t = owner[order], tokens[order]
            for p, at, o, c, tok in _packed((ids[own] % _U(parts)).astype(np.int32), own, t, parts):
                rows.append((p, part[0], ids[o].tobytes(), sizes[o].tobytes(), c.astype(np.uint32).tobytes(),
                             tok.astype(np.uint32).tobytes(), (tok >> _U(32)).astype(np.uint16).tobytes(), df[at].tobytes()))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(binaries(c) for c in columns[2:])],
                ["part", "source", "ids", "sizes", "counts", "low", "high", "df"])

    return spread.repartitionById(parts, F.col("part")).mapInArrow(
        run, "part int, source int, ids binary, sizes binary, counts binary, low binary, high binary, df binary")


def _bitmap(tokens: np.ndarray) -> list[int]:
    bits = np.zeros(BITMAP_WORDS * 64, dtype=np.uint8)
    bits[mix(tokens) % _U(BITMAP_WORDS * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def _profiles(counted: DataFrame, parts: int, percent: int) -> DataFrame:
    """Classes that may have a partner: size, shared hashes, their bitmap, and the prefix hashes that are tiles."""

    def run(batches):
        names, kinds = ["ids", "sizes", "counts", "low", "high", "df"], [np.uint64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint16]
        sources: list[np.ndarray] = []

        def seen():
            for b in batches:
                for s, low in zip(b.column("source").to_pylist(), b.column("low").to_pylist(), strict=True):
                    sources.append(np.full(len(low) // 4, s, np.uint64))
                yield b

        ids, sizes, counts, low, high, df = _joined(seen(), names, kinds)
        out: list[tuple] = []
        if len(ids):
            tokens = low.astype(np.uint64) | (high.astype(np.uint64) << _U(32)) | (np.concatenate(sources) << _U(48))
            owner = np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(ids[owner], kind="stable")
            tokens, df, owner = tokens[order], df[order], owner[order]
            own = ids[owner]
            heads = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)]
            for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                n = int(sizes[owner[lo]])
                tiles = n - -(-percent * n // 100) + 1 - (n - (hi - lo))
                if tiles <= 0:
                    continue
                t = np.sort(tokens[lo:hi])
                rare = np.lexsort((tokens[lo:hi], df[lo:hi]))[:tiles]
                leads = max(0, n - -(-2 * percent * n // (100 + percent)) + 1 - (n - (hi - lo)))
                out.append((int(own[lo].view(np.int64)), n, t.view(np.int64), _bitmap(t), tokens[lo:hi][rare].view(np.int64), leads))
                if len(out) >= 500:
                    yield _profile_batch(out)
                    out = []
        if out:
            yield _profile_batch(out)

    return counted.repartitionById(parts, F.col("part")).mapInArrow(
        run, "class_id long, n int, shared array<long>, bits array<long>, tiles array<long>, leads int")


def _profile_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, shared, bits, tiles, leads = zip(*rows, strict=True)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(shared, longs), pa.array(bits, longs), pa.array(tiles, longs), pa.array(leads, pa.int32())],
        ["class_id", "n", "shared", "bits", "tiles", "leads"])


def _reach(overlap, total, percent: int):
    """The test on sizes: percent of the union at least."""
    return (100 + percent) * overlap >= percent * total


def _verified(edges: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that reach the threshold: bound first, then the arrays of what is left."""

    def side(name: str, *columns: str) -> DataFrame:
        return profiles.select(F.col("class_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    slim = profiles.withColumn("m", F.size("shared"))
    a = slim.select(F.col("class_id").alias("a"), F.col("n").alias("a_n"), F.col("m").alias("a_m"), F.col("bits").alias("a_bits"))
    b = slim.select(F.col("class_id").alias("b"), F.col("n").alias("b_n"), F.col("m").alias("b_m"), F.col("bits").alias("b_bits"))
    apart = F.expr("aggregate(zip_with(a_bits, b_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    total = F.col("a_n").cast("long") + F.col("b_n")
    bounded = (
        edges.join(a, "a").join(b, "b")
        .where(_reach(F.least("a_n", "b_n").cast("long"), total, percent))
        .where(_reach(F.floor((F.col("a_m") + F.col("b_m") - apart) / 2), total, percent))
        .select("a", "b")
    )
    rich = bounded.join(side("a", "n", "shared"), "a").join(side("b", "n", "shared"), "b")

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c) for c in ("a_shared", "b_shared"))
            xs, ys = np.asarray(x.values), np.asarray(y.values)
            xo, yo = np.asarray(x.offsets), np.asarray(y.offsets)
            n = np.asarray(batch.column("a_n")).astype(np.int64) + np.asarray(batch.column("b_n"))
            # Sorted as unsigned values, and so not as signed ones: the view back makes the arrays ascend.
            keep = [
                (100 + percent) * len(np.intersect1d(xs[xo[i] : xo[i + 1]].view(np.uint64), ys[yo[i] : yo[i + 1]].view(np.uint64), assume_unique=True)) >= percent * int(n[i])
                for i in range(batch.num_rows)
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return rich.select("a", "b", "a_n", "b_n", "a_shared", "b_shared").mapInArrow(run, "a long, b long")


def _tiles(profiles: DataFrame) -> DataFrame:
    """tile, band, class_id, first, follows.  A class follows in its own band, and leads there and in the next one."""
    band = F.floor(F.log(F.col("n")) / BAND).cast("int")
    placed = profiles.select("class_id", "leads", band.alias("own"), F.posexplode("tiles").alias("place", "tile")).withColumn(
        "first", F.col("place") < F.col("leads"))
    bands = F.when(F.col("first"), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    return placed.select("class_id", "tile", "first", "own", F.explode(bands).alias("band")).select(
        "tile", "band", "class_id", "first", (F.col("band") == F.col("own")).alias("follows"))


def _leftover_pairs(tiles: DataFrame, labels: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in tiles that hold several, under the bitmap bound, block against block."""
    labelled = tiles.join(labels.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select(
        "tile", "band", "class_id", F.coalesce("root", "class_id").alias("root"), "first", "follows")
    led, following = (F.when(F.col(c), F.col("root")) for c in ("first", "follows"))
    mixed = (
        labelled.groupBy("tile", "band")
        .agg(F.min(led).alias("led"), F.max(led).alias("led_to"), F.min(following).alias("foll"), F.max(following).alias("foll_to"),
             F.count_if("first").alias("leaders"), F.count_if("follows").alias("followers"),
             F.sum(F.xxhash64("class_id", "first", "follows").cast("decimal(38,0)")).alias("mark"))
        .where("leaders > 0 and followers > 0 and least(led, foll) <> greatest(led_to, foll_to)")
    )
    # Tiles with the same members are one.
    once = mixed.groupBy("mark", "leaders", "followers").agg(
        F.min(F.struct("tile", "band", "led", "led_to", "foll", "foll_to")).alias("t")).select(
        "t.*", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c[0]}_blocks") for c in ("leaders", "followers")))
    # Where all leaders are of one component its followers have no other to meet, and the other way round.
    members = labelled.join(once, ["tile", "band"]).select(
        F.xxhash64("tile", "band").alias("uid"), "class_id", "root", "l_blocks", "f_blocks", "first", "follows",
        (F.col("first") & ((F.col("foll") < F.col("foll_to")) | (F.col("root") != F.col("foll")))).alias("asks"),
        (F.col("follows") & ((F.col("led") < F.col("led_to")) | (F.col("root") != F.col("led")))).alias("meets"))

    def dealt(role: str, mine: str, other: str) -> DataFrame:
        return (
            members.where(role)
            .withColumn(mine, F.pmod(F.xxhash64("class_id", F.lit(7)), F.col(f"{mine}_blocks")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
            .select("uid", "l", "f", F.lit(role == "asks").alias("leading"), "class_id", "root")
        )

    rows = dealt("asks", "l", "f").union(dealt("meets", "f", "l"))
    full = rows.join(profiles.select("class_id", "n", F.size("shared").alias("m"), "bits"), "class_id")
    keys = ["uid", "l", "f"]

    def run(batches):
        for table in grouped(batches, keys):
            leading = table["leading"].to_numpy()
            left, right = np.flatnonzero(leading), np.flatnonzero(~leading)
            if not len(left) or not len(right):
                continue
            ids, root = table["class_id"].to_numpy(), table["root"].to_numpy()
            n, m = table["n"].to_numpy().astype(np.int64), table["m"].to_numpy().astype(np.int64)
            bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            right = right[np.argsort(n[right], kind="stable")]
            sizes = n[right]
            for x in left.tolist():
                # Partners of the right size, none before the leader by (n, id).
                other = right[np.searchsorted(sizes, n[x]) : np.searchsorted(sizes, 100 * n[x] // percent, "right")]
                other = other[(root[other] != root[x]) & ((n[other] > n[x]) | (ids[other] > ids[x]))]
                total = n[x] + n[other]
                apart = np.bitwise_count(bits[other] ^ bits[x]).sum(axis=1, dtype=np.int64)
                ok = (100 + percent) * np.minimum((m[x] + m[other] - apart) // 2, n[x]) >= percent * total
                if ok.any():
                    b = ids[other[ok]]
                    a = np.full(len(b), ids[x])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    spread = full.select(*keys, "leading", "class_id", "root", "n", "m", "bits").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, key: list | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_id (equal sets), group_id (equal components; null without words).

    ``docs`` needs ``doc_id`` and the text column; other columns are ignored, whatever their names.  A null or empty
    text, or one without words, has no shingles, and its component is its own doc_id.  Repeated rows are documents of
    one class; equal doc_ids with different texts stay different documents.  A null doc_id counts as no smallest
    doc_id, unless no other document is in the component.  No input rows: no rows.  ``key`` columns ride along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    classes = cut(shingle_classes(docs, text, words, key))
    total, rows = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(65536, max(1, min(least, ceil(total / 20_000)), ceil(total / TOKENS_PER_PART)))
    profiles = cut(_profiles(_counted(_spread(docs, text, words, parts), parts), parts, percent))
    tiles = _tiles(profiles)
    hubs = tiles.groupBy("tile", "band").agg(
        F.min(F.when(F.col("first"), F.col("class_id"))).alias("a"), F.count("*").alias("members")).where("members > 1 and a is not null")
    stars = tiles.join(hubs, ["tile", "band"]).where("a <> class_id").select("a", F.col("class_id").alias("b")).distinct()
    near = cut(_verified(stars, profiles, percent))
    labels = components(near)
    more = cut(_verified(_leftover_pairs(tiles, labels, profiles, percent), profiles, percent))
    if not more.isEmpty():
        labels = components(labels.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b").union(more))
    heavy = max(1_000, ceil(rows / HEAVY_KEYS))
    per_class = classes.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    linked = cut(per_class.join(labels.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select(
        "class_id", F.coalesce("root", "class_id").alias("group_id"), "least", "members"))
    groups = linked.groupBy("group_id").agg(F.min("least").alias("smallest"), F.count("*").alias("members"))
    facts = _looked_up(linked, groups.where("members > 1"), "group_id", heavy).select(
        "class_id", "group_id", F.coalesce("smallest", "least").alias("smallest"), "members")
    found = _looked_up(classes, facts, "class_id", heavy)
    return found.select(
        "doc_id", "n_shingles",
        F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        "class_id", "group_id", *classes.columns[3:])


def _looked_up(rows: DataFrame, facts: DataFrame, key: str, heavy: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a key and ``members``, the number of rows that hold it.

    Keys of at least ``heavy`` rows, of which there are at most ``HEAVY_KEYS`` or one in 1,000 rows, are broadcast;
    their rows, and those without a key, are spread evenly over the join of the others.
    """
    values = [c for c in facts.columns if c not in (key, "members")]
    big = facts.where(F.col("members") >= heavy).select(F.col(key).alias("__big"), *(F.col(c).alias(f"__big_{c}") for c in values))
    rest = facts.where(F.col("members") < heavy).select(
        F.col(key).alias("__key"), F.lit(True).alias("__light"), *(F.col(c).alias(f"__{c}") for c in values))
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    marked = salted.join(F.broadcast(big), F.col(key) == F.col("__big"), "left").withColumn(
        "__light", F.col(key).isNotNull() & F.col("__big").isNull())
    keyed = marked.withColumn("__key", F.when(F.col("__light"), F.col(key)).otherwise(F.xxhash64("__salt")))
    return keyed.join(rest, ["__key", "__light"], "left").select(
        *rows.columns, *(F.coalesce(f"__big_{c}", f"__{c}").alias(c) for c in values))


def _keys(doc_id, text) -> list:
    return [F.xxhash64(doc_id, text).alias("__k1"), F.xxhash64(F.lit(17), text, doc_id).alias("__k2")]


def keep_one(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest doc_id; rows are told apart by doc_id and text.

    Documents without words are in no component with others and stay (a repeated row of them once).
    """
    found = jaccard_components(docs, text, words, percent, key=_keys(F.col("doc_id"), F.col(text)))
    grouped_rows = found.where("group_id is not null").groupBy("group_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")).alias("best"))
    wanted = grouped_rows.select("best.__k1", "best.__k2").union(found.where("group_id is null").select("__k1", "__k2"))
    keyed = docs.select("*", *_keys(F.col("doc_id"), F.col(text)))
    return keyed.join(wanted, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns)
