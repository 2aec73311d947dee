"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised once; only lengths travel from there.  Pieces are dealt to blocks of about ``BLOCK`` pieces, and
each block is packed by several islands.  A chromosome is a list of bins.  Crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold a document twice, and best-fits the displaced documents.  After
each epoch the best chromosome of an island migrates to the next island of its block, through a shuffle.  An island
stops early only when it has reached the lower bound (tokens over capacity), which proves it optimal.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.text import small_batches
from packetloom.session import cut

CAPACITY = 2048
END_ID = 0
BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 3
WELL_FILLED = 0.998

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Code points whose classes no Unicode version has changed: both libraries split texts of these alike.
_SETTLED = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u024f\\u2010-\\u2027]*").fullmatch
_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """Text to ids of the vocabulary.

    The rank file holds the same vocabulary, and its library gives the same ids five times faster; a test walks all
    ids to show that.  Texts with code points that the two could class differently, or with the content of an added token
    (which is one id), go to the first library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    if (vocabulary, ranks) not in _ENCODERS:
        slow = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        added = re.compile("|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values()) or "(?!)").search
        _ENCODERS[vocabulary, ranks] = slow, fast, added
    slow, fast, added = _ENCODERS[vocabulary, ranks]

    def encode(text: str) -> list[int]:
        return fast.encode_ordinary(text) if _SETTLED(text) and not added(text) else slow.encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document is its ids and the end id.  Longer ones are cut so that all pieces but the first are full.
    """

    def run(batches):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.array(encode(value.as_py() or ""), dtype="<u4")
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_fit(items, sizes, bins, fills, capacity: int) -> None:
    """Put every item in the fullest bin that has room, else in a new one."""
    free = sorted((capacity - f) << 32 | k for k, f in enumerate(fills) if f < capacity)
    for i in items:
        need = sizes[i]
        at = bisect_left(free, need << 32)
        if at == len(free):
            bins.append([i])
            fills.append(need)
            k, left = len(bins) - 1, capacity - need
        else:
            entry = free.pop(at)
            k, left = entry & 0xFFFFFFFF, (entry >> 32) - need
            bins[k].append(i)
            fills[k] += need
        if left:
            insort(free, left << 32 | k)


def _build(order, sizes, capacity: int):
    bins, fills = [], []
    _best_fit(order, sizes, bins, fills, capacity)
    return bins, fills


def _fitness(fills, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then uneven filling, which leaves room in one place."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills)


def _cross(mother, father, sizes, capacity: int, rng):
    """Whole well-filled bins of the father enter the mother; what they displace is best-fitted."""
    bins_f, fills_f = father
    good = [k for k, f in enumerate(fills_f) if f >= WELL_FILLED * capacity] or [max(range(len(fills_f)), key=fills_f.__getitem__)]
    take = rng.permutation(len(good))[: max(1, len(good) // 2)]
    bins = [list(bins_f[good[k]]) for k in take]
    fills = [fills_f[good[k]] for k in take]
    inside = bytearray(len(sizes))
    for b in bins:
        for i in b:
            inside[i] = 1
    displaced = []
    for b, f in zip(*mother, strict=True):
        # A bin with a document that came in goes, and so does the odd badly filled one.
        if any(inside[i] for i in b) or (f < WELL_FILLED * capacity and rng.random() < 0.5):
            displaced += [i for i in b if not inside[i]]
        else:
            bins.append(list(b))
            fills.append(f)
    displaced.sort(key=lambda i: (-sizes[i], i))
    _best_fit(displaced, sizes, bins, fills, capacity)
    return bins, fills


def evolve(sizes: list[int], members: list, capacity: int, generations: int, seed: int) -> list:
    """The population after some generations, best first.  No members: they are seeded by best fit in several orders."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity)
    if not members:
        plain = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        members = [_build(plain, sizes, capacity)]
        while len(members) < POPULATION and len(members[0][0]) > bound:
            noise = rng.uniform(0.85, 1.15, len(sizes))
            members.append(_build(sorted(range(len(sizes)), key=lambda i: -sizes[i] * noise[i]), sizes, capacity))
    members.sort(key=lambda m: _fitness(m[1], capacity), reverse=True)
    for _ in range(generations):
        if len(members[0][0]) <= bound or len(members) < 2:
            break
        for _ in range(POPULATION - 1):
            x, y = rng.choice(len(members), 2, replace=False)
            members.append(_cross(members[x], members[y], sizes, capacity, rng))
        members.sort(key=lambda m: _fitness(m[1], capacity), reverse=True)
        members = members[:POPULATION]
    return members


_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]
_STATE = "block long, island int, bins int, fill double, sizes array<int>, bin_of array<int>"


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(_ORDER, ascending=[False, True, True, True, True], kind="stable", na_position="last")


def _rows(block: int, targets, members, sizes) -> list[tuple]:
    rows = []
    for island, (bins, fills) in zip(targets, members, strict=True):
        bin_of = np.zeros(len(sizes), np.int32)
        for k, b in enumerate(bins):
            bin_of[b] = k
        rows.append((block, island, len(bins), float(sum(f * f for f in fills)), sizes, bin_of))
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "island", "bins", "fill", "sizes", "bin_of"])


def _members(frame: pd.DataFrame, sizes: list[int]) -> list:
    found = []
    for bin_of in frame["bin_of"]:
        bins: list[list[int]] = [[] for _ in range(int(max(bin_of)) + 1)]
        for i, k in enumerate(bin_of):
            bins[k].append(i)
        found.append((bins, [sum(sizes[i] for i in b) for b in bins]))
    return found


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, in as few sequences as found.

    A null or empty text is the end id alone.  Very long texts are cut, their pieces spread over blocks.  Repeated rows
    and equal doc_ids are documents of their own; a null doc_id stays null.  Other columns are ignored, whatever their
    names.  No input rows: no rows.  Results are the same in every run over the same rows.
    """
    small_batches(docs.sparkSession)
    pieces = cut(token_pieces(docs, text, capacity, vocabulary, ranks))
    blocks = max(1, ceil(pieces.count() / BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))

    def settle(key, frame):
        sizes = _ordered(frame)["length"].astype(int).tolist()
        rows = []
        for island in range(ISLANDS):
            members = evolve(sizes, [], capacity, GENERATIONS, int(key[0]) * 1009 + island)
            rows += _rows(int(key[0]), [island] * len(members), members, sizes)
            rows += _rows(int(key[0]), [(island + 1) % ISLANDS], members[:1], sizes)
            if len(members[0][0]) <= -(-sum(sizes) // capacity):
                break
        return _frame(rows)

    def epoch(number: int):
        def run(key, frame):
            block, island = int(key[0]), int(key[1])
            sizes = list(map(int, frame["sizes"].iloc[0]))
            frame = frame.sort_values(["bins", "fill"], ascending=[True, False], kind="stable")
            bound = -(-sum(sizes) // capacity)
            if int(frame["bins"].iloc[0]) <= bound:
                return frame.head(1)
            members = evolve(sizes, _members(frame.head(POPULATION), sizes), capacity, GENERATIONS, block * 1009 + island + 31 * number)
            return _frame(_rows(block, [island] * len(members), members, sizes) + _rows(block, [(island + 1) % ISLANDS], members[:1], sizes))

        return run

    state = dealt.where(F.col("length") < capacity).groupBy("block").applyInPandas(settle, _STATE)
    for number in range(1, EPOCHS + 1):
        state = state.groupBy("block", "island").applyInPandas(epoch(number), _STATE)
    best = state.groupBy("block").agg(
        F.min_by("bin_of", F.struct("bins", -F.col("fill"), "island")).alias("bin_of"))

    def place(key, frame, chosen):
        frame = _ordered(frame)
        full = frame["length"].to_numpy() >= capacity
        bins = np.zeros(len(frame), np.int64)
        if len(chosen):
            bins[~full] = chosen["bin_of"].iloc[0]
        used = int(bins[~full].max()) + 1 if (~full).any() else 0
        bins[full] = used + np.arange(int(full.sum()))
        length = frame["length"]
        out = frame.drop(columns="block")
        out["sequence_id"] = (int(key[0]) << 32) + bins
        out["offset"] = length.groupby(bins).cumsum() - length
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
