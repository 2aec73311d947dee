"""Operators 11 to 13: edge rows, brute force on small inputs, and both ways of each size switch."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import decontaminate, phrases, vector_codes

LOWER = str.maketrans({c: c + 32 for c in range(0x41, 0x5B)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

DOCS = "doc_id long, text string, lang string, n_words long, spans string, k int, phrase string, __x string"


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 11 decontamination.


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        size = min(len(w), 10)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


LONG = " ".join(f"W{k}" for k in range(30))
ITEMS = [(1, LONG), (10, "exactly these. five, words!"), (2, LONG.replace("W29", "other")), (3, None), (4, " ,;"), (2, "twice named item"),
         (None, "no id at all"), (7, "Zürich 中文 ok")]
TEXTS = [
    None, "", " .,", LONG, f"a {LONG.lower()} b", LONG.replace(" ", ", "), " ".join(LONG.split()[:9]), " ".join(LONG.split()[5:16]),
    "exactly these five words", "exactly these five", "exactly THESE\nfive\twords exactly these five words", "say: no id at all", "zürich 中文 ok", "ZÜRICH 中文 ok",
    f"{LONG} {LONG}", "x " * 40_000 + LONG + " y" * 40_000, "twice named item twice named item", LONG, LONG,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k if k != 8 else None, t, None, 3, "s", 1, "p", "x") for k, t in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows + rows[3:5], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_contamination_against_brute_force(texts, items, most):
    rows, docs = texts
    got = decontaminate.scan_contamination(docs, items, broadcast_windows=most)
    assert set(docs.columns) | {"n_hit", "n_items", "items_sha256", "contaminated"} == set(got.columns)
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(got)), key=repr)
    assert found == brute_contamination(rows + rows[3:5], ITEMS)


def test_spans_and_cleaning(spark, texts, items):
    rows, docs = texts
    spans = {r["text"]: r["spans"] for r in rows_of(decontaminate.scan_contamination(docs, items))}
    assert spans[f"a {LONG.lower()} b"] == [{"first": 1, "last": 30}]
    assert spans["exactly THESE\nfive\twords exactly these five words"] == [{"first": 0, "last": 7}]
    clean = {r["doc_id"]: r for r in rows_of(decontaminate.decontaminate(docs, items))}
    assert clean[4]["text"] == "a  b" and clean[4]["__x"] == "x" and clean[0]["text"] is None and clean[9]["text"] == TEXTS[9]
    assert clean[11]["text"] == "say: "
    left = rows_of(decontaminate.decontaminate(docs, items, remove="documents"))
    dirty = {r[0] for r in brute_contamination(rows, ITEMS) if r[5]}
    assert sorted(r["doc_id"] for r in left) == sorted(r[0] for r in rows if r[0] not in dirty)
    assert decontaminate.decontaminate(docs, items).columns == docs.columns


def test_nothing_to_find(spark, texts, items):
    _, docs = texts
    none = rows_of(decontaminate.scan_contamination(docs, items.limit(0)))
    assert len(none) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in none)
    assert rows_of(decontaminate.scan_contamination(docs.limit(0), items)) == []
    assert rows_of(decontaminate.scan_contamination(docs.limit(0), items, broadcast_windows=3)) == []


# 12 phrases.


def brute_phrases(docs, min_count, max_words, top):
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    frequent = {key: n for key, n in counts.items() if n >= min_count}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2 or any(
            x == lang and len(q) > len(p) and n >= a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for (x, q), n in frequent.items()):
            continue
        score, k = min((1000 * a * words[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, rest, words[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, rest) in enumerate(sorted(found)[:top], 1))


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def sayings():
    rng = np.random.default_rng(5)
    names = ["new", "york", "city", "hall", "the", "of", "a", "zürich", "中文", "x-y", "don't"]
    out = []
    for k in range(160):
        w = [names[i] for i in rng.choice(len(names), 30, p=[.1, .1, .1, .1, .2, .1, .1, .05, .05, .05, .05])]
        w[5:9] = ["new", "york", "city", "hall"]
        if k % 2:
            w[12:17] = ["rare", "words", "stand", "always", "together"]
        text = " ".join(w).replace(" the ", [" the ", ". The ", ",the\t ", "\x0bthe "][k % 4])
        out.append((None if k % 5 == 0 else ["en", "de", "und"][k % 3], text))
    out += [("en", None), ("en", ""), (None, ",.;"), ("fr", "one two"), ("de", "ha " * 3000), ("en", out[0][1]), ("en", out[0][1])]
    return out


@pytest.mark.parametrize(("shards", "min_count", "top"), [(1, 20, 2000), (3, 20, 2000), (4, 45, 7)])
def test_phrases_against_brute_force(spark, sayings, shards, min_count, top):
    docs = spark.createDataFrame([(k, t, lang, 1, "s", 2, "p", "x") for k, (lang, t) in enumerate(sayings)], DOCS).repartition(5)
    got = phrase_rows(phrases.mine_phrases(docs, min_count=min_count, top=top, shards=shards))
    assert got == brute_phrases(sayings, min_count, 5, top)
    assert min_count > 40 or any(r[2] == "rare words stand always together" for r in got)


def test_phrases_with_shared_slots(spark, sayings, monkeypatch):
    """Every hash in one of very few slots: phrases are active early, and counts still hold."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    docs = spark.createDataFrame([(k, t, lang, 1, "s", 2, "p", "x") for k, (lang, t) in enumerate(sayings)], DOCS).repartition(3)
    assert phrase_rows(phrases.mine_phrases(docs, min_count=20, shards=3, slot_bits=2)) == brute_phrases(sayings, 20, 5, 2000)


def test_phrases_of_nothing(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([(1, None, None, 1, "s", 2, "p", "x")], DOCS)).collect() == []


# 13 vector codes.


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_products_are_exact(data):
    width = data.draw(st.integers(1, 40))
    size = 1 << data.draw(st.integers(1, 27))
    numbers = st.integers(-size, size)
    x = np.array(data.draw(st.lists(st.lists(numbers, min_size=width, max_size=width), min_size=1, max_size=4)), dtype=np.int64)
    c = np.array(data.draw(st.lists(st.lists(numbers, min_size=width, max_size=width), min_size=1, max_size=4)), dtype=np.int64)
    exact = [[sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for b in c] for a in x]
    assert vector_codes.exact_products(x, c).tolist() == exact
    best, far = vector_codes.nearest(x, c)
    for a, k, d in zip(x.tolist(), best, far, strict=True):
        all_ = [sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for b in c.tolist()]
        assert (k, d) == (all_.index(min(all_)), min(all_))


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, label, [int(np.floor(4096 * float(x))) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(kept[0][2])
    cuts = [dims * p // parts for p in range(parts + 1)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def assign(v):
        out = []
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            far = [sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)) for e in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        held = {}
        for _, _, v in kept:
            for p, (k, _) in enumerate(assign(v)):
                held.setdefault((p, k), []).append(v[cuts[p] : cuts[p + 1]])
        for (p, k), members in held.items():
            books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(i, label, "".join(f"{k:02x}" for k, _ in a), sum(d for _, d in a)) for i, label, v in kept for a in [assign(v)]]
    by_label = Counter()
    for _, label, _, error in done:
        by_label[label] += error
    return sorted(((i, label, code, error, by_label[label], sha) for i, label, code, error in done), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, v string, __label int"


@pytest.mark.parametrize("hot", [0.9, 0.05])
def test_codes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", hot)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1, 16).tolist(), None if k % 3 == 0 else k % 4) for k in range(90)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 2), (None, [0.25] * 16, None)]
    rows += [rows[2], rows[2], (2, [0.5] * 16, 7), *((300 + k, [1.0] * 16, 0) for k in range(20))]
    df = spark.createDataFrame([(*r, "c", "e", "v", 1) for r in rows], VECTORS).repartition(4)
    got = sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows_of(vector_codes.compress(df))), key=repr)
    assert got == brute_codes(rows, 8, 16, 6)


def test_codes_of_few_or_uneven_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).collect() == []
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5], None), (4, [4.0, 5.0, 6.0], 1), (5, [0.1] * 20, 2)]
    got = {r["vec_id"]: r for r in rows_of(vector_codes.compress(spark.createDataFrame([(*r, "c", "e", "v", 1) for r in rows], VECTORS)))}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(r["error"] == 0 and len(r["code"]) == 16 for r in got.values())
    assert got[4]["code"] == "01" * 3 + "00" * 5
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1, "c", "e", "v", 1)], VECTORS))
