"""Operators for training data: edge rows, brute force on small inputs, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import fingerprints, licenses, line_dedup, mixing, ngram_join, packing, quality, topk, toxicity, warc
from packetloom.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c + 32 for c in range(0x41, 0x5B)})
WORD = re.compile("[^\x20\x09-\x0d]+")

#: doc_id, text, lang, source, n_chars, and columns whose names clash with results and helpers.
EXTRA = "text_key string, score double, tokens long, hash string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG_LINE = "This line is long enough to be a passage that repeats."


def edge_documents(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w59", "other")
    texts = [
        None, "", "   \n\t", "one", "one two three", "ONE two three", base, base, near, base.replace("w30", "x30"),
        LONG_LINE, f"a\n {LONG_LINE.upper()} \nb", f"{LONG_LINE}\n{LONG_LINE}", f"{LONG_LINE}\nc", f"d\n{LONG_LINE}", f"e\n{LONG_LINE}\nf",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nunder the mit licenses",
        "word " * 30_000, "é" * 200, "you are an idiot", "中文 text \U0001f600", "x", "x",
    ]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None, "k", 1.5, 7, "h") for k, t in enumerate(texts)]
    rows.append(rows[7])
    rows.append((None, "no id", "en", "s1", 5, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return edge_documents(spark).repartition(3, "text").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Queries with SQL, and that all of them run.


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, message = compare(spark, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


# 1 WARC.


def test_warc_round_trip_and_revisits(spark):
    body = "x" * 120
    pages = spark.createDataFrame(
        [(5, "http://a/\r\nx", body, 1), (3, None, body, 2), (3, "http://b", body, 3), (9, "u", None, 4), (8, "u", "", 5), (None, "u", body, 6),
         (1, "u", "short", 7), (2, "u", "short", 8), (7, "u", "WARC/1.1\r\n\r\npayload\r\n\r\n" + "é" * 90, 9)],
        "page_id long, url string, html string, digest int")
    got = rows_of(warc.archive_pages(pages))
    assert len(got) == 9
    for r in got:
        if r["payload_bytes"] == 120 and r["payload_digest"] == hashlib.sha256(body.encode()).hexdigest():
            assert (r["record_type"] == "response") == (r["refers_to"] is None)
            assert r["refers_to"] in (None, 3)
    assert sum(r["record_type"] == "revisit" for r in got) == 3
    assert {r["record_type"] for r in got if r["payload_bytes"] < 100} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


# 2 packing.


def brute_pieces(text, encode):
    ids = [*encode(text or ""), 0]
    head = len(ids) % 2048 or 2048
    cuts = [0, *range(head, len(ids) + 1, 2048)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_both_tokenizers_have_the_same_merges():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.VOCABULARY)
    vocabulary = slow.get_vocab()
    # Every token is reached by its own merges, so merging by rank and merging by pair give the same ids.
    wrong = [t for t, i in vocabulary.items() if t != "<|endoftext|>" and [x.id for x in slow.model.tokenize(t)] != [i]]
    assert wrong == []


def test_packing_is_whole_and_gapless(spark, edge):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.VOCABULARY)
    slow.encode_special_tokens = True
    got = rows_of(packing.pack(edge))
    expected = sorted((str(r["doc_id"]), *p) for r in edge.collect() for p in brute_pieces(r["text"], lambda t: slow.encode(t, add_special_tokens=False).ids))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_evolving_keeps_all_documents_and_reaches_the_bound():
    sizes = np.random.default_rng(3).integers(1, 2048, 600).tolist()
    first = packing.evolve(sizes, [], 2048, 0, 1)
    best = packing.evolve(sizes, first, 2048, 6, 2)[0]
    assert sorted(i for b in best[0] for i in b) == list(range(600))
    assert [sum(sizes[i] for i in b) for b in best[0]] == best[1] and max(best[1]) <= 2048
    assert len(best[0]) <= len(first[0][0])


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# 3 line dedup.


def test_line_dedup_by_hand(spark, edge):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    docs = [(r["doc_id"], (r["text"] or "").split("\n")) for r in edge.collect()]
    holders: dict[str, list] = {}
    for d, lines in docs:
        for k in {key(x) for x in lines}:
            holders.setdefault(k, []).append(d)
    lost = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    expected = sorted((str(d), len(lines), "\n".join(x for x in lines if key(x) not in lost or lost[key(x)] == d)) for d, lines in docs)
    got = line_dedup.dedup_lines(edge)
    assert got.columns == [*edge.columns, "n_lines", "n_dropped"]
    assert sorted((str(r["doc_id"]), r["n_lines"], r["text"]) for r in rows_of(got)) == expected
    assert got.agg(F.sum("n_dropped")).first()[0] >= 5


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 5000, dtype=np.uint64)
    found = line_dedup.PerfectHash(np.unique(keys)).find(np.unique(keys))
    assert sorted(found.tolist()) == list(range(len(np.unique(keys))))
    assert len(line_dedup.PerfectHash(np.zeros(0, np.uint64)).find(keys[:3])) == 3


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


# 4 n-gram Jaccard join.


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[k]] = min(ids.get(label[k], d), d)
    return sorted((str(d), len(s), str(ids.get(v) if s else d)) for (d, _), s, v in zip(rows, sets, label))


def test_jaccard_join_against_brute_force(spark, edge):
    rng = np.random.default_rng(11)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    base = [[f"v{rng.integers(0, 400)}" for _ in range(rng.integers(5, 80))] for _ in range(12)]
    for k in range(160):
        words = list(base[k % 12])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"n{rng.integers(0, 5)}"
        rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df)
    expected = brute_components(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows_of(got)) == expected
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    words = [r for r in rows_of(kept) if WORD.search(r["text"] or "")]
    assert len(words) == len({c for _, n, c in expected if n})


@pytest.mark.parametrize("block", [3, 2_048])
def test_jaccard_join_with_a_passage_that_most_texts_share(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(12)
    passage, other = [f"p{k}" for k in range(60)], [f"q{k}" for k in range(60)]
    rows = []
    for k in range(240):
        # Most share a passage and are too different to be linked, some just reach the threshold; orders differ.
        own = [f"u{k}_{j}" for j in range(rng.integers(0, 40))]
        body = passage[: rng.integers(40, 61)] if k % 3 else passage[: rng.integers(20, 61)] + other[: rng.integers(0, 40)]
        rows.append((k, " ".join(body + own if k % 2 else own + body)))
    rows += [(300, rows[10][1]), (301, rows[10][1]), (None, rows[20][1]), (None, rows[20][1]), (302, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows_of(got)) == brute_components(rows)


def test_lookup_of_heavy_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(60)], "id long, g long")
    facts = rows.where("g is not null").groupBy("g").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("g <> 2")
    for heavy in (1, 16, 1_000):
        got = {r["id"]: r["least"] for r in ngram_join._looked_up(rows, facts, "g", heavy).collect()}
        assert got == {k: None if k % 5 == 0 or k % 3 == 2 else {0: 3, 1: 1}[k % 3] for k in range(60)}


def test_keep_one_keeps_clean_rows(edge, nothing):
    kept = {r["doc_id"] for r in rows_of(ngram_join.keep_one(edge))}
    assert {0, 1, 2, 3, 4, 6, 21, None} <= kept and not {5, 7, 22} & kept
    assert ngram_join.keep_one(nothing).count() == 0


# 5 toxicity.


def test_grammar_weighs_clauses():
    machine = toxicity.grammar()
    o, i, t, g, n, r = toxicity.OTHER, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT
    assert machine.weigh([o, o]) == 0 < machine.weigh([i])
    assert machine.weigh([g, o, i]) > machine.weigh([i]) > machine.weigh([n, o, i])
    assert machine.weigh([r, o, o, o, i]) < machine.weigh([o, o, o, o, i])
    assert machine.weigh([t]) == 0 < machine.weigh([t, g])


def test_toxicity_held_out_and_edges(spark, edge, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("lang", "toxic", "predicted").toPandas()
    assert scored[scored.toxic == 1].predicted.mean() >= 0.9
    assert scored[scored.toxic == 1].groupby("lang").predicted.mean().min() >= 0.8
    assert (scored.toxic == scored.predicted).mean() > 0.97
    assert scored[scored.toxic == 0].predicted.mean() < 0.02
    none = labels.limit(0)
    got = {r["doc_id"]: r for r in rows_of(toxicity.score_toxicity(edge, none))}
    assert got[19]["predicted"] == 1 and got[0]["predicted"] == 0 and got[1]["score"] == got[0]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 0) for d, r in got.items())
    assert toxicity.score_toxicity(nothing, none).count() == 0


# 6 exact top-k.


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.2, 16).tolist() for _ in range(900)] + [[0.5] * 16] * 60
    rows = [(k, v, "x") for k, v in enumerate(vectors)] + [(2000, None, "x"), (2050, [None] + [0.1] * 15, "x"), (2100, [float("nan")] * 16, "x"), (None, [0.1] * 16, "x"), (2150, [0.3] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    expected = set()
    for q in range(0, len(vectors), 50):
        scores = whole @ whole[q]
        order = sorted((i for i in range(len(vectors)) if i != q), key=lambda i: (-scores[i], i))[:5]
        expected |= {(q, k + 1, i, int(scores[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == expected
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_many_blocks_groups_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # Few telling dimensions, so that reading stops early; rows repeated more often than k, and queries among them.
    vectors = [(rng.normal(0, 1, 12) * 0.5 ** np.arange(12)).tolist() for _ in range(700)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(40, vectors[40])] * 300 + [(41, vectors[41])] * 3 + [(42, vectors[43])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("BLOCK_ROWS", 100), ("LEAST_BLOCK_ROWS", 100), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(topk, name, value)
    ids = np.array([k for k, _ in rows])
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    expected = []
    for q in range(0, len(vectors), 20):
        scores = whole @ whole[q]
        order = sorted((i for i in range(len(rows)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:5]
        expected += [(q, k + 1, int(ids[i]), int(scores[i])) for k, i in enumerate(order)]
    assert sorted(tuple(r) for r in topk.top_k(df, every=20).collect()) == sorted(expected)


# 7 licenses.


def test_licenses_by_hand(edge, nothing):
    got = {r["doc_id"]: r for r in rows_of(licenses.scan_licenses(edge))}
    r = got[16]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (2, 1, 8, "apache-2,mit") and 0 < r["score"] <= 1
    assert got[0]["labels"] == "" and got[0]["first_word"] is None and got[0]["n_words"] == 0 and got[17]["n_words"] == 30_000
    assert licenses.scan_licenses(nothing).count() == 0


def test_template_regions():
    import pyarrow as pa

    scanner = licenses.Scanner({"t": ["begin <<optional>>maybe<<end>> middle <<any:2>> last"]}, {})
    texts = ["begin middle last", "begin maybe middle a b last", "begin middle a b c last", "begin maybe last", "x begin middle last y"]
    assert [row[5] for row in scanner.scan(pa.array(texts))] == ["t", "t", "", "", "t"]
    with pytest.raises(ValueError):
        licenses.compile_template("t", "a <<optional>> b")


# 8 fingerprints.


def test_fingerprints(spark, edge, nothing):
    got = rows_of(fingerprints.edited_fingerprints(edge))
    docs = sorted(((r["doc_id"], r["text"] or "") for r in edge.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for k, (d, t) in enumerate(docs):
        after, m = docs[(k + 1) % len(docs)][1], len(t) // 3
        expected.append((str(d), len(t), hashlib.sha256(((t[: len(t) - m] + after[:m]) if m else t).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    by_text: dict[str, set] = {}
    for r in got:
        by_text.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_fingerprints(nothing).count() == 0


def test_chunks_move_with_their_text():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    plain, moved = fingerprints.fingerprints([text, b"something before " + text])
    assert fingerprints.likeness(plain, moved) > 0.98
    assert int(plain[1].sum()) == len(text) and plain[1].max() <= fingerprints.MAX_BYTES


# 9 quality.


def test_quality_held_out_and_edges(spark, edge, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs, labels).where(quality.F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    found = got.join(labels, "doc_id").select("quality", "keep").toPandas()
    assert found[found.quality == 1].keep.mean() > 0.97 and found[found.quality == 0].keep.mean() < 0.1
    none = labels.limit(0)
    rows = rows_of(quality.classify_quality(edge, none))
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify_quality(nothing, none).count() == 0


# 10 mixing.


def test_mixing_meets_targets(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = spark.createDataFrame([("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1), ("absent", 0.5)], "value string, target double")
    got = mixing.mix(docs, {"lang": target}, share=0.5).cache()
    total = got.agg(F.sum("tokens")).first()[0]
    shares = dict(got.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("token_weight")) / total).collect())
    assert shares == pytest.approx({"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, abs=1e-6)
    expected = got.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert expected == pytest.approx(0.5 * total, rel=1e-6)
    assert got.where("sampled").agg(F.sum("tokens")).first()[0] == pytest.approx(0.5 * total, rel=0.15)
    rows = rows_of(mixing.mix(edge))
    assert len(rows) == edge.count() and all(0 < r["probability"] <= 1 for r in rows)
    assert all(r["sampled"] for r in rows if r["tokens"] == 0)
    assert mixing.mix(nothing).count() == 0


# The pipeline.


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SMALL).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_lost_lines_of_very_many_equal_probes_are_all_returned(spark):
    nulls = spark.range(1_200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).cast("long").alias("h1"), F.lit(9).cast("long").alias("h2"))
    named = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("h1"), F.lit(9).cast("long").alias("h2"))
    got = line_dedup.build_and_probe(nulls.union(named), 5).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {None: 1_200_000, **{k: 1 for k in range(9)}}


def test_license_regions_after_the_first_word(spark):
    docs = spark.createDataFrame([(1, "Copyright 2004 Acme"), (2, "copyright acme"), (3, "copyright a b c d acme"), (4, "see the zlib"), (5, "zlib acme")], "doc_id long, text string")
    own = {"named": ["copyright <<any:3>> acme"], "single": ["zlib"], "tail": ["copyright <<any:1>>"]}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs.coalesce(1), templates=own).collect()}
    assert got == {1: "named,tail", 2: "named,tail", 3: "tail", 4: "single", 5: "single"}
    # The last word of a slice has none after it.
    assert licenses.scan_licenses(docs.where("doc_id = 4"), templates=own).first()["labels"] == "single"


def test_added_tokens_are_single_ids():
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(packing.VOCABULARY), packing.encoder()
    for text in ("a<|endoftext|>b", "<|endoftext|>", "中<|endoftext|> <|endoftext|>x", "a<|endoftext >b", "plain"):
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids
    assert encode("a<|endoftext|>b") == [64, 50256, 65]
