import random
import re

from packetloom.functions.text import with_matches
from packetloom.operators import content, corpus, decode, signatures


def _known(spark, text, **options):
    rows = corpus.scan_known(spark.createDataFrame([(1, text)], "id int, t string"), "t", **options).collect()
    return sorted((r.offset, r.value) for r in rows)


def test_known_formats(spark):
    assert _known(spark, "x {FLAG:abc} y") == [(2, "{FLAG:abc}")]
    assert _known(spark, "key{color:#0000FF} and flag{a}") == [(23, "flag{a}")]
    assert _known(spark, "key:abcdefgh and key:abcdefg1") == [(17, "key:abcdefg1")]
    assert _known(spark, "DDCTF{abc} myflag{abc}") == []
    assert _known(spark, "é flag{x}") == [(3, "flag{x}")]


def test_matches_over_window_borders_are_found_once(spark):
    text = "".join(f"{'p' * (i % 37)} flag{{item{i}}} é" for i in range(120))
    whole = _known(spark, text)
    assert len(whole) == 120
    for chunk in (300, 517, 1000):
        assert _known(spark, text, chunk=chunk) == whole


def test_unknown_tokens(spark):
    good = "Abcdef-ghijkl_MNOP.1234567"
    text = f"see {good} or https://Abcdefghijkl.example-host1/x and deadbeefdeadbeefdeadbeef FOO{{bar!baz}} if{{abcd}} flag{{abcd}}"
    rows = corpus.scan_unknown(spark.createDataFrame([(1, text)], "id int, t string"), "t").collect()
    assert sorted((r.kind, r.value) for r in rows) == [("unknown-brace", "FOO{bar!baz}"), ("unknown-token", good)]


def test_signatures(spark):
    pe = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\x00\x00"
    data = b"\x4d" + b"%PDF-1" + b"\x1f\x8b\x08\x00" + b"\x1f\x8b\x08\xff" + pe + b"MZ no header" + b"\xff\xd8\xff"
    rows = signatures.signature_hits(spark.createDataFrame([(1, bytearray(data))], "id int, d binary"), "d").collect()
    found = sorted((r.format, r.offset) for r in rows)
    assert found == [("gzip", 7), ("jpeg", len(data) - 3), ("pdf", 1), ("pe", 15)]
    census = {r.format: (r.hits, r.with_prefix) for r in signatures.signature_census(signatures.signature_hits(spark.createDataFrame([(1, bytearray(data))], "id int, d binary"), "d")).collect()}
    assert census["pe"] == (1, 1)


def test_query_names(spark):
    names = ["4142434445464748.example.test", "www.example.test", "4142434445464748", "MFRGGZDFMZTWQ2LK.X.test", "4142434445464748.4142434445464749.Example.Test"]
    rows = corpus.decode_query_names(spark.createDataFrame([(n,) for n in names], "query_name string")).collect()
    assert sorted((r.encoding, r.base_domain, bytes(r.chunk)) for r in rows) == [
        ("base32", "x.test", b"abcdefghij"),
        ("hex", "example.test", b"ABCDEFGH"),
        ("hex", "example.test", b"ABCDEFGHABCDEFGI"),
    ]


def test_recognized_encodings(spark):
    values = ["68656c6c6f21", "aGVsbG8gd29ybGQ=", "aGVs_G8-", "YWJjZGVmZ2hp", "short", "not encoded!", "aGVsbG8/"]
    rows = decode.decode_recognized(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert {r.value: r.transform for r in rows} == {
        "68656c6c6f21": "hex", "aGVsbG8gd29ybGQ=": "base64", "aGVs_G8-": "base64url", "YWJjZGVmZ2hp": "base64", "aGVsbG8/": "base64",
    }
    assert {bytes(r.output) for r in rows if r.transform == "hex"} == {b"hello!"}


def test_chain_stops_at_depth(spark):
    value = b"hello world"
    for _ in range(3):
        value = value.hex().encode()
    df = spark.createDataFrame([(1, value.decode())], "id int, v string")
    rows = decode.decode_chain(df, "id", "v").orderBy("depth").collect()
    assert [r.depth for r in rows] == [1, 2, 3] and bytes(rows[-1].output) == b"hello world"
    assert rows[0].output_hash == rows[1].parent_hash
    limited = decode.decode_chain(df, "id", "v", max_depth=2).orderBy("depth").collect()
    assert [(r.depth, r.status) for r in limited] == [(1, "decoded"), (2, "decoded"), (3, "depth-limit")]
    assert limited[2].output is None and limited[2].parent_hash == limited[1].output_hash
    assert {r.status for r in rows} == {"decoded"}


def test_suppress_known_and_content(spark):
    df = spark.createDataFrame([(1, "flag{abcd}"), (2, "flag{abcd}"), (3, "x")], "id int, t string")
    rows = {r.first_owner: r.copies for r in content.content_table(df, "t", "id").collect()}
    assert rows == {1: 2, 3: 1}
    unknown = spark.createDataFrame([("h", "flag{abcd}"), ("h", "other")], "content_hash string, value string")
    known = spark.createDataFrame([("h", " flag{abcd}")], "content_hash string, value string")
    assert [r.value for r in corpus.suppress_known(unknown, known).collect()] == ["other"]


def test_body_classes(spark):
    df = spark.createDataFrame([(0, 0), (None, 0), (5, 0), (5, 5), (5, 3), (5, 9), (None, 4)], "declared_length int, extracted_length int")
    found = [r.body_status for r in content.classify_body(df).collect()]
    assert found == ["empty", "absent", "missing", "complete", "partial", "length-mismatch", "complete"]
    assert [r.body_status for r in content.classify_body(df, limit=9).where("extracted_length = 9").collect()] == ["limit-truncated"]


def test_part_headers(spark):
    df = spark.createDataFrame([(1, 'form-data; name="a"; filename="x.png"|form-data; name=b', "Image/PNG"), (2, "", "")], "frame_number int, dispositions string, media_types string")
    rows = content.explode_parts(df).orderBy("frame_number", "ordinal").collect()
    assert [(r.field_name, r.filename, r.declared_type) for r in rows] == [("a", "x.png", "image/png"), ("b", None, None), (None, None, None)]


def test_spelled_out_patterns_find_what_ranges_find(spark):
    brace = "(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_-]{1,32}\\{[\\x21-\\x7a\\x7c\\x7e]{4,256}\\}(?![A-Za-z0-9_])"
    token = "(?<![A-Za-z0-9_.+/=:-])[A-Za-z0-9][A-Za-z0-9_.+/=:-]{23,127}(?![A-Za-z0-9_.+/=:-])"
    rng = random.Random(8)
    parts = ["{", "}", "}}", " ", "\n", "é", "-", "_", "{{", "a", "Z9", "word", "x" * 23, "Az_" * 9, "q" * 127, "=" * 130, "k-" * 17, "{abcd}", "{a b}", "ab{" + "y" * 256 + "}"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for mine, plain, needs in ((corpus.BRACE, brace, {"__hits": "{"}), (corpus.TOKEN, token, None)):
        found = {(r.i, m.offset, m.value) for r in with_matches(df, {"__hits": mine}, "t", needs).collect() for m in r["__hits"]}
        expected = {(i, len(t[: m.start()].encode()), m.group()) for i, t in enumerate(texts) for m in re.finditer(plain, t)}
        assert found == expected and found


def test_texts_are_searched_and_split_only_where_a_pattern_is_found(spark):
    df = spark.createDataFrame([(1, "ab{cdef} xy"), (2, "no"), (3, "Ab" * 13), (4, "Ab" * 13 + " ab{cdef}")], "i int, t string")
    rows = with_matches(df, {"brace": corpus.BRACE, "token": corpus.TOKEN}, "t", {"brace": "{"})
    assert {(r.i, kind, m.offset) for r in rows.collect() for kind in ("brace", "token") for m in r[kind]} == {
        (1, "brace", 0), (3, "token", 0), (4, "token", 0), (4, "brace", 27)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and plan.count("regexp_extract_all(") == 2
