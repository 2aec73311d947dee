from pyspark.sql import functions as F

from packetloom.functions.text import bounded_preview, escaped_preview, form_decode
from packetloom.operators import content, injection, parameters, rank, sidechannel, webshell
from packetloom.plans import pages, queue, report


def test_parameters_keep_byte_offsets(spark):
    df = spark.createDataFrame([("/p?ä=1&b&c=x%20y+z=&c=#frag&d=1",), ("/none",)], "uri string")
    rows = parameters.query_parameters(df).orderBy("ordinal").collect()
    assert [(r.name, r.value, r.value_offset, r.raw_length) for r in rows] == [("ä", "1", 6, 1), ("b", "", 9, 0), ("c", "x y z=", 12, 8), ("c", "", 23, 0)]
    body = spark.createDataFrame([("a=1&a=%zz&=v",)], "request_body string")
    assert [(r.name, r.value, r.name_offset) for r in parameters.form_fields(body).orderBy("ordinal").collect()] == [("a", "1", 0), ("a", "%zz", 4), ("", "v", 10)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("añb",)], "t string")
    assert [df.select(bounded_preview(F.col("t"), n)).first()[0] for n in (1, 2, 3, 9)] == ["a", "a", "añ", "añb"]
    raw = spark.createDataFrame([(bytearray(b"a\t\\\x00\xff\n"),)], "d binary")
    assert raw.select(escaped_preview(F.col("d"))).first()[0] == "a\\t\\\\\\x00\\xff\\n"
    assert df.select(form_decode(F.lit("a+b%21"))).first()[0] == "a b!"


def _signals(spark, value):
    row = injection.sql_signals(spark.createDataFrame([(value,)], "value string")).first()
    return row.signals, round(row.confidence, 4)


def test_signals(spark):
    assert _signals(spark, "1' OR 1=1-- ") == (["boolean-expression", "comment-truncation"], 0.76)
    assert _signals(spark, "x UNION ALL SELECT a FROM information_schema.tables") == (["union-select", "metadata-query"], 0.9)
    assert _signals(spark, "a # b") == ([], 0.0)
    assert _signals(spark, "sleep(5)")[0] == ["time-delay"]
    assert _signals(spark, "1; drop table x")[0] == ["stacked-statement"]


def _tx(spark):
    rows = [
        (1, 1, 1, 2, "GET", "/s?q=book", 200, 100, 100, None), (1, 2, 3, 4, "GET", "/s?q=1%27+OR+1%3D1--+", 500, 20, 20, None), (1, 3, 5, 6, "GET", "/s?q=1%27+or+1%3D1--+", 500, 20, 20, None),
    ]
    tx = spark.createDataFrame(rows, "capture_id int, tx_id long, request_frame long, response_frame long, method string, uri string, response_code int, declared_length int, extracted_length int, request_body string")
    return content.classify_body(tx)


def test_clean_and_two_equal_probes(spark):
    events = injection.mark_duplicates(injection.injection_events(injection.collect_parameters(_tx(spark)))).orderBy("request_frame").collect()
    assert [(e.tx_id, e.status, e.baseline_frame, e.code_changed, e.length_changed, round(e.confidence, 4)) for e in events] == [
        (2, "complete", 1, True, True, 0.84), (3, "complete", 1, True, True, 0.84),
    ]
    assert events[0].duplicate_of is None and events[1].duplicate_of == events[0].event_id
    findings = injection.rollup_findings(injection.injection_events(injection.collect_parameters(_tx(spark)))).collect()
    assert [(f.target, f.severity, f.events) for f in findings] == [("GET /s#q", "high", 2)]


def test_event_without_baseline_is_partial(spark):
    events = injection.injection_events(injection.collect_parameters(_tx(spark).where("tx_id = 2"))).collect()
    assert [(e.status, e.confidence, e.baseline_frame) for e in events] == [("partial", 0.70, None)]


FIELD = "capture_id int, tx_id long, request_frame long, response_frame long, method string, uri string, ordinal int, name string, value string"


def test_webshell_file_write(spark):
    import base64

    action = base64.b64encode(b'$f=base64_decode($_POST["z1"]);$c=$_POST["z2"];@fwrite(fopen($f,"w"),$c);').decode()
    target = base64.b64encode(b"D:/wamp64/www/./upload/../x.jpg").decode()
    rows = [
        (1, 1, 1, 2, "POST", "/u.php", 0, "aa", "@eval(base64_decode($_POST[Action]));"), (1, 1, 1, 2, "POST", "/u.php", 1, "ACTION", action),
        (1, 1, 1, 2, "POST", "/u.php", 2, "z1", target), (1, 1, 1, 2, "POST", "/u.php", 3, "z2", "48656c6c6f21"),
        (1, 2, 3, None, "POST", "/u.php", 0, "aa", "@eval(base64_decode($_POST['gone']));"),
    ]
    found = {e.tx_id: e for e in webshell.webshell_events(spark.createDataFrame(rows, FIELD)).collect()}
    assert (found[1].event_kind, found[1].target, found[1].payload_ordinal, found[1].confidence) == ("file-write", "D:\\wamp64\\www\\x.jpg", 3, 0.98)
    assert (found[2].event_kind, found[2].status, found[2].confidence, found[2].target) == ("unknown-operation", "partial", 0.55, "/u.php")


def test_operations_and_targets(spark):
    cases = {
        "system('id');": "command-execution", "unlink($f);": "file-delete", "rename($a,$b);": "file-rename", "mkdir($d);": "directory-create",
        "$x=fread($f,filesize($p));": "file-read", "mysqli_query($c,$q);": "database-action", "echo 1;": "unknown-operation", "php_uname();posix_geteuid();": "system-information",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.k for r in df.select("a", webshell.operation(F.col("a"))["kind"].alias("k")).collect()} == cases
    paths = {"/a/./b/../c/": "/a/c", "//srv/x": "//srv/x", "c:/w/x": "C:\\w\\x", "  two  words ": "two words", "": "(unresolved)"}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.n for r in df.select("p", webshell.normalize_target(F.col("p")).alias("n")).collect()} == paths


def test_expressions_need_both_markers(spark):
    names = ['x%{#context["a"],(new java.lang.ProcessBuilder(new java.lang.String[]{"id"})).start()}', "%{#context}", 'ProcessBuilder("id") #context']
    rows = [(1, i, i, None if i else 5, "post", "/a", 0, n, "") for i, n in enumerate(names)]
    found = webshell.expression_events(spark.createDataFrame(rows, FIELD)).collect()
    assert [(e.tx_id, e.target, e.status, e.confidence, e.endpoint) for e in found] == [(0, "id", "complete", 0.99, "POST /a")]


def test_field_scores(spark):
    rows = [(1, 1, 0, "user", "bob"), (1, 1, 1, "Password", "0123456789abcdef0123456789abcdef"), (1, 1, 2, "token", "changeme"), (1, 2, 0, "user", "eve"), (1, 1, 3, "key", "tab\there")]
    scored = rank.score_fields(spark.createDataFrame(rows, "capture_id int, tx_id int, ordinal int, name string, value string"))
    assert {(r.tx_id, r.field_name): (r.kind, r.score) for r in scored.collect()} == {(1, "user"): ("context-field", 13.0), (1, "password"): ("sensitive-field", 80.0)}
    assert rank.field_signals(scored).count() == 8
    merged, links = rank.merge_candidates(rank.field_candidates(scored), rank.field_candidates(scored))
    assert merged.count() == 2 and links.count() == 2


def test_queue_keeps_human_state(spark):
    key = "capture_id int, subject_kind string, subject_id string, task_kind string"
    previous = spark.createDataFrame([(1, "evidence", "a", "r", "dismissed"), (1, "evidence", "b", "r", "open"), (1, "evidence", "c", "r", "open")], key + ", state string")
    signals = spark.createDataFrame([(1, "evidence", "a", "r", "x", 70, None, None, None), (1, "evidence", "a", "r", "y", 90, None, None, None), (1, "evidence", "b", "r", "x", 65, None, "e", "role"), (1, "evidence", "d", "r", "x", 60, None, None, None)],
                                    key + ", rule string, priority int, detail string, evidence_id string, evidence_role string")
    merged = queue.merge_queue(previous, signals)
    assert {r.subject_id: (r.state, r.priority) for r in merged.collect()} == {"a": ("dismissed", 90), "b": ("open", 65), "c": ("open", 0), "d": ("open", 60)}
    assert {r.subject_id for r in queue.visible(merged).collect()} == {"a", "b", "d"}
    again = queue.merge_queue(merged, signals)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    assert [r.subject_id for r in pages.queue_page(merged, min_priority=60, limit=2).collect()] == ["a", "b"]


def test_export_reasons(spark):
    content_rows = spark.createDataFrame([("h", "0123456789", True), ("i", "abc", False)], "content_hash string, content string, complete boolean")
    ranges = spark.createDataFrame(
        [(1, "h", 2, 3), (2, "h", 8, 5), (3, "none", 0, 1), (4, "i", 0, 1), (5, "h", -1, 2), (6, "h", 0, None), (7, "h", 0, 4), (8, "h", 0, 2)],
        "evidence_id long, content_hash string, offset long, length long",
    )
    exported, skips = report.export_ranges(ranges, content_rows, 9, 6, "evidence_id")
    assert {r.evidence_id: bytes(r.data) for r in exported.collect()} == {1: b"234", 8: b"01"}
    assert {r.evidence_id: r.reason for r in skips.collect()} == {2: "range-out-of-bounds", 3: "no-stored-bytes", 4: "blob-incomplete", 5: "invalid-offset", 6: "item-byte-limit", 7: "total-byte-limit"}


def test_report_is_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id int, name string")
    built = report.build_report({"things": (rows, ["id"], 3), "none": (rows.where("id < 0"), ["id"], 3)})
    path = str(tmp_path / "report")
    report.write_report(built, path)
    back = {(r.collection, r.ordinal): r.item for r in spark.read.json(path).collect()}
    assert back[("things", 0)] == '{"count":3,"limit":3,"total":9,"truncated":true}'
    assert back[("none", 0)] == '{"count":0,"limit":3,"total":0,"truncated":false}'
    assert back[("things", 3)] == '{"id":2,"name":"n2"}'


def test_key_edges_and_names(spark):
    def row(frame, *codes):
        return (1, 1, frame, bytearray([0, 0, *codes, *[0] * (6 - len(codes))]))

    df = spark.createDataFrame([row(1, 4), row(2, 4, 30), row(3, 30, 40), row(4), row(5, 4, 49), row(6, 200)], "capture_id int, device int, frame_number long, report binary")
    edges = sidechannel.key_edges(sidechannel.report_codes(df)).orderBy("frame_number", "code").collect()
    assert [(e.frame_number, e.key) for e in edges] == [(1, "a"), (2, "1"), (3, "enter"), (5, "a"), (5, "\\"), (6, "key-0xc8")]


def test_plain_pings_are_no_oracle(spark):
    rows = [(1, i, "a", "b", 64, i + 100 if i % 2 else None) for i in range(20)] + [(1, 50 + i, "c", "d", 65 + i, 500 + i if i % 2 else None) for i in range(10)]
    found = {r.source: r.score for r in sidechannel.icmp_oracle(spark.createDataFrame(rows, "capture_id int, frame_number long, source string, destination string, ttl int, reply_frame long")).collect()}
    assert found == {"a": 0, "c": 100}
    text = sidechannel.ttl_text(spark.createDataFrame(rows, "capture_id int, frame_number long, source string, destination string, ttl int, reply_frame long"), block=6).where("source = 'c'").orderBy("block_no").collect()
    assert "".join(r.attempt_text for r in text) == "ABCDEFGHIJ" and "".join(r.accepted_text for r in text) == "BDFHJ"


def test_form_decode_keeps_stray_percent_signs(spark):
    from pyspark.sql import functions as F

    from packetloom.functions.text import form_decode

    cases = {
        "1%27+OR+1%3D1--+%": "1' OR 1=1-- %", "%zz%41": "%zzA", "100%": "100%", "a%2": "a%2", "%2541": "%41", "": "", "a+b": "a b", "%%27": "%'",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", form_decode(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == cases
    assert spark.createDataFrame([(None,)], "t string").select(form_decode(F.col("t")).alias("d")).first()["d"] is None


def test_probe_key_sees_the_whole_value(spark):
    from pyspark.sql import functions as F

    from packetloom.operators.injection import normalize_probe

    rows = spark.createDataFrame([("x" * 600 + "A",), ("x" * 600 + "b",)], "t string").select(normalize_probe(F.col("t")).alias("k")).collect()
    assert rows[0]["k"] != rows[1]["k"] and rows[0]["k"].endswith("xa")


def test_pointer_flags_do_not_depend_on_the_block(spark):
    import re

    from packetloom.operators.sidechannel import pointer_flags

    text = "flag{aaa} and ctf{bbb}" + "x" * 40 + "FLAG{" + "y" * 100 + "}" + "ctf{flag{z}..}" + "flag{" + "w" * 300 + "} flag{q}"
    rows = [(1, 7, "a", "b", k + 1, ord(c)) for k, c in enumerate(text)]
    df = spark.createDataFrame(rows, "capture_id int, stream_index long, source string, destination string, frame_number long, pointer int")
    expected = [(m.start(), m.group(0)) for m in re.finditer(r"(?i)(?:flag|ctf)\{[^\r\n\x00]{1,240}\}", text)]
    for block in (8, 32, 4096):
        assert sorted((r["offset"], r["value"]) for r in pointer_flags(df, block).collect()) == expected


def test_chains_of_pointer_flags_are_walked_span_by_span(spark):
    import random
    import re

    from packetloom.operators import sidechannel

    rng = random.Random(5)
    # Starts stand so close that all matches of a direction chain, over hundreds of spans and several blocks of spans.
    texts = ["".join(rng.choice(["ctf{", "flag{a}", "}", "x" * 9]) for _ in range(1000)), "ctf{a}" * 800, "no flag", "x" * 500 + "ctf{b}" + "y" * 900 + "flag{c}"]
    rows = [(1, k, "a", None if k == 3 else "b", n + 1, ord(c)) for k, text in enumerate(texts) for n, c in enumerate(text)]
    df = spark.createDataFrame(rows, "capture_id int, stream_index long, source string, destination string, frame_number long, pointer int")
    expected = sorted((k, m.start(), m.group(0)) for k, text in enumerate(texts) for m in re.finditer(sidechannel.POINTER_FLAG[4:], text, re.I))
    assert len(expected) > 30
    for span in (4, 300):
        assert sorted((r["stream_index"], r["offset"], r["value"]) for r in sidechannel.pointer_flags(df, span=span).collect()) == expected


def test_merged_candidates_scan_their_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    fields = spark.createDataFrame([(1, 1, 0, "key", "abc"), (1, 2, 0, "key", "abc")], "capture_id int, tx_id long, ordinal int, name string, value string")
    scored = rank.score_fields(fields)
    part = rank.field_candidates(scored)
    merged, links = rank.merge_candidates(part.mapInArrow(counted, part.schema))
    rows = merged.join(links, "candidate_id").collect()
    assert sorted((r["value"], r["evidence_links"], r["evidence_id"]) for r in rows) == [("abc", 2, "1:0"), ("abc", 2, "2:0")]
    assert calls.value == 2
