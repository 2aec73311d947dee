"""File signatures against a plain search, whatever the windows."""

import random

import pytest

from packetloom.operators import signatures


def plain(data: bytes):
    out = []
    for magic, name, _ in signatures.SIGNATURES:
        word = bytes.fromhex(magic)
        for at in range(len(data)):
            if data[at : at + len(word)] != word:
                continue
            if name == "gzip" and (len(data) < at + 4 or data[at + 3] & 0xE0):
                continue
            if name == "pe":
                pointer = int.from_bytes(data[at + 60 : at + 64], "little") if len(data) >= at + 64 else 0
                if pointer < 64 or data[at + pointer : at + pointer + 4] != b"PE\0\0":
                    continue
            out.append((name, at))
    return sorted(out)


def values():
    rng = random.Random(4)
    words = [bytes.fromhex(m) for m, _, _ in signatures.SIGNATURES] + [b"PE\0\0", b"\x1f\x8b\x08\x00", b"\xff\xd8\xff\xd8\xff", b"Rar!\x1a\x07\x01", b"P", b"MZ", b"\x00" * 9]
    out = [b"", b"MZ", b"\x1f\x8b\x08", b"\xff\xd8\xff\xd8\xff\xd8\xff"]
    far = bytearray(b"MZ" + bytes(58) + (900).to_bytes(4, "little") + bytes(900))
    far[900:904] = b"PE\0\0"
    out += [bytes(far), bytes(far[:903]), b"xx" + bytes(far), bytes(far[:800])]
    for _ in range(30):
        out.append(b"".join(rng.choice(words) if rng.random() < 0.4 else bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(40)))
    return out


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
def test_signatures_of_any_window(spark, window):
    given = values()
    rows = [(k if k % 5 else None, f"v{k}", bytearray(v)) for k, v in enumerate(given)] + [(99, "null", None)]
    df = spark.createDataFrame(rows, "id int, format_name string, d binary").repartition(3)
    got = {}
    for r in signatures.signature_hits(df, "d", window).collect():
        assert r["byte_length"] == len(given[int(r["format_name"][1:])])
        got.setdefault(r["format_name"], []).append((r["format"], r["offset"]))
    for k, v in enumerate(given):
        assert sorted(got.get(f"v{k}", [])) == plain(v), k
    assert "null" not in got


def test_automaton_follows_words_that_share_a_beginning():
    import numpy as np

    found = {}
    data = np.frombuffer(b"abcabdab", np.uint8)
    for k, places in signatures.Automaton([b"abc", b"abd", b"ab"]).find(data, np.full(len(data), len(data))):
        found[k] = places.tolist()
    assert found == {0: [0], 1: [3], 2: [0, 3, 6]}
