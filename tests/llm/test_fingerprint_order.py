"""Fingerprints of documents with ids beyond 53 bits, beside null ids and repeated rows, against a plain reading."""

import hashlib

import numpy as np

from packetloom.llm import fingerprints


def test_next_of_large_ids_beside_null(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh é中"), rng.integers(2, 9))) for _ in range(300)]
    rows = [((1 << 60) + k if k else None, " ".join(rng.choice(words, rng.integers(0, 400))), "x", "y") for k in range(200)]
    rows += [(-(1 << 62) - 1, "lowest of all", "x", "y"), ((1 << 60) + 7, rows[7][1], "x", "y"), (3, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, fingerprint string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part] if part else text
        plain, changed, following = fingerprints.fingerprints([t.encode() for t in (text, edited, after)])
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.shown(plain), fingerprints.shown(changed),
                         fingerprints.likeness(plain, changed), fingerprints.likeness(plain, following)))
    got = [tuple(r) for r in fingerprints.edited_fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def plain_chunks(data: bytes) -> list[bytes]:
    """Borders tried one after the other, each with the hash of its last 32 bytes summed up."""
    def last(end: int) -> int:
        return sum(int(fingerprints._GEAR[data[end - 1 - j]]) << j for j in range(32)) % (1 << 32) >> 32 - fingerprints.HARD

    out, begin = [], 0
    while len(data) - begin > 32:
        end = begin + 32
        while end < min(begin + 512, len(data)) and (last(end) if end < begin + 64 else last(end) % 16):
            end += 1
        out.append(data[begin:end])
        begin = end
    return out + ([data[begin:]] if begin < len(data) else [])


def test_chunks_and_likeness_against_plain_reading():
    rng = np.random.default_rng(8)
    texts = [b"", b"a", b"x" * 32, b"x" * 1500, *(rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (31, 33, 64, 700, 3000))]
    texts.append(texts[-1][:1500] + b" something else " + texts[-1][1500:])
    found = fingerprints.fingerprints(texts)
    ends, counts = fingerprints.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    parts = [plain_chunks(t) for t in texts]
    assert counts.tolist() == [len(p) for p in parts]
    assert ends.tolist() == np.cumsum([len(c) for p in parts for c in p]).tolist()
    for a, one in zip(parts, found, strict=True):
        for b, other in zip(parts, found, strict=True):
            x, y = set(a), set(b)
            least = min(sum(map(len, x)), sum(map(len, y)))
            expected = sum(map(len, x & y)) / least if least else float(not x and not y)
            assert abs(fingerprints.likeness(one, other) - expected) < 1e-12
