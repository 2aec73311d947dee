"""Words of the phrase scans against a plain split, on rows with nothing, borders and breaks."""

import random
import re

import numpy as np

from packetloom.llm import phrases
from packetloom.llm.text import word_hash


def test_words_against_a_plain_split():
    rng = random.Random(3)
    texts = ["", "x", "y Z", "", ". ,", " a.b", "", "q ", "é\tÄ!!ab"] + ["".join(rng.choice("ab. ,\té\nC") for _ in range(rng.randrange(30))) for _ in range(300)] + [""]
    raw = [t.encode() for t in texts]
    spelling, starts, ends, hashes, rows, joined = phrases._tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = []
    for row, text in enumerate(texts):
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            words = re.findall(r"[^ \t]+", piece)
            want += [(word, row, i + 1 < len(words)) for i, word in enumerate(words)]
    whole = spelling.tobytes()
    assert [(whole[a:b].decode(), r, j) for a, b, r, j in zip(starts, ends, rows, joined)] == want
    assert [int(h) for h in hashes] == [word_hash(w) for w, _, _ in want]
    # Words of one piece stand with one blank between them.
    assert all(whole[ends[i] : starts[i + 1]] == b" " for i in np.flatnonzero(joined))


def test_no_words():
    for data in (b"", b" .\n"):
        found = phrases._tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert all(len(part) == 0 for part in found[1:])
