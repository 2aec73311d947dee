"""Operator 12: counts that hold when slots are shared by chance and when words are spelled like languages."""

from __future__ import annotations

import numpy as np
import pytest

from packetloom.llm import phrases
from tests.llm.test_counting_operators import DOCS, brute_phrases, phrase_rows


def documents(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "s", 2, "p", "x") for k, (lang, t) in enumerate(rows)], DOCS).coalesce(1)


def test_words_spelled_like_languages(spark):
    """`es` is a word of one language and the name of another; a missing language is named like a word."""
    rows = [("es", "de piedra"), ("de", "es geht und"), (None, "de facto"), ("en", "en route")] * 12
    assert phrase_rows(phrases.mine_phrases(documents(spark, rows), min_count=10)) == brute_phrases(rows, 10, 5, 2000)


@pytest.mark.parametrize("slot_bits", [7, 9])
def test_counts_when_some_slots_are_shared(spark, slot_bits):
    """Phrases get frequent at different steps, and some find their slot set before their subphrases have one."""
    rng = np.random.default_rng(slot_bits)
    rows = []
    for k in range(300):
        # Words of their own for each shard, and phrases that come in one shard or in all.
        own = [f"w{k % 3}x{i}" for i in rng.integers(0, 12, 12)]
        said = " ".join([f"p{i} q{i} r{i} s{i} t{i}" for i in rng.integers(0, 10, 2)])
        rows.append(("en", f"{' '.join(own)}. {said}. " + " ".join(f"c{i}" for i in np.sort(rng.integers(0, 9, 8)))))
    assert phrase_rows(phrases.mine_phrases(documents(spark, rows), min_count=20, slot_bits=slot_bits)) == brute_phrases(rows, 20, 5, 2000)
