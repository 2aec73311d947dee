"""License scan by template markup: templates with optional and replaceable regions compiled into token automata.

A template is wording with two kinds of region: ``<<optional>> ... <<end>>``, which a text may leave out, and
``<<any:n>>``, which stands for up to n words of any kind (a name, a year).  All else is mandatory and must match word by
word.  A text is accepted where an automaton reaches its end.  Documents are read as arrays of word hashes; automata run
only from places where a template's first mandatory word stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.text import MARKS, Words, slices, small_batches, utf8, word_hash

#: The phrases of the base labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Wording of public licenses and of lines that name them.
TEMPLATES = {
    "mit": [
        "<<optional>>released<<end>> under the <<optional>>terms of the<<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<optional>>the software<<end>> to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the apache license version 2 <<optional>>0<<end>> <<optional>>the license<<end>>",
        "apache license <<optional>>january 2004<<end>> version 2",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "under the <<any:2>> bsd license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "under the isc license",
    ],
    "gpl": [
        "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> gnu general public license "
        "<<optional>>version <<any:1>><<end>>",
    ],
    "lgpl": ["under the <<optional>>terms of the<<end>> gnu lesser general public license <<optional>>version <<any:1>><<end>>"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0", "under the mozilla public license <<optional>>version<<end>> 2"],
    "cc-by-nc": [
        "cc by nc <<optional>>sa<<end>> <<optional>>nd<<end>> <<optional>><<any:2>><<end>>",
        "creative commons attribution noncommercial <<optional>>sharealike<<end>> <<any:2>> license",
    ],
    "cc-by": ["creative commons attribution <<any:2>> license"],
    "all-rights-reserved": ["<<optional>>copyright <<any:8>><<end>> all rights reserved"],
}

_ITEM = re.compile(r"<<optional>>|<<end>>|<<any:(\d+)>>|[^\s<]+")


@dataclass(frozen=True)
class Automaton:
    """States read one word each: arcs[state] = ((word hash or None for any word, next state), ...); skips are closed."""

    label: str
    arcs: tuple[tuple[tuple[int | None, int], ...], ...]
    final: frozenset[int]
    words: int

    def starts(self) -> set[int]:
        return {h for h, _ in self.arcs[0] if h is not None}

    def match(self, hashes: np.ndarray, at: int, stop: int) -> tuple[int, int] | None:
        """End of the longest match from ``at`` and the number of its words that stood in ``any`` regions, at least."""
        states, best, place = {0: 0}, None, at
        while True:
            done = [n for s, n in states.items() if s in self.final]
            if done:
                best = place, min(done)
            if place >= stop or not states:
                return best
            word, after = int(hashes[place]), {}
            for s, free in states.items():
                for h, to in self.arcs[s]:
                    if h is None or h == word:
                        cost = free + (h is None)
                        after[to] = min(cost, after.get(to, cost))
            states, place = after, place + 1


def compile_template(label: str, template: str) -> Automaton:
    """Compile the markup; raises ValueError where it is unbalanced or has no mandatory word first or last in reach."""
    arcs: list[list[tuple[int | None, int]]] = [[]]
    skips: list[set[int]] = [set()]
    opened: list[int] = []
    words, place = 0, 0

    def new() -> int:
        arcs.append([])
        skips.append(set())
        return len(arcs) - 1

    for item in _ITEM.finditer(template):
        token = item.group(0)
        if token == "<<optional>>":
            opened.append(place)
        elif token == "<<end>>":
            if not opened:
                raise ValueError(f"{label}: <<end>> without <<optional>>")
            skips[opened.pop()].add(place)
        elif item.group(1):
            begin = [place]
            for _ in range(int(item.group(1))):
                after = new()
                arcs[place].append((None, after))
                place = after
                begin.append(place)
            for s in begin[:-1]:
                skips[s].add(place)
        else:
            after = new()
            arcs[place].append((word_hash(token), after))
            place, words = after, words + (not opened)
    if opened:
        raise ValueError(f"{label}: <<optional>> without <<end>>")

    def closure(state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in skips[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return seen

    reach = [closure(s) for s in range(len(arcs))]
    closed = tuple(tuple(dict.fromkeys(a for r in sorted(reach[s]) for a in arcs[r])) for s in range(len(arcs)))
    automaton = Automaton(label, closed, frozenset(s for s in range(len(arcs)) if place in reach[s]), words)
    if 0 in automaton.final or any(h is None for h, _ in automaton.arcs[0]):
        raise ValueError(f"{label}: a template must begin with wording")
    return automaton


class Scanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]) -> None:
        self.automata = [compile_template(label, t) for label, ts in templates.items() for t in ts]
        self.base = {label: np.array([word_hash(w) for w in phrase.split()], np.uint64) for label, phrase in base.items()}
        self.starts: dict[int, list[Automaton]] = {}
        for a in self.automata:
            for h in a.starts():
                self.starts.setdefault(h, []).append(a)
        # A template needs all its mandatory words; a document without its rarest ones is not tried.
        self.first = np.array(sorted(self.starts), np.uint64)
        second: set[int] = set()
        # First words after which any word may stand, or none: their next word says nothing.
        free: set[int] = set()
        for a in self.automata:
            for h, to in a.arcs[0]:
                second.update(x for x, _ in a.arcs[to] if x is not None)
                if to in a.final or any(x is None for x, _ in a.arcs[to]):
                    free.add(h)
        self.second = np.array(sorted(second), np.uint64)
        self.free = np.array(sorted(free), np.uint64)

    def scan(self, column: pa.Array):
        """n_words, n_base, first, last, base labels, labels and score of each row."""
        data, offsets = utf8(column)
        for begin, end in slices(offsets):
            base = offsets[begin]
            words = Words(data[base : offsets[end]], offsets[begin : end + 1] - base, MARKS)
            h, first = words.hashes, words.first
            row_of = np.searchsorted(first, np.arange(len(h)), "right") - 1
            places: dict[int, list[tuple[int, str]]] = {}
            for label, phrase in self.base.items():
                size = len(phrase)
                if len(h) < size:
                    continue
                hit = np.ones(len(h) - size + 1, dtype=bool)
                for k in range(size):
                    hit &= h[k : len(h) - size + 1 + k] == phrase[k]
                for at in np.flatnonzero(hit).tolist():
                    if row_of[at] == row_of[at + size - 1]:
                        places.setdefault(int(row_of[at]), []).append((at, label))
            matched: dict[int, dict[str, float]] = {}
            starts = np.flatnonzero(np.isin(h, self.first))
            followed = np.isin(np.append(h[1:], h[:1])[starts], self.second) & (starts + 1 < len(h))
            starts = starts[followed | np.isin(h[starts], self.free)]
            for at in starts.tolist():
                row = int(row_of[at])
                for automaton in self.starts[int(h[at])]:
                    found = automaton.match(h, at, int(first[row + 1]))
                    if found:
                        fixed = found[0] - at - found[1]
                        own = matched.setdefault(row, {})
                        own[automaton.label] = max(own.get(automaton.label, 0.0), fixed / (found[0] - at) * (1 - 0.5 ** fixed))
            for row in range(end - begin):
                own = sorted(places.get(row, []))
                labels = matched.get(row, {})
                named = sorted({label for _, label in own})
                score = max([*labels.values(), *(1 - 0.5 ** len(self.base[x]) for x in named)], default=0.0)
                at = [a - int(first[row]) for a, _ in own]
                yield (int(first[row + 1] - first[row]), len(own), at[0] if at else None, at[-1] if at else None,
                       ",".join(named), ",".join(sorted({*named, *labels})), score)


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Score: the best match, its share of fixed words times 1 - 2^-(their number); 0 without any.  A null or empty text has no
    words, no labels (empty strings) and no places (null).  Repeated rows are scanned alike; other columns are ignored.
    A text of any length is read as a whole.  No rows: no rows.
    """
    small_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches):
        scanner = Scanner(chosen, BASE)
        for batch in batches:
            rows = list(zip(*scanner.scan(batch.column(1)), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
