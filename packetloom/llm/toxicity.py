"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the same sequence of token classes and add weights: insults; threats (against a target);
targets near an insult; negation, which takes weight off for a few tokens; reported speech, which takes weight off to
the end of the clause.  They are composed into one machine.  A document's score comes from its matched clauses, never
from words counted on their own.

The insult lexicon is learned: word stems and whole words that occur in toxic rows and hardly in others, chosen one
after another by the toxic rows that none so far explains, and then every word that stands among different neighbours in more
toxic rows than chance explains.  Counting and contrast run on Spark over a bounded sample of labelled rows
(``labelled.SAMPLE_ROWS``), the choice on the ``CANDIDATES`` most telling entries.

Stems that clean texts hold too, but several times more seldom, are hints: one says nothing, but each further one, in
another clause or of another form, does.  Their weight is fitted apart, as the rows that taught the lexicon hold its words
more surely than new rows do; the stronger of both decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.labelled import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, sigmoid
from packetloom.llm.text import MARKS, Words, slices, small_batches, utf8, word_hash
from packetloom.session import cut

CANDIDATES = 5_000
MAX_ENTRIES = 400
STEM_CHARS = range(4, 10)
LEAST_ROWS = 3
LEAST_WORD_ROWS = 5
CHANCE = 0.05
DEFAULT_WEIGHTS = (1.0, 0.3, -2.0)
HINT_LIFT = 4
HINT_FORMS = 5

#: Words of the classes, in several languages.  Insults are a prior; what labels show is added.
INSULTS = "idiot moron scum loser worthless pathetic disgusting stupid trash imbecile".split()
THREATS = "kill hurt destroy burn shoot beat stab töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they them him her du dich ihr euch vous tu toi ils elles tú ustedes ellos usted".split()
NEGATIONS = "not never no nobody isnt arent wasnt kein keine nicht nie pas jamais ne ni nunca jamás".split()
REPORTS = "said says wrote writes called quoted quotes reported claimed sagte schrieb zitierte dit écrit cité dijo escribió citó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLAUSE_END = re.compile(rb"[.!?;:\n]")
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


@dataclass(frozen=True)
class Transducer:
    """Deterministic and complete over token classes: arcs[state][class] = (next state, weight)."""

    arcs: tuple[tuple[tuple[int, float], ...], ...]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; weights add.  Only pairs of states that can be reached are kept."""
        index, todo, rows = {(0, 0): 0}, [(0, 0)], []
        while todo:
            a, b = todo.pop(0)
            row = []
            for symbol in range(6):
                (x, v), (y, w) = self.arcs[a][symbol], other.arcs[b][symbol]
                if (x, y) not in index:
                    index[x, y] = len(index)
                    todo.append((x, y))
                row.append((index[x, y], v + w))
            rows.append(tuple(row))
        return Transducer(tuple(rows))

    def weigh(self, symbols: list[int]) -> float:
        state, total = 0, 0.0
        for symbol in symbols:
            state, weight = self.arcs[state][symbol]
            total += weight
        return total


def _machine(states: int, arc) -> Transducer:
    return Transducer(tuple(tuple(arc(s, c) for c in range(6)) for s in range(states)))


def grammar() -> Transducer:
    insult = _machine(1, lambda s, c: (0, 3.0 if c == INSULT else 0.0))
    # A threat opens a window of three tokens in which a target completes it.
    threat = _machine(4, lambda s, c: (3, 0.0) if c == THREAT else (0, 2.5) if c == TARGET and s else (max(0, s - 1), 0.0))
    target = _machine(5, lambda s, c: (4, 0.0) if c == TARGET else (max(0, s - 1), 1.0 if c == INSULT and s else 0.0))
    negation = _machine(4, lambda s, c: (3, 0.0) if c == NEGATION else (max(0, s - 1), -1.0 if c in (INSULT, THREAT) and s else 0.0))
    reported = _machine(2, lambda s, c: (1, 0.0) if c == REPORT else (s, -0.5 if c in (INSULT, THREAT) and s else 0.0))
    return insult.compose(threat).compose(target).compose(negation).compose(reported)


@dataclass
class Model:
    """Learned lexicon, weights of (best clause, log of matched clauses, 1) and of (log of further hints, 1)."""

    words: list[str]
    stems: list[str]
    hints: list[str]
    weights: tuple[float, float, float]
    hint_weights: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        matched = x[:, :2] @ np.array(self.weights[:2]) + self.weights[2]
        hinted = np.where(x[:, 2] > 0, x[:, 2] * self.hint_weights[0] + self.hint_weights[1], -np.inf)
        return sigmoid(np.maximum(matched, hinted))


class Scorer:
    """Features of texts under one lexicon: the best clause's weight, matched clauses, further hints."""

    def __init__(self, words: list[str], stems: list[str], hints: list[str]) -> None:
        self.machine = grammar()
        known: dict[int, int] = {}
        for names, symbol in ((words, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            for name in names:
                known.setdefault(word_hash(name), symbol)
        order = np.array(sorted(known), dtype=np.uint64)
        self.known, self.symbols = order, np.array([known[int(h)] for h in order], np.int8)
        self.stems, self.hints = self._by_length(stems), self._by_length(hints)

    @staticmethod
    def _by_length(stems: list[str]) -> dict[int, np.ndarray]:
        lengths = defaultdict(list)
        for stem in stems:
            lengths[len(stem.encode())].append(word_hash(stem))
        return {n: np.array(sorted(h), np.uint64) for n, h in lengths.items()}

    def features(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = np.zeros((len(column), 3))
        for begin, end in slices(offsets):
            base = offsets[begin]
            part = data[base : offsets[end]]
            words = Words(part, offsets[begin : end + 1] - base, MARKS)
            if not len(words.starts):
                continue
            at = np.minimum(np.searchsorted(self.known, words.hashes), len(self.known) - 1)
            symbol = np.where(self.known[at] == words.hashes, self.symbols[at], OTHER)
            size = words.ends - words.starts
            hint = np.zeros(len(size), bool)
            for table, is_hint in ((self.stems, False), (self.hints, True)):
                for n, hashes in table.items():
                    long = np.flatnonzero(size >= n + is_hint)
                    found = long[np.isin(words.rolling.range(words.starts[long], words.starts[long] + n), hashes)]
                    if is_hint:
                        hint[found] = True
                    else:
                        symbol[found] = INSULT
            rows = np.unique(np.searchsorted(words.first, np.flatnonzero((symbol == INSULT) | (symbol == THREAT) | hint), "right") - 1)
            for row in rows.tolist():
                out[begin + row] = self._row(part, words, symbol, hint, int(words.first[row]), int(words.first[row + 1]))
        return out

    def _row(self, data, words: Words, symbol: np.ndarray, hint: np.ndarray, lo: int, hi: int) -> tuple[float, float, float]:
        """Clauses that hold an insult or threat go through the machine."""
        begin = int(words.starts[lo])
        ends = [begin + m.start() for m in _CLAUSE_END.finditer(data[begin : int(words.ends[hi - 1])].tobytes())]
        clause = np.searchsorted(ends, words.starts[lo:hi])
        own = symbol[lo:hi]
        best, matched = 0.0, 0
        for c in np.unique(clause[(own == INSULT) | (own == THREAT)]).tolist():
            a, b = np.searchsorted(clause, [c, c + 1])
            weight = self.machine.weigh(own[a:b].tolist())
            if weight > 0:
                matched += 1
                best = max(best, weight)
        hinted = len(set(zip(clause[hint[lo:hi]].tolist(), words.hashes[lo:hi][hint[lo:hi]].tolist(), strict=True)))
        return best, float(np.log1p(matched)), float(np.log1p(max(0, hinted - 1)))


def _entries(text: str) -> set[str]:
    """Stems (ending in ``*``) and words of a text."""
    found: set[str] = set()
    for word in set(_WORD.findall(text.translate(_ASCII_LOWER))):
        if 3 <= len(word) <= 40:
            found.add(word)
            found.update(word[:n] + "*" for n in STEM_CHARS if n < len(word))
            if len(word) in STEM_CHARS:
                found.add(word + "*")
    return found


def learn(sample: DataFrame, least_rows: int = LEAST_ROWS) -> Model:
    """The lexicon and weights from labelled rows (text, y).  Rows with equal texts count once."""
    rows = cut(sample.groupBy(F.xxhash64("text").alias("key")).agg(F.max("y").alias("y"), F.first("text").alias("text")))
    size = dict(rows.groupBy("y").count().collect())
    if not size.get(0) or not size.get(1):
        return Model(list(INSULTS), [], [], DEFAULT_WEIGHTS, (0.0, DEFAULT_WEIGHTS[2]))

    def count(frames):
        for frame in frames:
            found: Counter[str] = Counter()
            for text in frame["text"]:
                found.update(_entries(text))
            yield pd.DataFrame({"entry": list(found), "n": list(found.values())})

    def counted(y: int) -> DataFrame:
        found = rows.where(F.col("y") == y).select("text").mapInPandas(count, "entry string, n long")
        return found.groupBy("entry").agg(F.sum("n").alias("n"))

    share = size[0] / size[1]
    # Toxic and clean rows are held against each other on Spark, before anything is bounded.
    held = cut(
        counted(1).where(F.col("n") >= least_rows)
        .join(counted(0).select("entry", F.col("n").alias("clean")), "entry", "left")
        .select("entry", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    )
    tested = held.agg(F.count_if(~F.col("entry").endswith("*"))).first()[0]
    telling = held.where(F.col("clean") <= 0.002 * share * F.col("n")).orderBy(
        F.desc(F.col("n") / (F.col("clean") + 1.0)), F.desc(F.length("entry")), "entry").limit(CANDIDATES).toArrow().to_pylist()
    beyond = max(LEAST_WORD_ROWS, np.log(max(tested, 1) / CHANCE) / np.log1p(share))
    hinting = held.where(
        F.col("entry").endswith("*") & (F.col("n") >= 2 * beyond) & (F.col("clean") <= share / HINT_LIFT * F.col("n"))
    ).orderBy(F.desc(F.col("n") / (F.col("clean") + 1.0)), F.desc(F.length("entry")), "entry").limit(CANDIDATES).toArrow().to_pylist()
    maybe = {r["entry"]: r["n"] for r in hinting}
    frequent = {r["entry"]: r["n"] for r in telling}
    clean = {r["entry"]: r["clean"] for r in telling}
    # Kept: at least fifty times as frequent in toxic rows, and more than chance explains.
    wanted = {*frequent, *maybe}

    def cover(frames):
        for frame in frames:
            found = []
            for key, text in zip(frame["key"], frame["text"], strict=True):
                words = _WORD.findall(text.translate(_ASCII_LOWER))
                hits: dict[tuple[str, str], int] = {}
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    for e in (word, *(word[:n] + "*" for n in STEM_CHARS)):
                        if e in wanted:
                            hits.setdefault((e, word), word_hash(f"{before} {after}") >> 1)
                found += [(key, e, word, place) for (e, word), place in hits.items()]
            yield pd.DataFrame(found, columns=["key", "entry", "word", "place"], dtype=object).astype({"key": "int64", "place": "int64"})

    covered, forms, places = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in rows.where("y = 1").select("key", "text").mapInPandas(cover, "key long, entry string, word string, place long").collect():
        covered[r["entry"]].add(r["key"])
        forms[r["entry"]].add(r["word"])
        places[r["entry"]].add(r["place"])
    # A stem has several forms, which tells it from a word that a few near copies share; a lone word needs more rows.
    # A hint has several forms among different neighbours; of stems with the same rows the shortest covers the others.
    hints: list[str] = []
    for entry in sorted(maybe, key=lambda e: (len(e), e)):
        if len(forms[entry]) >= HINT_FORMS and len(places[entry]) >= beyond and not entry.startswith(tuple(hints)):
            hints.append(entry.rstrip("*"))
    covered = {e: keys for e, keys in covered.items() if e in frequent and (len(forms[e]) >= 3 if e.endswith("*") else len(keys) >= LEAST_WORD_ROWS)}
    words, stems, open_ = [], [], {k for keys in covered.values() for k in keys}
    while open_ and len(words) + len(stems) < MAX_ENTRIES:
        # Most rows left; of equal ones the longest, a whole word before its stem.
        entry = max(covered, key=lambda e: (len(covered[e] & open_), not e.endswith("*"), len(e), e))
        if len(covered[entry] & open_) < least_rows:
            break
        (stems if entry.endswith("*") else words).append(entry.rstrip("*"))
        open_ -= covered[entry]
    # Stems that so far only stood beside chosen ones.
    for entry in sorted(covered, key=lambda e: (-len(covered[e]), -len(e), e)):
        name = entry.rstrip("*")
        if len(words) + len(stems) >= MAX_ENTRIES or len(covered[entry]) < max(LEAST_WORD_ROWS, 0.01 * size[1]):
            break
        if entry.endswith("*") and len(forms[entry]) >= 5 and not clean.get(entry) and not any(name.startswith(x) or x.startswith(name) for x in (*stems, *words)):
            stems.append(name)
    # Words that the chosen ones made dispensable here may stand alone elsewhere.  They count by the different neighbours
    # they have, as near copies share theirs, and must be beyond what chance gives among all words that were tested.
    words += [e for e in sorted(covered) if not e.endswith("*") and min(len(places[e]), len(covered[e])) >= beyond]
    words = list(dict.fromkeys([*words, *INSULTS]))
    scorer = Scorer(words, stems, hints)

    def measure(batches):
        for batch in batches:
            x = scorer.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["y", "best", "clauses", "hints"])

    found = rows.select("y", "text").mapInArrow(measure, "y int, best double, clauses double, hints double").toPandas()
    y = found["y"].to_numpy()
    w = fit_logistic(found[["best", "clauses"]].to_numpy() / 3.0, y, ridge=1e-4)
    h = fit_logistic(found[["hints"]].to_numpy() / 3.0, y, ridge=1e-4)
    return Model(words, stems, hints, (float(w[0] / 3), float(w[1] / 3), float(w[2])), (float(h[0] / 3), float(h[1])))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (0 or 1) beside its own columns, which replace like-named ones.

    ``labels`` has doc_id and toxic; rows that are held out, or whose label is not 0 or 1, teach nothing, and labels of one
    class only leave the prior lexicon.  A null or empty text has no clause and gets the score of a clean one.  Repeated
    rows score alike.  No rows: no rows.
    """
    small_batches(docs.sparkSession)
    model = learn(labelled_sample(docs, labels, "toxic", text, rows))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = Scorer(model.words, model.stems, model.hints).features(column)
        return pa.array(model.score(x))

    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return (
        docs.select(*own, held_out(F.col("doc_id")).alias("held_out"), score(F.col(text).cast("string")).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
