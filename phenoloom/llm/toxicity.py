"""Operator 8: toxicity from misspelling-tolerant lexicon matches and their context.

The lexicon is learned from labelled texts: whole words and stems (a stem stands for every word that begins with it) that
toxic texts hold far more often than clean ones. It is kept as a trie. A Levenshtein automaton is intersected with the trie
(one edit below 9 letters, two from there): states are sets of (trie node, edits so far), made once and kept, so a word
costs one table look-up for each letter and most words die early. Two automata are made. The close one wants the first
letter right and allows no edit in whole words of under 5 letters and stems of under 7. The loose one takes what is left:
a wrong first letter, words of 4 letters and stems of 5 and 6. Neither changes a stem's last letter or words of under 4
letters and stems of 4, and a term inside a longer unspaced run is seen only at the run's beginning. Each match is scored
with a window around it: a match inside quotation marks that open and close near by counts as quoted, not as abuse. A
small logistic model, fitted to the same labelled texts, weighs exact, misspelled, loose and quoted matches; texts whose
only matches are misspelled or loose have weights of their own, so labels decide how far either is believed.

The labelled texts are at most SAMPLE rows, the first in the order of a hash of the id; every text is scored whole.

Defined cases: null and empty texts have no match and the model's base score; a null label is no label; documents that are
not there are skipped; without both kinds of labels the lexicon is empty and every score is 0. Several labels of a document
count as the greatest; rows that repeat, also with their doc_id, are scored each; words and texts of any length are read
whole; equal supports go by the term's code points; columns of other names are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, WordHashes, id_remainder, materialise, shingle_hashes, slices, words_of

#: Labelled rows that are learned from, at most.
SAMPLE = 12_000
STEM_LENGTHS = range(4, 13)
END = "$"
TRIM = ".,;:!?\"'()[]{}<>*_~-–—…«»“”„‘’|/\\"
OPENING, CLOSING, BOTH = "«“„", "»”", '"'
WINDOW = 12
#: What misspelled and loose matches count beside exact ones before the labels are asked; the weights of features 3 and 4 are what labels say.
MISSPELLED, LOOSE = 0.7, 0.5
#: Features of a text.
FEATURES = 9
MATCHES = re.compile(rb"[^\x09]")


def tokens(text: str) -> list[str]:
    return [w.strip(TRIM) for w in WORDS.findall(text.lower())]


# --- lexicon -----------------------------------------------------------------------------------------------------------


def prefixes(words: set[str]) -> set[str]:
    """Every whole word (marked by its end) and every beginning of usual stem length."""
    found = set()
    for w in words:
        if len(w) >= 3:
            found.add(w + END)
            found.update(w[:n] for n in STEM_LENGTHS if n <= len(w))
    return found


def least_support(n_toxic: int) -> int:
    return max(3, math.ceil(0.005 * n_toxic))


def by_chance(t: int, c: int, share: float) -> float:
    """Probability that of t + c texts at least t are toxic if each is with probability `share`."""
    n = t + c
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(t, n + 1)]
    top = max(logs)
    return math.exp(min(0.0, top + math.log(sum(math.exp(x - top) for x in logs))))


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, tested: int, ratio: float = 20.0) -> dict[str, float]:
    """Terms from (prefix, toxic texts, clean texts): the longest beginning that still covers what its shortest pure one does.

    Values are log ratios of the two smoothed rates. Words end in END; other terms are stems. A term must be rarer by
    chance than one in 20 among all the `tested` ones.
    """
    if not n_toxic or not n_clean:
        return {}
    support, share = least_support(n_toxic), n_toxic / (n_toxic + n_clean)
    pure = {}
    for p, t, c in counts:
        score = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if t >= support and score >= math.log(ratio) and by_chance(t, c, share) * tested <= 0.05:
            pure[p] = (t, score)
    children: dict[str, list[str]] = {}
    for p in pure:
        parent = p[:-1]
        if parent in pure:
            children.setdefault(parent, []).append(p)
    chosen: dict[str, tuple[int, float]] = {}

    def settle(p: str) -> None:
        below = max(children.get(p, []), key=lambda c: (pure[c][0], c), default=None)
        if below is not None and pure[below][0] >= 0.9 * pure[p][0]:
            settle(below)
        else:
            chosen[p] = pure[p]

    for p in pure:
        if p[:-1] not in pure:
            settle(p)
    return {p: s for p, (_, s) in sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))}


# --- automaton ---------------------------------------------------------------------------------------------------------


class LexiconAutomaton:
    """Levenshtein automata of all terms at once, intersected with their trie and made deterministic as states are met.

    `loose`: the first letter may be wrong too, and whole words of 4 letters and stems of 5 and 6 may have an edit.
    """

    MOST_STATES = 40_000

    def __init__(self, terms: dict[str, float], loose: bool = False):
        self.loose = loose
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[bool] = [False]  # a word ends here
        self.stem: list[bool] = [False]  # a stem ends here
        self.budget: list[int] = [0]  # edits that the longest term through this node may have
        for term in terms:
            word = term.endswith(END)
            body = term[:-1] if word else term
            allowed = 0 if len(body) < ((4 if word else 5) if loose else (5 if word else 7)) else 1 if len(body) < 9 else 2
            at = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in body:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.whole.append(False)
                    self.stem.append(False)
                    self.budget.append(0)
                at = self.next[at][c]
                self.budget[at] = max(self.budget[at], allowed)
            if word:
                self.whole[at] = True
            else:
                self.stem[at] = True
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.at_end: list[int] = []  # fewest edits with which the word so far is a whole term; 9: none
        self.at_once: list[int] = []  # the same for stems
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """Letters of the term left out: deeper nodes at one more edit; not a stem's last and, but for loose ones, not the first."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(to, e + 1) for to in self.next[node].values() if (node or self.loose) and not self.stem[to] and e + 1 <= self.budget[to]]
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        if not states:
            return -1
        known = self.ids.get(states)
        if known is None:
            known = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.step.append({})
            self.at_end.append(min((e for n, e in states if self.whole[n]), default=9))
            self.at_once.append(min((e for n, e in states if self.stem[n]), default=9))
        return known

    def _move(self, state: int, c: str) -> int:
        new = set()
        for node, e in self.sets[state]:
            to = self.next[node].get(c)
            if to is not None and e <= self.budget[to]:
                new.add((to, e))
            if not node and not self.loose:
                continue  # a letter too many is never before the first, and the first is never another
            if e + 1 <= self.budget[node]:
                new.add((node, e + 1))
            new.update((other, e + 1) for x, other in self.next[node].items() if x != c and not self.stem[other] and e + 1 <= self.budget[other])
        found = self.step[state][c] = self._state(self._close(new))
        return found

    def edits(self, word: str) -> int:
        """Fewest edits with which the word matches a term; 9 if none does."""
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state, best = self.start, 9
        for c in word:
            to = self.step[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return best
            if self.at_once[state] < best:
                best = self.at_once[state]
        return min(best, self.at_end[state])


# --- scoring -----------------------------------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)

    def matcher(self) -> "Matcher":
        return Matcher(self)


class KnownWords(dict):
    """word as written -> fewest edits to a term (9: none; 8: only loosely), kept up to a bound."""

    MOST = 150_000

    def __init__(self, automaton: LexiconAutomaton, loose: LexiconAutomaton | None = None):
        super().__init__()
        self.automaton, self.loose = automaton, loose

    def __missing__(self, raw: str) -> int:
        word = raw.lower().strip(TRIM)
        found = self.automaton.edits(word) if len(word) >= 3 else 9
        if found == 9 and self.loose is not None and len(word) >= 3 and self.loose.edits(word) < 9:
            found = 8
        if len(self) >= self.MOST:
            self.clear()
        if len(raw) <= 60:
            self[raw] = found
        return found


class Matcher:
    """Features of whole texts; words' matches are kept, up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.automaton = LexiconAutomaton(model.terms)
        self.weights = np.array(model.weights)
        self.known = KnownWords(self.automaton, LexiconAutomaton(model.terms, loose=True))

    @staticmethod
    def quoted(words: list[str], at: int) -> bool:
        """Whether quotation marks open in the window before the word (or at it) and close in the window after it."""
        before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        own = words[at]
        opened = 0
        for w in [*before, own[: len(own) - len(own.lstrip(TRIM))]]:
            opened += sum(w.count(c) for c in OPENING) - sum(w.count(c) for c in CLOSING) + w.count(BOTH)
        closes = [*after, own[len(own.rstrip(TRIM)) :]]
        if any(c in w for w in closes for c in CLOSING) and opened > 0:
            return True
        return any(BOTH in w for w in closes) and opened % 2 == 1

    def features(self, text: str | None) -> list[float]:
        words = WORDS.findall(text) if text else []
        counts = [0] * 6  # exact, misspelled, loose; the same in quotation
        edits = bytes(map(self.known.__getitem__, words))
        for m in MATCHES.finditer(edits):
            kind = edits[m.start()]
            counts[(2 if kind == 8 else kind > 0) + 3 * self.quoted(words, m.start())] += 1
        exact, misspelled, loose = counts[:3]
        weight = exact + MISSPELLED * misspelled + LOOSE * loose
        only = [float(misspelled > 0 and not exact), float(loose > 0 and not exact and not misspelled)]
        return [1.0, float(weight > 0), math.log1p(weight), *only, *map(math.log1p, counts[3:]), math.log1p(weight) / math.log(10 + len(words))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> list[float]:
    """Newton's method with a ridge that leaves the constant free."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn lexicon and weights from the labelled rows whose id's crc32 isn't 0 modulo 5."""
    usable = labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where("__id is not null and y in (0, 1)").where(id_remainder("__id", 5) != 0)
    first = usable.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # The sample is at most `sample` pairs of numbers, so it may be broadcast.
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(first), "__id")


    def family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, text="__text"):
            keys = [int(x.min()) >> 1 if len(x := shingle_hashes(hashes.array(words_of(t)))) else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["__id", "y", "__text", "family"])

    rows = materialise(rows.select("__id", "y", "__text").mapInArrow(family, "__id bigint, y int, __text string, family bigint"), "toxic-sample")
    # Copies of one text must not make its rare words look like terms: one text of each family (same smallest shingle) is counted.
    single = rows.groupBy("family", "y").agg(F.min("__id").alias("__id")).select("__id")
    single = materialise(rows.join(F.broadcast(single), "__id", "left_semi").select("y", "__text"), "toxic-single")
    rows = rows.select("y", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(found[1].keys() | found[0].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], ["term", "t", "c"])

        for batch in slices(batches, text="__text"):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(prefixes(set(tokens(t or ""))))
            if len(found[0]) + len(found[1]) > 500_000:
                yield out()
                found[0].clear(), found[1].clear()
        if found[0] or found[1]:
            yield out()

    n = {r["y"]: r["n"] for r in single.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(weights=[-30.0] + [0.0] * (FEATURES - 1))
    support = least_support(n_toxic)
    counted = single.mapInArrow(count, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = materialise(counted.where(F.col("t") >= support), "toxic-terms")
    # Terms of `support` toxic texts and few clean ones: their number is bounded by the sample.
    found = [tuple(r) for r in counted.where(F.col("t") * n_clean >= 15 * F.col("c") * n_toxic).collect()]
    terms = choose_terms(found, n_toxic, n_clean, counted.count())
    model = ToxicityModel(terms)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in slices(batches, text="__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    seen = sorted((tuple(r["x"]), r["y"]) for r in rows.mapInArrow(featurise, "y int, x array<double>").collect())
    model.weights = fit_logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], float))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """Columns `keep` and the score of every row; no shuffle. The model's terms come from a sample of bounded size."""
    keep = tuple(keep)
    source = docs.select(*keep, F.col(text).alias("__scored"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = sent.value.matcher()
        for batch in slices(batches, text="__scored"):
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(matcher.scores(batch.column(len(keep)).to_pylist()))], [*keep, column])

    from pyspark.sql import types as T

    return source.mapInArrow(work, T.StructType([*source.drop("__scored").schema.fields, T.StructField(column, T.DoubleType())]))

