"""Operator 3: language identification as multilingual mixture inference.

Every language has a character n-gram model learned from labelled texts. A document is taken as a mixture: each of its
words is drawn from language k with probability pi_k. Expectation-maximisation over the words' n-gram likelihoods
estimates the proportions; the set of languages is chosen by penalised likelihood: a language stays only if it raises the
log likelihood by more than the penalty for a parameter. The prediction is the language with the largest proportion.

Learning takes at most SAMPLE_PER_LANGUAGE labelled texts of each language, the first in the order of a hash of the id;
every text is predicted whole.

Defined cases: null texts and texts without a letter are `und` with score 0; labels are taken as they are, null labels
teach nothing; without any label every text is `und`; ties go to the label that is first in code-point order. Rows that
repeat, also with their doc_id, are predicted each and learned from each; very long texts are read whole, a word once with
its count; further columns are not read, and those in `keep` must not be called lang_pred, score or shares; an empty table
gives no row. Every label is learned, however many there are and however rare.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, materialise, slices

#: Labelled texts that are learned from for each language, at most.
SAMPLE_PER_LANGUAGE = 1_500
ORDERS = (1, 2, 3)
#: Weights of the orders in the interpolated model, from short to long.
SHARES = (0.1, 0.3, 0.6)
UNKNOWN = "und"


def letters_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    names: list[str]
    index: dict[str, int]  # n-gram -> row
    starts: np.ndarray  # where each row's entries begin in the two arrays below, and their number
    languages: np.ndarray  # the languages that have the n-gram
    gains: np.ndarray  # how much more likely it is there than an unseen one, as a difference of logs times its order's share
    unseen: np.ndarray  # by order and language: log probability of an n-gram that the language has not, times the order's share

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]]) -> "LanguageModel":
        """counts: language -> n-gram -> times. Only what a language has takes room, however many languages there are."""
        names = sorted(counts)
        vocabulary = sorted(set().union(*counts.values())) if names else []
        index = {g: i for i, g in enumerate(vocabulary)}
        kinds = np.bincount(np.array([len(g) for g in vocabulary], np.int64), minlength=max(ORDERS) + 1) + 1
        shares = np.array([0.0, *SHARES])
        rows, languages, gains = ([np.empty(0, kind)] for kind in (np.int64, np.int32, np.float32))
        unseen = np.zeros((max(ORDERS) + 1, len(names)))
        for k, name in enumerate(names):
            at = np.fromiter((index[g] for g in counts[name]), np.int64, len(counts[name]))
            times = np.fromiter(counts[name].values(), np.float64, len(at))
            order = np.fromiter(map(len, counts[name]), np.int64, len(at))
            total = np.bincount(order, times, minlength=max(ORDERS) + 1) + 0.1 * kinds
            unseen[:, k] = np.log(0.1 / total) * shares
            rows.append(at)
            languages.append(np.full(len(at), k, np.int32))
            gains.append((np.log((times + 0.1) / 0.1) * shares[order]).astype(np.float32))
        row = np.concatenate(rows)
        by_row = np.argsort(row, kind="stable")
        return cls(names, index, np.searchsorted(row[by_row], np.arange(len(vocabulary) + 1)), np.concatenate(languages)[by_row], np.concatenate(gains)[by_row], unseen)

    def words_logs(self, words: list[str]) -> np.ndarray:
        """Log likelihood of words under every language: their n-grams', the orders weighted by SHARES."""
        find = self.index.get
        out = np.zeros((len(words), len(self.names)))
        for begin in range(0, len(words), 4096):
            part = words[begin : begin + 4096]
            rows: list[int] = []
            sizes: list[int] = []
            for w in part:
                w = f" {w} "
                n = len(w)
                before = len(rows)
                rows += [find(c, -1) for c in w]
                rows += [find(w[i : i + 2], -1) for i in range(n - 1)]
                rows += [find(w[i : i + 3], -1) for i in range(n - 2)]
                sizes.append(len(rows) - before)
            row, owner = np.array(rows), np.repeat(np.arange(len(part)), sizes)
            known = row >= 0
            row, owner = row[known], owner[known]
            times = self.starts[row + 1] - self.starts[row]
            at = np.repeat(self.starts[row] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            cell = np.repeat(owner, times) * len(self.names) + self.languages[at]
            lengths = np.array([len(w) + 2 for w in part])
            out[begin : begin + len(part)] = sum((np.maximum(lengths - n + 1, 0)[:, None] * self.unseen[n] for n in ORDERS), np.bincount(cell, self.gains[at], len(part) * len(self.names)).reshape(len(part), -1))
        return out


class WordTable(dict):
    """word -> row number in one matrix of log likelihoods, kept up to a bound."""

    MOST = 400_000

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.matrix = np.zeros((1024, len(model.names)), np.float32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def settle(self) -> None:
        """Score the words that were met since the last time."""
        if self.new:
            at = len(self) - len(self.new)
            while len(self.matrix) < len(self):
                self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[at : len(self)] = self.model.words_logs(self.new)
            self.new = []


def likelihoods(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods by language (rows are languages) relative to each word's best, and the logs of the best."""
    peak = logs.max(1)
    return np.ascontiguousarray(np.exp(np.maximum(logs - peak[:, None], -60.0)).T), peak


def _rise(like: np.ndarray, weights: np.ndarray, starts: np.ndarray, owner: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """One step of expectation-maximisation; pi is languages x documents."""
    part = like * pi[:, owner]
    part *= weights / np.maximum(part.sum(0), 1e-300)
    new = np.add.reduceat(part, starts, axis=1)
    return new / np.maximum(new.sum(0), 1e-300)


def _select(starts: np.ndarray, total: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of some documents, with their new starts and owners."""
    sizes = np.diff(np.r_[starts, total])[docs]
    begin = np.r_[0, np.cumsum(sizes)][:-1]
    rows = np.repeat(starts[docs] - begin, sizes) + np.arange(sizes.sum())
    return rows, begin, np.repeat(np.arange(len(docs)), sizes)


def mixtures(logs: np.ndarray, weights: np.ndarray, starts: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once, then the choice of languages by penalised likelihood.

    Rows of logs are words with weights; starts says where each document's rows begin. Returns proportions
    (documents x languages) and log likelihoods. A language is dropped, smallest proportion first, while that costs the
    document's log likelihood less than half the log of its number of words. Documents leave the rounds when they are settled.
    """
    like, peak = likelihoods(logs)
    languages, docs = logs.shape[1], len(starts)
    pi = np.full((languages, docs), 1.0 / languages)
    live = np.arange(docs)
    rows, begin, owner = _select(starts, len(logs), live)
    part_like, part_weights = like, weights
    for _ in range(rounds):
        new = _rise(part_like, part_weights, begin, owner, pi[:, live])
        moved = np.abs(new - pi[:, live]).max(0) >= 1e-3
        pi[:, live] = new
        if not moved.all():
            live = live[moved]
            if not len(live):
                break
            rows, begin, owner = _select(starts, len(logs), live)
            part_like, part_weights = like[:, rows], weights[rows]

    total = np.add.reduceat(weights, starts)
    penalty = 0.5 * np.log(np.maximum(total, 2.0))
    base = np.add.reduceat(peak * weights, starts)

    def value_of(part: np.ndarray, w: np.ndarray, begin: np.ndarray, owner: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.log(np.maximum((part * p[:, owner]).sum(0), 1e-300)) * w, begin)

    _, begin, owner = _select(starts, len(logs), np.arange(docs))
    value = base + value_of(like, weights, begin, owner, pi)
    live = np.arange(docs)
    for _ in range(languages - 1):
        live = live[(pi[:, live] > 0).sum(0) > 1]
        if not len(live):
            break
        rows, begin, owner = _select(starts, len(logs), live)
        part_like, part_weights = like[:, rows], weights[rows]
        trial = pi[:, live].copy()
        least = np.where(trial > 0, trial, np.inf).argmin(0)
        small = trial[least, np.arange(len(live))]
        trial[least, np.arange(len(live))] = 0
        trial /= trial.sum(0)
        if small.max() > 1e-3:  # a share that nothing stands on needs no new estimate of the others
            for _ in range(2):
                trial = _rise(part_like, part_weights, begin, owner, trial)
        found = base[live] + value_of(part_like, part_weights, begin, owner, trial)
        better = found + penalty[live] >= value[live]
        pi[:, live[better]], value[live[better]] = trial[:, better], found[better]
        live = live[better]
    return pi.T.copy(), value


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from labelled rows whose id's crc32 isn't 2 modulo 4."""
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    ids = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(lang).alias("lang")).where("lang is not null and __id is not null").where(id_remainder("__id", 4) != 2).withColumn("__place", place)
    # Places below this hold about twice as many texts of the language as are wanted, so hardly more are ranked.
    labels = materialise(ids.groupBy("lang").agg((F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.count("*"))).alias("__below")), "langid-labels")
    small = (lambda x: F.broadcast(x)) if labels.count() <= 100_000 else (lambda x: x)
    first = ids.join(small(labels), "lang").where(F.col("__place") < F.col("__below"))
    order = Window.partitionBy("lang").orderBy("__place", "__id")
    first = materialise(first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_language).select("__id", "lang"), "langid-sample")
    # At most per_language pairs of an id and a label for each label.
    few = F.broadcast(first) if first.count() <= 2_000_000 else first
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(lang).alias("lang"), F.col(text).alias("__text")).join(few, ["__id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in slices(batches, text="__text"):
            for name, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(letters_of(t or ""))
        for name, counter in words.items():
            found: Counter = Counter()
            for w, n in counter.items():
                for g in grams(w):
                    found[g] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([found[g] for g in keys], pa.int64())], ["lang", "gram", "n"])

    counted = rows.select("__id", "lang", "__text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # n-grams of up to three characters in at most per_language texts of a label
    counts: dict[str, dict[str, int]] = {}
    for r in counted.collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return LanguageModel.fit(counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred, score and the proportions by language for every row; no shuffle."""
    keep = tuple(keep)
    source = docs.select(*keep, F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = [*model.names, UNKNOWN]
        table = WordTable(model)
        for batch in slices(batches, 256, 1 << 20, "__text"):
            if len(table) > table.MOST:
                table = WordTable(model)
            ids, weights, sizes = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                counted = Counter(letters_of(t)) if t and model.names else {}
                ids.append(np.fromiter(map(table.__getitem__, counted), np.int64, len(counted)))
                weights.append(np.fromiter(counted.values(), np.float64, len(counted)))
                sizes.append(len(counted))
            table.settle()
            sizes = np.array(sizes)
            full = np.flatnonzero(sizes)
            best, score = np.full(len(sizes), len(names) - 1), np.zeros(len(sizes))
            shares = np.zeros((len(sizes), len(model.names)))
            if len(full):
                logs, weight = table.matrix[np.concatenate(ids)].astype(np.float64), np.concatenate(weights)
                starts = np.r_[0, np.cumsum(sizes[full])][:-1]
                pi, _ = mixtures(logs, weight, starts)
                shares[full] = pi
                best[full], score[full] = pi.argmax(1), np.clip(pi.max(1), 0, 1)
            columns = [batch.column(k) for k in range(len(keep))]
            offsets = pa.array(np.arange(len(sizes) + 1) * len(model.names), pa.int32())
            maps = pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([names[b] for b in best], pa.string()), pa.array(score), maps], [*keep, "lang_pred", "score", "shares"])

    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    return source.mapInArrow(work, schema)

