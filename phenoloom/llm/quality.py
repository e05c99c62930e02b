"""Line-first cleaning: each line of a text is judged by rules, failing lines go, and a text that loses too much is rejected.

A line with a word fails by the first of these rules that it breaks:

- boilerplate: it equals an earlier line of the text, or it has fewer than 30 words and one of the PHRASES;
- navigation: 2 or more of its words, and a fifth of them at least, are separators;
- punctuation: more than three tenths of its words have a symbol or two marks in a row, or more than half of its words come
  after its last mark that ends a sentence or clause.

Lines without a word are neither kept nor lost. A text is rejected if more than half of its words are in failing lines, or
on its base figures: under 50 words, or over half of the words in 3-word windows that the text has twice.

One Arrow pass without any exchange: a text is judged by itself, so there is no key that could be hot. Memory is a few times
the text at hand; texts are read whole.

Defined cases: null and empty texts have all counts 0, an empty cleaned text, and fail on their words. Repeated rows and ids
are rows of their own. Further columns are passed on where `keep` names them; one that is called like a result is an error.
An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices

# What the rules look for.
SYMBOLS = "#*$%&|<>"
MARKS = (".", "!", "?", ":", ";", "…", "。", "！", "？")
SEPARATORS = ("|", "»", "›", "·", "•", "/", ">", "::")
PHRASES = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "read more", "share this", "subscribe to our newsletter", "licensed under")

#: Lines with fewer words may be boilerplate for a phrase.
SHORT_LINE = 30
LEAST_WORDS = 50

_MARKS = [m.encode() for m in MARKS]
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_PHRASES = re.compile("|".join(map(re.escape, PHRASES)).encode())
_NOISE = re.compile(b"[" + re.escape(SYMBOLS).encode() + rb"]|[!?]{2}")
_SYMBOLS = SYMBOLS.encode()
#: White space, and the bytes of a character after its first: what is left has a byte for each code point of a word.
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])

RULES = ("boilerplate", "navigation", "punctuation")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"lost_{r}" for r in RULES))


def broken_rule(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line of these words breaks; that it equals an earlier one is for the caller to see."""
    if len(words) < SHORT_LINE and _PHRASES.search(line.lower()):
        return "boilerplate"
    parted = sum(w in _SEPARATORS for w in words)
    if parted >= 2 and 5 * parted >= len(words):
        return "navigation"
    if _NOISE.search(line) and 10 * sum(_NOISE.search(w) is not None for w in words) > 3 * len(words):
        return "punctuation"
    last = max([0, *(at + len(m) for m in _MARKS if (at := line.rfind(m)) >= 0)])
    return "punctuation" if 2 * len(line[last:].split()) > len(words) else None


def repeated_words(ids: np.ndarray) -> int:
    """Places that are in a window of 3 which is there twice or more, the first included."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def judge(text: str | None) -> tuple[list[int], str]:
    """The COUNTS of a text and its lines that pass."""
    data = (text or "").encode()
    lost, seen, table, kept, ids, n_dup = dict.fromkeys(RULES, 0), set(), {}, [], [], 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        ids.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
        again = line in seen
        n_dup += again
        rule = "boilerplate" if again else broken_rule(line, words)
        seen.add(line)
        if rule:
            lost[rule] += len(words)
        else:
            kept.append(line)
    places = np.concatenate(ids) if ids else np.empty(0, np.int64)
    counts = [len(places), len(data.translate(None, _NOT_COUNTED)), len(data) - len(data.translate(None, _SYMBOLS)), n_dup, repeated_words(places)]
    return [*counts, *lost.values()], b"\n".join(kept).decode()


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def clean_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, the counts, `cleaned` (the text without failing lines), base_failed and kept."""
    taken = sorted({*COUNTS, "cleaned", "base_failed", "kept"} & set(keep))
    if taken:
        raise ValueError(f"columns named like results: {', '.join(taken)}")
    names = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, text="__text"):
            found = [judge(t.as_py()) for t in batch.column(len(names))]
            counts = np.array([c for c, _ in found], np.int64).T
            yield record_batch(**dict(zip(names, batch.columns, strict=False)), **dict(zip(COUNTS, counts, strict=True)), cleaned=pa.array([c for _, c in found], pa.string()))

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], *[f"{c} bigint" for c in COUNTS], "cleaned string"])
    out = rows.mapInArrow(work, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *COUNTS, "cleaned").withColumn("base_failed", base_failed())
    lost = sum((F.col(f"lost_{r}") for r in RULES), F.lit(0))
    return out.withColumn("kept", ~F.col("base_failed") & (2 * lost <= F.col("n_words")))
