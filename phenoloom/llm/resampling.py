"""Importance resampling towards a target: features hashed into buckets, gains of buckets, weights of documents, a drawn share.

Long texts are cut at word boundaries into chunks that carry the next n - 1 words. A chunk owns the runs of words that start
in its own part, so each run of the text is counted once; chunks are dealt to all tasks and their counts and weights are
summed by document. Texts of at most `chunk_bytes` bytes are a chunk as they stand and are not moved.

Counts need one pass over the texts that keeps a number for each bucket in a task, weights a second one that looks the
gains up; what is broadcast is `buckets` numbers, whatever the input. The draw numbers documents by range partitions.

Defined cases: a text that is null, empty or without a word has no feature, weight 0 and is never drawn. Rows that repeat
an id are parts of one document: features and weights are summed, no run crosses from one to the next, and the document is
one row of the result. A null id is a document without a score, never drawn, that doesn't count towards the share. Ties go
to the smaller id. An empty table gives no row; an empty target is a target in which every bucket is as likely. Only the id
and the text are read, so further columns, whatever their names, are no matter. A word is never cut, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import arrow_pass, materialise, record_batch, slices

BUCKETS = 10_000
#: Runs of 1 to so many words are features.
LONGEST = 3
CHUNK_BYTES = 32_768
#: A-Z as a-z; digits, a-z and every byte of a character beyond ASCII stay; anything else parts words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def plain(text: str | None) -> bytes:
    return text.encode().translate(LETTERS) if text else b""


def cut(words: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Parts of about `size` bytes with the `carry` words that follow, and how many words are the part's own."""
    words = re.sub(rb"  +", b" ", words)
    start, end = 0, len(words)
    while True:
        stop = words.find(b" ", min(start + size, end))
        stop = end if stop < 0 else stop
        own = words[start:stop].split()
        at, more = stop, []
        while len(more) < carry and at < end:
            after = words.find(b" ", at + 1)
            after = end if after < 0 else after
            more += words[at:after].split()
            at = after
        if own or not start:
            yield b" ".join([*own, *more]), len(own)
        if stop == end:
            return
        start = stop


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, words, own): every text of more than chunk_bytes bytes in chunks, dealt anew, and all other texts as they stand.

    `words` is read as a text is; `own` is how many of its words start runs, -1 for all. Chunks are written to the shared
    folder: they are read twice, by the counts and by the weights.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("words"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, text="words"):
            for k in range(batch.num_rows):
                parts = enumerate(cut(plain(batch.column(1)[k].as_py()), chunk_bytes, LONGEST - 1))
                while some := list(islice(parts, 256)):
                    yield record_batch(doc_id=pa.repeat(batch.column(0)[k], len(some)), part=pa.array([i for i, _ in some], pa.int64()), words=pa.array([w.decode() for _, (w, _) in some], pa.string()), own=pa.array([n for _, (_, n) in some], pa.int64()))

    long_ = F.octet_length("words") > chunk_bytes
    parts = arrow_pass(rows.where(long_), ["doc_id", "words"], work, f"doc_id {id_type}, part bigint, words string, own bigint")
    parts = materialise(parts.repartition("doc_id", "part").drop("part"), "chunks")
    return rows.where(~F.coalesce(long_, F.lit(False))).withColumn("own", F.lit(-1).cast("bigint")).unionByName(parts)


def features(text: str | None, own: int) -> tuple[list[int], int]:
    """Hashes of the runs that start at the own words, and the number of these words. A run's hash goes on from its first words'."""
    words = plain(text).split()
    own = len(words) if own < 0 else own
    spaced = [b" " + w for w in words]
    out, runs = [], list(map(crc32, words))
    for width in range(1, LONGEST + 1):
        out += runs[:own]
        runs = list(map(crc32, spaced[width:], runs))
    return out, own


def bucket_counts(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all chunks; a task hands on one row for each bucket it has seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 512, text="words"):
            for words, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(np.array(features(words.as_py(), own)[0], np.int64) % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield record_batch(bucket=seen.astype(np.int32), n=total[seen])

    return arrow_pass(parts, ["words", "own"], work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's floor(1000 ln) of its smoothed share in the target over that in the source: `buckets` numbers."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[counts["bucket"]], t[counts["bucket"]] = counts["s"], counts["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(parts: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): sums over a document's chunks."""
    id_type = parts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, text="words"):
            rows = []
            for words, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found, n = features(words.as_py(), own)
                rows.append((n, len(found), int(gains[np.array(found, np.int64) % len(gains)].sum())))
            n, size, weight = np.array(rows, np.int64).T
            yield record_batch(doc_id=batch.column(0), n_words=n, n_features=size, weight=weight)

    sums = arrow_pass(parts, ["doc_id", "words", "own"], work, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint")
    return sums.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Adds score and rank: the weight with Gumbel noise of the id, and 1, 2, ... for the share with the highest scores of
    the documents that have least_words words. So documents are drawn without replacement as their weights say."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scores")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    most = scored.agg(F.count_if(may)).first()[0] * percent // 100
    placed = numbered(scored.withColumn("__may", may), [F.desc("__may"), F.desc("score"), F.asc("doc_id")], "__place")
    rank = F.when(F.col("__may") & (F.col("__place") <= most), F.col("__place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every document with its features, weight and score, and the rank of those drawn towards the texts of `target`."""
    parts = chunks(docs, id_column, text, chunk_bytes)
    aim = chunks(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text).alias("text")), chunk_bytes=chunk_bytes)
    gains = bucket_gains(bucket_counts(parts, buckets), bucket_counts(aim, buckets), buckets)
    return draw(weigh(parts, gains), percent, least_words, seed)
