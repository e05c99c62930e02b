"""Operator 6: token counts without token ids.

Pieces are counted once per distinct pre-token; the counts are joined to per-document pre-token frequencies and summed.

1. One Arrow pass splits every text into pre-tokens and makes, per block of documents, one posting row for each pre-token
   of the block: the documents' places and the frequencies. A pre-token that every document holds thus has one row for
   each block, not one for each document.
2. Postings are dealt by pre-token and range of blocks and sorted, so even a pre-token that every block holds sends a task
   no more than the postings of the blocks of SPREAD input partitions. In its partition, each distinct pre-token is encoded
   once by the library's merge model, and its count joins all its postings; frequency times pieces is summed by document,
   first in the task, then where a block's sums meet.

Defined cases: null text counts as empty (0 bytes, 0 tokens); every input row gives one output row, also where doc_id is
null or repeated; a special token's string inside a text is one token, as is the library's default. A very long text is a
block of its own; further columns, whatever their names, are not read; an empty table gives no row. Nothing depends on an
order, so there are no ties.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Input partitions whose blocks share a pre-token's encoding: bounds what a frequent pre-token sends to one task.
SPREAD = 256
#: Fixed value: the published pre-token pattern of byte-level vocabularies of this kind.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A posting: a document's place in its block and the pre-token's frequency there. A document itself.
ENTRY = np.dtype([("row", "<u2"), ("freq", "u1")])
OWN = np.dtype([("known", "?"), ("doc_id", "<i8"), ("n_bytes", "<i8"), ("special", "<i4")])
#: What a task has summed for a document.
SUM = np.dtype([("row", "<u2"), ("tokens", "<u4")])


def pre_tokens(text: str) -> list[str]:
    import regex

    return regex.findall(PRE_TOKENS, text, flags=regex.V0)


def _check(config: dict) -> list[str]:
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or config["model"]["type"] != "BPE":
        raise ValueError("only byte-level merge vocabularies without normaliser and prefix space are supported")
    special = [t["content"] for t in config.get("added_tokens", [])]
    if any(t.get(k) for t in config.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return special


@lru_cache(maxsize=2)
def _counter(data: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def postings(df: DataFrame, special: list[str], text: str = "text", doc_id: str = "doc_id", block_rows: int = 16384, block_bytes: int = 24 << 20) -> DataFrame:
    """kind 0: a pre-token with its documents and frequencies in a block; kind 1: the block's documents themselves."""
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def block(ids: list[pa.Array], texts: list[list[str | None]], key: int) -> pa.RecordBatch:
        import regex

        find = regex.compile(PRE_TOKENS, regex.V0).findall
        cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        index: dict[str, int] = defaultdict(count().__next__)
        coded, n_special, n_bytes = [], [], []
        for part in texts:
            for t in part:
                t = t or ""
                n_bytes.append(len(t.encode()))
                spans = cut.split(t) if cut and any(s in t for s in special) else [t]
                n_special.append(len(spans) - 1)
                words = find(t) if len(spans) == 1 else [w for s in spans for w in find(s)]
                coded.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        rows = len(n_bytes)
        pairs = np.concatenate([np.empty(0, np.int64), *coded]) * rows + np.repeat(np.arange(rows), [len(c) for c in coded])
        del coded
        pairs.sort()
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
        freqs = np.diff(np.r_[starts, len(pairs)])
        token, owner = np.divmod(pairs[starts], rows)
        times = -(-freqs // 255)  # a frequency over 255 takes several entries
        entries = np.empty(int(times.sum()), ENTRY)
        entries["row"], entries["freq"] = np.repeat(owner, times), 255
        entries["freq"][np.cumsum(times) - 1] = freqs - 255 * (times - 1)
        offsets = np.searchsorted(np.repeat(token, times), np.arange(len(index) + 1)) * ENTRY.itemsize
        all_ids = pa.concat_arrays(ids)
        own = np.empty(rows, OWN)
        own["known"], own["doc_id"], own["n_bytes"], own["special"] = all_ids.is_valid().to_numpy(zero_copy_only=False), all_ids.fill_null(0).to_numpy(), n_bytes, n_special
        data = np.frombuffer(entries.tobytes() + own.tobytes(), np.uint8)
        n = len(index)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(n, np.int8), np.int8(1)]), pa.array([*index, str(key)], pa.string()), pa.array(np.full(n + 1, key)), _binary(np.r_[offsets, len(data)], data)],
            ["kind", "pre_token", "block", "entries"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 24
        ids, texts, rows, size = [], [], 0, 0
        for batch in slices(batches, block_rows, 4 << 20, "__text"):
            if rows + batch.num_rows > block_rows or size >= block_bytes:
                yield block(ids, texts, key)
                key, ids, texts, rows, size = key + 1, [], [], 0, 0
            ids.append(batch.column(0))
            texts.append(batch.column(1).to_pylist())
            rows, size = rows + batch.num_rows, size + batch.column(1).nbytes
        if rows:
            yield block(ids, texts, key)

    return source.mapInArrow(work, "kind tinyint, pre_token string, block bigint, entries binary")


def weigh(grouped: DataFrame, data: bytes) -> DataFrame:
    """Join of pre-tokens' piece counts to their postings, in partitions that hold all postings of a pre-token in a row.

    Each distinct pre-token is encoded once; a task makes one row of sums for each block it has met (kind 0) and passes
    the blocks' own documents on (kind 1).
    """
    sent = grouped.sparkSession.sparkContext.broadcast(data)

    def sums(keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        k, v = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(k, kind="stable")
        k, v = k[order], v[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out = np.empty(len(starts), SUM)
        out["row"], out["tokens"] = k[starts] & 0xFFFF, np.add.reduceat(v, starts)
        blocks, first = np.unique(k[starts] >> 16, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(blocks), np.int8)), pa.array(blocks), _binary(np.r_[first, len(out)] * SUM.itemsize, out)], ["kind", "block", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _counter(sent.value)
        last, last_n = None, 0
        keys, values, held = [], [], 0
        for batch in batches:
            own = batch.filter(pc.equal(batch.column(0), 1))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3)], ["kind", "block", "payload"])
                batch = batch.filter(pc.equal(batch.column(0), 0))
            if not batch.num_rows:
                continue
            words, blocks, entries = (batch.column(i) for i in (1, 2, 3))
            runs = pc.run_end_encode(words)
            distinct, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            known = int(distinct[0] == last)
            n = [last_n] * known + [len(e) for e in tokenizer.encode_batch(distinct[known:], add_special_tokens=False)]
            last, last_n = distinct[-1], n[-1]
            pieces = np.repeat(np.array(n, np.int64), np.diff(np.r_[0, ends]))
            lengths = pc.binary_length(entries).to_numpy() // ENTRY.itemsize
            x = np.frombuffer(b"".join(entries.to_pylist()), ENTRY)
            keys.append(np.repeat(blocks.to_numpy() << 16, lengths) | x["row"])
            values.append(np.repeat(pieces, lengths) * x["freq"])
            held += len(x)
            if held > 2_000_000:
                yield sums(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield sums(keys, values)

    return grouped.mapInArrow(work, "kind tinyint, block bigint, payload binary")


def collect_blocks(weighed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens from rows that are in the order of their blocks, each block's own documents first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own["doc_id"], mask=~own["known"]), pa.array(own["n_bytes"]), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 1:
                    if own is not None:
                        yield out()
                    own = np.frombuffer(payload, OWN)
                    totals = own["special"].astype(np.int64)
                else:
                    x = np.frombuffer(payload, SUM)
                    totals[x["row"]] += x["tokens"]  # a document comes once in a payload
        if own is not None:
            yield out()

    return weighed.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of df."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    special = _check(json.loads(data))
    # A block's key is its input partition shifted by 24 bits.
    found = postings(df, special, text, doc_id).withColumn("range", F.floor(F.col("block") / ((1 << 24) * spread)))
    grouped = found.repartition("kind", "pre_token", "range").sortWithinPartitions("pre_token").drop("range")
    return collect_blocks(weigh(grouped, data).repartition("block").sortWithinPartitions("block", F.desc("kind")))
