"""Operator 1: SentencePiece (merge type) encoding and decoding through a prefix table.

For every prefix of a normalised text the encoding of that prefix ends in exactly one piece. The table stores that piece.
An Aho-Corasick automaton over the vocabulary lists the pieces ending at each position; the one that is the last piece of
this prefix is the one whose pair with the last piece of the shorter prefix is compatible, i.e. the two pieces merged
as one text give just these two pieces again. (Merging picks the best-scored adjacent pair, leftmost first; a run inside a
span of adjacent output pieces never sees the rest, so a sequence is the encoding of its text if and only if every piece
encodes to itself and all neighbouring pairs are compatible.) Ids are then recovered from the end backwards.
Cost is linear in the text, whatever its length; there is no queue and no quadratic case.

Defined cases: null text is the empty text; the empty text has no ids and decodes to the empty text; characters outside
the vocabulary become byte pieces; U+2581 is white space for this model and decodes to a space, as in the library. Rows
that repeat, also with their doc_id, are encoded each; very long texts are encoded whole; equal merge scores go to the
leftmost pair; further columns are passed on if named in `keep` and not read otherwise; an empty table gives no row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message."""
    at, size = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < size:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        width = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + width]
        at += width


class PieceModel:
    """Vocabulary, normaliser flags and the prefix-table encoder of one model file."""

    MOST_CACHED = 250_000

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the merge (BPE) type")
        if normaliser.get(2) or trainer.get(24):
            raise ValueError("models with a character map or with white space as suffix are not supported")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.texts = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.kinds = kinds
        scores = np.frombuffer(b"".join(p.get(2, b"\0\0\0\0") for p in pieces), "<f4")
        self.score = {self.texts[i]: float(scores[i]) for i, k in enumerate(kinds) if k == NORMAL}
        self.ids = {self.texts[i]: i for i, k in enumerate(kinds) if k == NORMAL}
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, k in enumerate(kinds) if k == UNKNOWN)
        self.lengths = [len(t) for t in self.texts]
        self.shown = [t.replace(SPACE, " ") for t in self.texts]
        self.plain = frozenset(self.ids.values())
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if self.merge(text) == [text]:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        alphabet = set("".join(self.ids))
        alone = "".join(c for c in "\n\r\t" if c not in alphabet)
        inner = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        # No piece crosses these cuts, so the parts can be encoded one by one.
        self.cut = None if inner else re.compile(f"[{alone}]+|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, then leftmost."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                found = score.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            a, b = self.texts[left], self.texts[right]
            known = self.pairs[key] = a + b not in self.score and self.merge(a + b) == [a, b]
        return known

    def forget(self, most_pairs: int = 300_000) -> None:
        """Give memory back at the end of a task: workers live on, and other stages run in them."""
        self.parts.clear()
        if len(self.pairs) > most_pairs:
            self.pairs.clear()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def prefix_table(self, text: str) -> list[int]:
        """table[e]: last piece of the encoding of text[:e]; -1 where that is a character outside the vocabulary."""
        table = [-1] * (len(text) + 1)
        known = self.pairs.get
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if table[end] < 0:
                before = table[end - length]
                if before >= 0:
                    fits = known(before << 32 | piece)
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if not fits:
                        continue
                table[end] = piece
        return table

    def encode_part(self, text: str) -> list[int]:
        table, at, out = self.prefix_table(text), len(text), []
        while at:
            piece = table[at]
            if piece >= 0:
                out.append(piece)
                at -= self.lengths[piece]
            else:
                at -= 1
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(text[at].encode())] if self.byte_ids else [self.unknown]
        out.reverse()
        return out

    def text_of(self, ids: list[int]) -> str:
        """Pieces as text, byte pieces joined and read as UTF-8, white-space marks as spaces; nothing is cut at the start."""
        if self.plain.issuperset(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):  # each invalid byte becomes one replacement character
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[at : at + width]).decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                flush()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.shown[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the white space that encoding put in front is taken off again."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self.text_of(ids)
        return text[1:] if first is not None and (self.dummy_prefix or self.squeeze) and self.texts[first].startswith(SPACE) else text

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_decode(text)[0], "<i4").tolist()

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, text decoded from these ids)."""
        text = self.normalise(text or "")
        if not text:
            return b"", ""
        parts = self.cut.findall(text) if self.cut else [text]
        known, out = self.parts, []
        for part in parts:
            found = known.get(part)
            if found is None:
                ids = self.encode_part(part)
                found = array("i", ids).tobytes(), self.text_of(ids)
                if len(part) <= 64:
                    if len(known) >= self.MOST_CACHED:
                        known.clear()
                    known[part] = found
            out.append(found)
        decoded = "".join([x[1] for x in out])
        strip = text[0] == SPACE and (self.dummy_prefix or self.squeeze)
        return b"".join([x[0] for x in out]), decoded[1:] if strip else decoded


@lru_cache(maxsize=2)
def model_of(data: bytes) -> PieceModel:
    return PieceModel(data)


def encode_decode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, ids array<int> and decoded string for every row of df; no shuffle.

    The model file is read on the driver and sent as a broadcast: its size is that of one vocabulary file, whatever the data.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    keep = tuple(keep)
    source = df.select(*keep, F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data.value)
        for batch in slices(batches, text="__text"):
            pairs = [model.encode_decode(t) for t in batch.column(len(keep)).to_pylist()]
            offsets = np.cumsum([0, *(len(p[0]) // 4 for p in pairs)])
            ids = np.frombuffer(b"".join([p[0] for p in pairs]), "<i4")
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, list_array(offsets, pa.array(ids)), pa.array([p[1] for p in pairs], pa.string())], [*keep, "ids", "decoded"])
        model.forget()

    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(work, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
