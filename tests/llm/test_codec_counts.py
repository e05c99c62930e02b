"""SentencePiece codec and token counts against the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from phenoloom.llm import queries as Q
from phenoloom.llm.sentencepiece_codec import PieceModel, digests, encode_decode
from phenoloom.llm.token_counts import count_tokens
from tokenizers import Tokenizer

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
EDGE = [None, "", " ", "  \n\t ", "a", "▁ ▁▁", "é漢🙂🙂 x\u0000", "<s> <0x0A> <|endoftext|> x<|endoftext|>", "aaaa" * 500, "x" * 20_000, "it's we'll  DON'T\r\n\r\n  12345 ///", "word " * 3000]


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return PieceModel(f.read())


def test_prefix_table_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(32, 127)] + list("éèüñß漢字あ🙂▁\n\t\r　ÿ") + ["  ", "    ", "the", "ing", " of"]
    texts = [t or "" for t in EDGE] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["".join(rng.choice(" ▁ab") for _ in range(40)) for _ in range(500)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.encode_decode(t)[1] == model.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(3, 32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(10)]
        assert model.decode(ids) == library.decode(ids)


def test_prefixes_have_one_last_piece(model):
    text = model.normalise("unbelievable thorndly")
    table = model.prefix_table(text)
    for end in range(1, len(text) + 1):
        assert model.encode_part(text[:end])[-1] == table[end]


def rows(spark):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(EDGE)] + [(None, "no id", "clash", 7), (3, "again", "clash", 7), (3, "again", "clash", 7)], "doc_id long, text string, ids string, n_tokens int")


def test_codec_table(spark):
    df = rows(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(encode_decode(df, PIECES)).collect() if r["doc_id"] is not None)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in df.collect():
        ids = library.encode(r["text"] or "")
        if r["doc_id"] is not None:
            want.append((False, r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    assert encode_decode(df.limit(0), PIECES).count() == 0


def test_counts_table(spark):
    df = rows(spark)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, BYTES).collect()))
    library = Tokenizer.from_file(BYTES)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False))) for r in df.collect())
    assert got == want
    assert count_tokens(df.limit(0), BYTES).count() == 0


def test_counts_of_documents(spark, small):
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in Q.op6_token_counts(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False))
        assert got[r["doc_id"]] == (n, n > 1024)


def test_a_piece_more_frequent_than_a_byte_holds(spark):
    df = spark.createDataFrame([(1, " the" * 1000), (2, " the")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(df, BYTES).collect()) == [(1, 1000), (2, 1)]


def test_a_frequent_piece_is_dealt_by_ranges_of_blocks(spark):
    """With one input partition to a range, no task gets more than one partition's postings of a pre-token, and counts stay."""
    from phenoloom.llm.token_counts import postings

    df = spark.createDataFrame([(i, " the cat" * (1 + i % 3)) for i in range(400)], "doc_id long, text string").repartition(8)
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, BYTES, spread=1).collect()} == {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, BYTES).collect()}
    rows = postings(df, [], block_rows=10).where("pre_token = ' the'").selectExpr("block", "block div 16777216 as part").groupBy("part").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 12
