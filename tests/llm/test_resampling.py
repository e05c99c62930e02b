"""Importance resampling against a plain computation, its chunks, its SQL and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from phenoloom.llm import queries as Q
from phenoloom.llm import resampling as R


def runs_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20, seed=42, buckets=10_000):
    """{doc_id: (n_features, weight, score, rank)} by the definition."""
    found, words = {}, Counter()
    for doc, text in docs:
        own, runs = runs_of(text)
        words[doc] += len(own)
        found.setdefault(doc, []).extend(zlib.crc32(r.encode()) % buckets for r in runs)
    s = Counter(b for runs in found.values() for b in runs)
    t = Counter(zlib.crc32(r.encode()) % buckets for text in target for r in runs_of(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    weight = {d: sum(map(gain, runs)) for d, runs in found.items()}
    noise = lambda d: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    score = {d: None if d is None else weight[d] + noise(d) for d in found}
    may = sorted((d for d in found if d is not None and words[d] >= least), key=lambda d: (-score[d], d))
    rank = {d: i + 1 for i, d in enumerate(may[: percent * len(may) // 100])}
    return {d: (len(found[d]), weight[d], score[d], rank.get(d)) for d in found}


def got(spark, docs, target, **more):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in R.resample(rows, aim, **more).collect()}


TEXTS = [" ".join(f"w{(i * k) % 37}" for k in range(1, 15 + i)) for i in range(1, 60)]


def test_equals_plain_computation(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    assert got(spark, docs, TEXTS[:5], percent=30) == plain(docs, TEXTS[:5], percent=30)


@pytest.mark.parametrize("chunk_bytes", [1, 40, 1000])
def test_chunks_change_nothing(spark, chunk_bytes):
    docs = [(1, "Ää B c  d, e1 " * 40), (2, " " * 500 + "x" * 300 + "\n" * 200 + "y z"), (3, "-" * 700), (4, "one two"), (5, "ein Wört " * 300), (6, "one two")]
    assert got(spark, docs, [TEXTS[3], "x y " * 50], chunk_bytes=chunk_bytes, percent=100) == plain(docs, [TEXTS[3], "x y " * 50], percent=100)


@settings(max_examples=60, deadline=None)
@given(st.text("aB9 é-\n", max_size=120), st.integers(1, 30))
def test_chunks_own_every_run_once(text, size):
    whole, n = R.features(text, -1)
    parts = [R.features(words.decode(), own) for words, own in R.cut(R.plain(text), size, R.LONGEST - 1)]
    assert sorted(h for part, _ in parts for h in part) == sorted(whole) and sum(own for _, own in parts) == n


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "?! ..."), (4, TEXTS[50]), (4, TEXTS[50]), (5, TEXTS[40]), (None, TEXTS[45]), (7, TEXTS[50])]
    found = got(spark, docs, TEXTS[:2], percent=100)
    assert found == plain(docs, TEXTS[:2], percent=100)
    assert found[1][:2] == found[2][:2] == found[3][:2] == (0, 0) and found[1][3] is None and found[None][2:] == (None, None)
    assert found[4][0] == 2 * found[7][0]


def test_empty_tables_and_target(spark):
    assert got(spark, [], TEXTS[:2]) == {}
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    assert got(spark, docs, []) == plain(docs, [])
    assert got(spark, docs, [None, ""]) == plain(docs, [])


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 30, 87, 5) for i in range(40)], "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    even = R.draw(rows, percent=50).withColumn("noise", F.col("score") - 5).collect()
    want = sorted(even, key=lambda r: (-r["noise"], r["doc_id"]))[:20]
    assert [r["doc_id"] for r in sorted((r for r in even if r["rank"]), key=lambda r: r["rank"])] == [r["doc_id"] for r in want]


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, words int, own int, part int, rank int")
    found = R.resample(rows, rows.select("text", "own"))
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and found.count() == len(TEXTS)


def test_same_rows_as_sql(spark, small):
    name = "op11_importance_resampling"
    assert compare(Q.queries()[name](spark, small), connect(small), Q.oracle_sql()[name]) == ""
